"""Evaluation of code submissions: measures, likeness to a reference, tests, constraints, ranking, all pairs of a batch.

Syntax trees have no column form; each submission is parsed once, in a pass over Arrow batches. Tests run in a process
of their own for each submission, with limits. Null code counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import code_constraints as C
from ..functions.code_measures import SIMILARITIES, Source, quality, run_tests, similarity

_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), list: T.ArrayType(T.StringType()), dict: T.MapType(T.StringType(), T.LongType())}


def _struct(sample: dict) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[type(v)]) for k, v in sample.items()])


_SAMPLE = Source("import os\n\n\ndef f(x: int):\n    '''Doc.'''\n    for i in x:\n        os.stat(i)\n").measures()
MEASURES = T.StructType([T.StructField(k, _struct(v)) for k, v in _SAMPLE.items()])
SIMILARITY = T.StructType([T.StructField(k, T.DoubleType()) for k in SIMILARITIES])
DETAIL = T.StructType([T.StructField(k, T.StringType()) for k in ("test", "status", "message")])
TESTS = T.StructType([*[T.StructField(k, T.LongType()) for k in ("total", "passed", "failed", "errors")], T.StructField("pass_rate", T.DoubleType()), T.StructField("details", T.ArrayType(DETAIL))])
CHECK = T.StructType([T.StructField(k, T.StringType()) for k in ("name", "status", "detail")])
CHECKS = T.StructType([T.StructField("checks", T.ArrayType(CHECK)), T.StructField("total", T.LongType()), T.StructField("passed", T.LongType()), T.StructField("score", T.DoubleType())])
QUALITY = T.StructType([T.StructField(k, T.DoubleType()) for k in (*("maintainability", "complexity", "documentation", "structure", "dry", "test_pass_rate", "similarity"), "overall")])


def _map(rows: DataFrame, keys: list[str], inputs: list, outputs: dict[str, T.DataType], work) -> DataFrame:
    """keys and the columns `outputs` of work(*inputs) for every row."""
    picked = rows.select(*keys, *[F.coalesce(c.cast("string"), F.lit("")).alias(f"_{i}") for i, c in enumerate(inputs)])
    kinds = {k: to_arrow_type(t) for k, t in outputs.items()}

    def run(batches):
        for batch in batches:
            found = [work(*row) for row in zip(*(c.to_pylist() for c in batch.columns[len(keys) :]), strict=True)]
            made = [pa.array([f[k] for f in found], t) for k, t in kinds.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *kinds])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[: len(keys)], *[T.StructField(k, t) for k, t in outputs.items()]]))


def measures(rows: DataFrame, keys: Iterable[str], code: str = "code") -> DataFrame:
    """keys and one struct column for each family of measures."""
    return _map(rows, list(keys), [F.col(code)], {f.name: f.dataType for f in MEASURES}, lambda x: Source(x).measures())


def check_constraints(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt", code: str = "code") -> DataFrame:
    """keys, task_type, check_results."""

    def work(p: str, x: str) -> dict:
        asked = C.extract(p)
        return {"task_type": asked.task_type, "check_results": C.check(Source(x), asked)}

    return _map(rows, list(keys), [F.col(prompt), F.col(code)], {"task_type": T.StringType(), "check_results": CHECKS}, work)


def evaluate(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt", code: str = "code", reference: str | None = None, tests: str | None = None) -> DataFrame:
    """keys, every family of measures, similarity to the reference code, test_results, quality_score, check_results, error.

    Tests are the row's own, or else those that the prompt holds. A row without code has an error and nothing else."""
    column = lambda c: F.col(c) if c else F.lit("")

    def work(p: str, x: str, ref: str, own: str) -> dict:
        out = dict.fromkeys(outputs)
        if not x.strip():
            return out | {"error": "No code provided"}
        source, asked = Source(x), C.extract(p)
        found = source.measures()
        alike = similarity(source, Source(ref)) if ref.strip() else dict.fromkeys(SIMILARITIES)
        ran = run_tests(x, own if own.strip() else asked.tests)
        scores = quality(found, alike["combined_similarity"], ran["pass_rate"])
        return out | found | {"similarity": alike, "test_results": ran, "quality_score": scores, "check_results": C.check(source, asked)}

    outputs = {f.name: f.dataType for f in MEASURES} | {"similarity": SIMILARITY, "test_results": TESTS, "quality_score": QUALITY, "check_results": CHECKS, "error": T.StringType()}
    return _map(rows, list(keys), [F.col(prompt), F.col(code), column(reference), column(tests)], outputs, work)


def rank_score(overall, constraints, tests):
    """Blend by which submissions are ranked; a failed one counts 0."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return 0.4 * zero(overall) + 0.3 * zero(constraints) + 0.3 * zero(tests)


def pair_similarity(rows: DataFrame, batch: str, model: str = "model", code: str = "code") -> DataFrame:
    """batch, model_a, model_b and the likeness of every two submissions of a batch, in the order of their names.

    A batch is one prompt's submissions, a handful by its meaning: the join is on the batch, and pairs form within it alone."""
    a = rows.select(F.col(batch).alias("batch"), F.col(model).alias("model_a"), F.col(code).alias("_a"))
    b = rows.select(F.col(batch).alias("batch"), F.col(model).alias("model_b"), F.col(code).alias("_b"))
    pairs = a.join(b, "batch").where("model_a < model_b")
    return _map(pairs, ["batch", "model_a", "model_b"], [F.col("_a"), F.col("_b")], {"s": SIMILARITY}, lambda x, y: {"s": similarity(Source(x), Source(y))}).select("batch", "model_a", "model_b", "s.*")


def similarity_matrix(pairs: DataFrame, value: str, models: list[str]) -> DataFrame:
    """batch, model and one column for each of the models: the value in both orders, 1 on the diagonal."""
    both = pairs.select("batch", F.col("model_a").alias("model"), F.col("model_b").alias("_o"), F.col(value).alias("_v"))
    both = both.unionByName(pairs.select("batch", F.col("model_b").alias("model"), F.col("model_a").alias("_o"), F.col(value).alias("_v")))
    own = both.select("batch", "model").distinct().select("batch", "model", F.col("model").alias("_o"), F.lit(1.0).alias("_v"))
    return both.unionByName(own).groupBy("batch", "model").pivot("_o", models).agg(F.first("_v"))
