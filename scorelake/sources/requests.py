"""Evaluation requests from JSON, each with an explicit schema: one row for each text to be evaluated.

Files hold one request a line, or one a file with `whole`. Rows that can't be evaluated stay, with their reason in `error`, so
that nothing is lost silently; valid() leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRITING = "prompt string, context string, models array<struct<name:string,response:string>>, weights map<string,double>"
SUMMARY = "model string, prompt string, source string, summary string, url string"
TRANSLATION = "id long, model_name string, language_pair string, original string, back_translation string"
CODING = "prompt string, reference_code string, test_cases string, task_type string, models array<struct<name:string,code:string>>"


def _read(spark: SparkSession, path: str, schema: str, whole: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def _blank(name: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(F.col(name), F.lit("")), r"(?U)^\s+|\s+$", "")) == 0


def _first(*checks: tuple[Column, str]) -> Column:
    """The message of the first condition that holds."""
    return F.coalesce(*[F.when(c, F.lit(m)) for c, m in checks])


def writing(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """request, prompt, context, weights, model, response, input_idx, error."""
    rows = _read(spark, path, WRITING, whole).withColumn("request", F.monotonically_increasing_id())
    each = rows.select("request", "prompt", "context", "weights", F.posexplode_outer("models").alias("input_idx", "m"))
    each = each.select("request", "prompt", "context", "weights", F.coalesce("m.name", F.lit("Unknown")).alias("model"), F.col("m.response").alias("response"), "input_idx")
    return each.withColumn("error", _first((_blank("prompt"), "prompt required"), (F.col("input_idx").isNull(), "models required"), (_blank("response"), "empty response")))


def summaries(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return _read(spark, path, SUMMARY, whole).withColumn("error", _first((_blank("prompt"), "prompt required"), (_blank("summary"), "summary required")))


def translations(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """Both texts trimmed; a missing language pair is Unknown."""
    rows = _read(spark, path, TRANSLATION, whole)
    trim = lambda c: F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    rows = rows.withColumns({"original": trim("original"), "back_translation": trim("back_translation"), "language_pair": F.coalesce("language_pair", F.lit("Unknown"))})
    return rows.withColumn("error", _first((_blank("original"), "original required"), (_blank("back_translation"), "back_translation required")))


def submissions(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """request, prompt, reference_code, test_cases, task_type, model, code, input_idx, error."""
    rows = _read(spark, path, CODING, whole).withColumn("request", F.monotonically_increasing_id())
    each = rows.select("request", "prompt", "reference_code", "test_cases", "task_type", F.posexplode_outer("models").alias("input_idx", "m"))
    each = each.select("request", "prompt", "reference_code", "test_cases", "task_type", F.coalesce("m.name", F.lit("Unknown")).alias("model"), F.col("m.code").alias("code"), "input_idx")
    return each.withColumn("error", _first((_blank("prompt"), "prompt required"), (F.col("input_idx").isNull(), "models required"), (_blank("code"), "No code provided")))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where("error is null").drop("error")


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, name (of the file, without its ending), content of every image file of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{png,ppm,pgm}").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("name"), "content")


def verdicts(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """A stored judge's answer as a struct: code fences taken off, then read as JSON; null where it can't be."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(F.col(column)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return rows.withColumn(column, F.from_json(bare, schema))
