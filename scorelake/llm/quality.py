"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are labelled rows of quality 1; everything else is unlabelled web text, whatever its label says. The
class prior is estimated from the two samples alone: a first model is fitted to tell positives from unlabelled text;
the share of unlabelled text above a cutoff, divided by the share of positives above it, is smallest where hardly any
negative is, and there it is the prior. Then a linear model minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second term is negative, its gradient is reversed, so that it can't go on falling.

The model is fitted on the driver on at most `sample` positives and `sample` unlabelled documents (the documented bound),
chosen by a hash of doc_id; scoring is one pass without a shuffle.

Defined results: null and empty texts have zero features and a score of their own from the model; a null doc_id is scored as
any row and never learnt from; repeated rows are each scored; without positives every score is 0.5; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .features import N_FEATURES, features

SAMPLE = 12_000
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def _rows(batches):
    for batch in batches:
        x = features(batch.column(1))
        flat = pa.array(x.reshape(-1), pa.float32())
        off = pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES, pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(off, flat), batch.column(2)], names=["doc_id", "x", "part"])


def sample_features(docs: DataFrame, labels: DataFrame, sample: int, learn_from: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of the positives and of the unlabelled text; learn_from: SQL condition on doc_id of rows that may be learnt from."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(learn_from)
    first = lambda df, seed: df.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample)
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).where(learn_from)
    chosen = first(good, 1).withColumn("part", F.lit(1)).unionByName(first(ids, 2).withColumn("part", F.lit(0))).dropDuplicates()
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    got = text.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "part").mapInArrow(_rows, "doc_id long, x array<float>, part int").toArrow()
    part = got.column("part").to_numpy()
    x = got.column("x").combine_chunks()
    x = (x.flatten() if len(x) else pa.array([], pa.float32())).to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(np.float64)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    x, part = x[order], part[order]
    return x[part == 1], x[part == 0]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _adam(grad, n: int, steps: int, rate: float) -> np.ndarray:
    w, m, v = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in range(1, steps + 1):
        g = grad(w)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray, ridge: float = 1e-3) -> float:
    """Share of positives in the unlabelled sample, from scores of halves that the separating model has not seen."""

    def fit(a, b):
        def grad(w):
            sa, sb = _sigmoid(a @ w), _sigmoid(b @ w)
            return ((sa - 1) @ a) / len(a) + (sb @ b) / len(b) + 2 * ridge * w

        return _adam(grad, p.shape[1], 250, 0.05)

    sp, su = np.empty(len(p)), np.empty(len(u))
    for k in (0, 1):
        w = fit(p[k::2], u[k::2])
        sp[1 - k :: 2], su[1 - k :: 2] = p[1 - k :: 2] @ w, u[1 - k :: 2] @ w
    cuts = np.quantile(sp, np.linspace(0.02, 0.7, 35))
    above = lambda s: (s[None, :] >= cuts[:, None]).mean(axis=1)
    ratio = above(su) / np.maximum(above(sp), 1e-9)
    # each ratio is an upper bound apart from noise: two standard errors keep a lucky cutoff from winning
    error = 2 * np.sqrt((1 - above(sp)) / np.maximum(above(sp) * len(sp), 1) + 1 / np.maximum(above(su) * len(su), 1)) * ratio * 0.5
    return float(np.clip(ratio[np.argmin(ratio + error)], 0.05, 0.99))


def nn_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """Gradient of the non-negative risk, and its second term before it is cut off at zero; below zero that term's is reversed."""
    zp, zu = p @ w, u @ w
    up_p = ((_sigmoid(zp) - 1) @ p) / len(p)  # gradient of R_p(+)
    dn_p = (_sigmoid(zp) @ p) / len(p)  # of R_p(-)
    dn_u = (_sigmoid(zu) @ u) / len(u)
    rest = float(np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())
    return (prior * up_p + (dn_u - prior * dn_p) if rest >= 0 else -(dn_u - prior * dn_p)), rest


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 600, rate: float = 0.03, ridge: float = 1e-4) -> np.ndarray:
    """Weights, the intercept last (features end in a column of ones)."""

    def grad(w):
        reg = 2 * ridge * w
        reg[-1] = 0
        return nn_gradient(w, p, u, prior)[0] + reg

    return _adam(grad, p.shape[1], steps, rate)


class Model:
    def __init__(self, p: np.ndarray, u: np.ndarray, prior: float | None = None):
        self.prior, self.w = prior, None
        if not len(p) or not len(u):
            return
        both = np.concatenate([p, u])
        self.mean, self.std = both.mean(axis=0), both.std(axis=0) + 1e-3
        p, u = self._scaled(p), self._scaled(u)
        self.prior = estimate_prior(p, u) if prior is None else prior
        self.w = fit_nnpu(p, u, self.prior)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -8, 8)
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.w is None else _sigmoid(self._scaled(x) @ self.w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, learn_from: str = f"not ({HELD_OUT})", prior: float | None = None) -> Model:
    return Model(*sample_features(docs, labels, sample, learn_from), prior)


def _scorer(model: Model, text: int):
    def run(batches):
        for batch in batches:
            x = np.concatenate([model.score(features(batch.column(text).slice(i, 2048))) for i in range(0, batch.num_rows, 2048)]) if batch.num_rows else np.zeros(0)
            keep = [c for i, c in enumerate(batch.columns) if i != text]
            names = [n for i, n in enumerate(batch.schema.names) if i != text]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(x, pa.float64())], names=[*names, "score"])

    return run


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scorer(model, 1), "doc_id long, score double")
    return scored.select("doc_id", F.expr(f"coalesce({HELD_OUT}, false)").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keeper(model: Model, text: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                yield part.filter(pa.array(model.score(features(part.column(text))) >= 0.5))

    return run


def keep_quality(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose score is at least one half, in their own columns."""
    return docs.mapInArrow(_keeper(model, docs.columns.index("text")), docs.schema)


def op1_nnpu_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
