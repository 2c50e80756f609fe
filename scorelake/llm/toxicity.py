"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each later model also gets the probabilities that the earlier ones gave, and for
training these come from folds the earlier model had not seen, so that the chain learns how far they can be trusted.
Features are the presence of words and of word beginnings of three to six bytes (lower-cased ASCII, other bytes as they
are), hashed to 64 bits; a feature that comes twice, or that makes up one word in a hundred, counts as a further feature
each, since a beginning that is common in one language may mark toxic text only where it keeps coming. Those worth having are found on the cluster: for each feature, toxic and other labelled
documents that hold it are counted after pre-aggregation, and a likelihood-ratio test with a threshold that allows for the
number of features tested keeps the best `most_features`.

The model is fitted on at most `sample` labelled documents (the documented bound), chosen by a hash of doc_id; scoring is
one pass over whole texts without a shuffle.

Defined results: null and empty texts hold no feature and get the model's base rate; rows with a null doc_id are scored and
never learnt from; repeated rows are each scored; without labels of both kinds every probability is the share of that
label (0 where there is none); further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BARE_BYTES, Rolling, chunks, list_array, lower_ascii, mix, spans, table, utf8

SAMPLE, MOST_FEATURES, FOLDS = 16_000, 3000, 5
PREFIXES = (3, 4, 5, 6)
#: A feature is dense in a document if at least one word in so many holds it (and two words do).
DENSE = 100
_AGAIN, _DENSE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
#: The chain, in order: condition on a row of labels.
CHAIN = (("harmful", "toxic = 1 or quality = 0"), ("poor", "quality = 0"), ("toxic", "toxic = 1"))


def presence(texts):
    """(first document, last, distinct feature hashes by document, their numbers) for each chunk."""
    buf, off = utf8(texts)
    for i, j in chunks(off):
        b, local = lower_ascii(buf[off[i] : off[j]]), off[i : j + 1] - off[i]
        st, en, counts = spans(b, local, BARE_BYTES)
        roll = Rolling(b)
        doc = np.repeat(np.arange(j - i), counts)
        h, d = [roll.of(st, en)], [doc]
        for k in PREFIXES:
            long_enough = en - st > k
            h.append(mix(roll.of(st[long_enough], st[long_enough] + k) + np.uint64(k)))
            d.append(doc[long_enough])
        h, d = np.concatenate(h), np.concatenate(d)
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        at = np.flatnonzero(np.concatenate([np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (d[1:] != d[:-1])]))
        times = np.diff(np.append(at, len(h)))
        h, d = h[at], d[at]
        again = times >= 2
        dense = again & (times * DENSE >= counts[d])
        h, d = np.concatenate([h, mix(h[again] ^ _AGAIN), mix(h[dense] ^ _DENSE)]), np.concatenate([d, d[again], d[dense]])
        order = np.argsort(d, kind="stable")
        yield i, j, h[order], np.bincount(d, minlength=j - i)


def _counter(batches):
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, h, counts in presence(batch.column(0)):
            y = np.repeat(toxic[i:j], counts)
            key, back = np.unique(h, return_inverse=True)
            n1 = np.bincount(back, weights=y, minlength=len(key)).astype(np.int64)
            n = np.bincount(back, minlength=len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["f", "n1", "n0"])


def _find(vocab: np.ndarray, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the sorted vocabulary of the hashes that are there, and their number by document."""
    if not len(vocab):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    hit = vocab[at] == h
    doc = np.repeat(np.arange(len(counts)), counts)
    return at[hit], np.bincount(doc[hit], minlength=len(counts))


def _lister(vocab: np.ndarray):
    def run(batches):
        for batch in batches:
            for i, j, h, counts in presence(batch.column(1)):
                at, n = _find(vocab, h, counts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(at.astype(np.int32), n, pa.int32()), batch.column(2).slice(i, j - i)], names=["doc_id", "at", "y"])

    return run


class Linear:
    """Logistic regression on sparse presence features and a few dense ones; ridge on all but the intercept."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_features: int, ridge: float = 3e-4, steps: int = 300):
        n, k = dense.shape
        self.w, self.v, self.b = np.zeros(n_features), np.zeros(k), 0.0
        if not n or y.min() == y.max():
            self.b = -30.0 if not n or y.max() == 0 else 30.0
            return
        m = [np.zeros(n_features), np.zeros(k), 0.0]
        s = [np.zeros(n_features), np.zeros(k), 0.0]
        for t in range(1, steps + 1):
            r = (_sigmoid(self._z(rows, cols, dense)) - y) / n
            g = [np.bincount(cols, weights=r[rows], minlength=n_features) + ridge * self.w, r @ dense + ridge * self.v, r.sum()]
            for i, name in enumerate("wvb"):
                m[i] = 0.9 * m[i] + 0.1 * g[i]
                s[i] = 0.99 * s[i] + 0.01 * g[i] * g[i]
                setattr(self, name, getattr(self, name) - 0.1 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.99**t)) + 1e-8))

    def _z(self, rows, cols, dense) -> np.ndarray:
        return np.bincount(rows, weights=self.w[cols], minlength=len(dense)) + dense @ self.v + self.b

    def probability(self, rows, cols, dense) -> np.ndarray:
        return _sigmoid(self._z(rows, cols, dense))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Chain:
    def __init__(self, vocab: np.ndarray, names: list[str]):
        self.vocab, self.names, self.models = vocab, names, []

    def fit(self, rows, cols, y: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> Chain:
        n, k = len(y), len(self.vocab)
        dense = np.zeros((n, 0))
        for c in range(len(self.names)):
            self.models.append(Linear(rows, cols, dense, y[:, c], k))
            unseen = np.zeros(n)
            for f in range(folds):
                test = fold == f
                if not test.any():
                    continue
                train = ~test
                number = np.cumsum(train) - 1
                on = train[rows]
                part = Linear(number[rows[on]], cols[on], dense[train], y[train, c], k)
                unseen[test] = part.probability(rows, cols, dense)[test]
            dense = np.concatenate([dense, unseen[:, None]], axis=1)
        return self

    def predict(self, rows, cols, n: int) -> np.ndarray:
        dense = np.zeros((n, 0))
        for m in self.models:
            dense = np.concatenate([dense, m.probability(rows, cols, dense)[:, None]], axis=1)
        return dense

    def of(self, texts) -> np.ndarray:
        out = [np.zeros((0, len(self.names)))]
        for i, j, h, counts in presence(texts):
            at, n = _find(self.vocab, h, counts)
            out.append(self.predict(np.repeat(np.arange(j - i), n), at, j - i))
        return np.concatenate(out)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_features: int = MOST_FEATURES, chain=CHAIN) -> Chain:
    """The chain, learnt from labelled documents; the last category of the chain decides."""
    known = labels.where("doc_id is not null and toxic is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.array(*[F.expr(f"cast(coalesce({c}, false) as int)") for _, c in chain]).alias("y")
    )
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(known), "doc_id").select("doc_id", "text", "y")
    size = rows.agg(F.count("*").alias("n"), F.sum(F.element_at("y", -1)).alias("n1")).first()
    n, n1 = size["n"], size["n1"] or 0
    n0 = n - n1
    vocab = np.zeros(0, np.uint64)
    if n1 and n0:
        counts = rows.select("text", F.element_at("y", -1).alias("y")).mapInArrow(_counter, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"))
        # twice the log-likelihood ratio of "the feature's own rate" against "the common rate"; the chance of one of a million
        # useless features above 2 ln(10**6) is small
        g = f"2 * (if(a > 0, a * ln(a / ((a + b) * {n1 / n}D)), 0D) + if(b > 0, b * ln(b / ((a + b) * {n0 / n}D)), 0D))"
        good = counts.where(f"a >= 3 and a * {n0}D > 4 * b * {n1}D").withColumn("g", F.expr(g)).where(F.col("g") > 2 * np.log(1e5))
        vocab = np.sort(np.array([r["f"] for r in good.orderBy(F.desc("g"), "f").limit(most_features).select("f").collect()], dtype=np.int64).view(np.uint64))
    got = rows.mapInArrow(_lister(vocab), "doc_id long, at array<int>, y array<int>").toArrow().sort_by("doc_id").combine_chunks()
    at = got.column("at").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    lens = np.diff(at.offsets.to_numpy()) if len(at) else np.zeros(0, np.int64)
    y = np.array(got.column("y").to_pylist(), dtype=float).reshape(-1, len(chain))
    # the folds go round the documents, so that each label is in each fold
    fold = np.zeros(len(y), np.int64)
    fold[np.lexsort((got.column("doc_id").to_numpy(), y[:, -1]))] = np.arange(len(y)) % FOLDS
    return Chain(vocab, [c for c, _ in chain]).fit(np.repeat(np.arange(len(y)), lens), at.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(at) else np.zeros(0, np.int64), y, fold)


def _scorer(chain: Chain):
    def run(batches):
        for batch in batches:
            p = chain.of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", *[f"p_{c}" for c in chain.names]])

    return run


def toxicity_scores(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, one probability p_<category> for each link of the chain, and toxic: the last one is at least one half."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(_scorer(chain), ", ".join(["doc_id long", *[f"p_{c} double" for c in chain.names]]))
    return out.withColumn("toxic", F.col(f"p_{chain.names[-1]}") >= 0.5)


def _keeper(chain: Chain, text: int):
    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(chain.of(batch.column(text))[:, -1] < 0.5))

    return run


def drop_toxic(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows that the chain doesn't call toxic, in their own columns."""
    return docs.mapInArrow(_keeper(chain, docs.columns.index("text")), docs.schema)


def op10_toxicity_chain(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
