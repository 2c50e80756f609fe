"""Nearest neighbours by inner product: an inverted file with product-quantised residuals and exact reranking.

Coarse centroids and the codebooks of residuals are fitted on a bounded sample (`SAMPLE` vectors, chosen by hash); every
row is indexed. A query probes the lists whose centroids have the largest inner products with it. Their number is fitted, not
set: it is the least at which queries of the sample find `TARGET` of their neighbours of the sample, found by brute force,
so that clustered vectors take few lists and unclustered ones many; further lists are probed until they hold enough vectors.

Lists are cut into units of at most about `UNIT` vectors, and units dealt to groups of bounded size, of which a task holds one
and a block of queries. The task ranks the candidates of all the query's lists in its group by asymmetric distance tables
(query against codebooks), scores the best `rerank` of them, ties to the smaller vec_id, again on the original vectors in
double precision, and sends on its best k once.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold null or non-finite
components take no part, neither as queries nor as candidates; rows with a null vec_id take no part; rows that repeat a vec_id
are one vector, the least of them; a query with fewer than k other vectors gets all of them; further columns are ignored; an
empty table, or one without valid vectors, gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SAMPLE, SUBSPACES, CODES, RERANK = 32_768, 16, 128, 128
#: Vectors in a list on average, up to MOST_LISTS lists; share of the sample's neighbours that the probed lists must hold.
PER_LIST, MOST_LISTS, TARGET, TRIALS = 32, 2048, 0.97, 256
#: Vectors in a unit of a list, least groups, components of the vectors in a group, queries in a block.
UNIT, GROUPS, GROUP_FLOATS, QUERY_BLOCK = 4096, 8, 1 << 23, 1 << 16


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    if len(x) <= k:
        return x
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=k)
        order = np.argsort(at, kind="stable")
        filled = np.flatnonzero(n)
        c = x[rng.choice(len(x), k)]
        c[filled] = np.add.reduceat(x[order], (np.cumsum(n) - n)[filled], axis=0) / n[filled, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c * c).sum(axis=1) / 2
    for i in range(0, len(x), 2048):
        out[i : i + 2048] = np.argmax(x[i : i + 2048] @ c.T - half, axis=1)
    return out


class Index:
    """Centroids, codebooks and the number of lists to probe; what tasks get of the sample."""

    def __init__(self, sample: np.ndarray, rows: int, k: int = 20, subspaces: int = SUBSPACES, codes: int = CODES, per_list: int = PER_LIST, target: float = TARGET):
        self.dim = sample.shape[1]
        self.lists = kmeans(sample, int(np.clip(rows // per_list, 1, MOST_LISTS)))
        at = nearest(sample, self.lists)
        rest = sample - self.lists[at]
        edges = np.linspace(0, self.dim, min(subspaces, self.dim) + 1).astype(int)
        self.parts = list(zip(edges[:-1], edges[1:], strict=True))
        self.books = [kmeans(rest[:, a:b], codes) for a, b in self.parts]
        self.width = max(len(b) for b in self.books)
        self.probed = self._enough(sample, at, k, target)

    def _enough(self, sample: np.ndarray, at: np.ndarray, k: int, target: float) -> int:
        """The least number of lists that hold `target` of the true neighbours of queries from the sample."""
        asked = sample[:TRIALS]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(-(asked @ self.lists.T), axis=1, kind="stable"), axis=1)
        found = np.sort(place[np.arange(len(asked))[:, None], at[near]], axis=None)
        return int(found[int(np.ceil(target * len(found))) - 1]) + 1 if len(found) else 1

    def encode(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest = x - self.lists[at]
        return np.stack([nearest(rest[:, a:b], book) for (a, b), book in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(subspaces * width): inner products of the query's parts with the codebooks."""
        out = np.zeros((len(self.parts), self.width))
        for s, ((a, b), book) in enumerate(zip(self.parts, self.books, strict=True)):
            out[s, : len(book)] = book @ q[a:b]
        return out.reshape(-1)

    def probes(self, q: np.ndarray, sizes: np.ndarray, enough: int) -> np.ndarray:
        """(queries, lists): the lists each query probes, at least so many that they hold `enough` vectors."""
        order = np.argsort(-(q @ self.lists.T), axis=1, kind="stable")
        need = np.maximum((np.cumsum(sizes[order], axis=1) < enough).sum(axis=1) + 1, self.probed)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, np.arange(order.shape[1])[None] < need[:, None], axis=1)
        return out


def _valid(vectors: DataFrame) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assigner(index: Index):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), index.dim)
            at = nearest(x, index.lists)
            codes = index.encode(x, at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "list", "codes"])

    return run


class Deal:
    """Units of lists, and their groups: unit u of a list goes to group (first unit of the list + u) modulo groups."""

    def __init__(self, sizes: np.ndarray, groups: int, unit: int):
        self.sizes, self.groups = sizes, groups
        self.units = np.maximum(1, -(-sizes // unit))
        self.first = np.cumsum(self.units) - self.units

    def of(self, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
        spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64)
        return (self.first[at] + spread % self.units[at]) % self.groups

    def holding(self, probed: np.ndarray) -> np.ndarray:
        """(queries, groups): the groups that hold a unit of a probed list."""
        has = np.zeros((len(self.sizes), self.groups), bool)
        for u in range(int(min(self.units.max(), self.groups))):
            on = np.flatnonzero(self.units > u)
            has[on, (self.first[on] + u) % self.groups] = True
        # lists of as many units as groups lie in all of them
        return probed.astype(np.float32) @ has.astype(np.float32) > 0


def _dealer(deal: Deal):
    def run(batches):
        for batch in batches:
            group = deal.of(batch.column(2).to_numpy(), batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), *batch.columns], names=["group", "vec_id", "v", "list", "codes"])

    return run


def _prober(index: Index, deal: Deal, enough: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                row, group = np.nonzero(deal.holding(index.probes(_matrix(part.column(1), index.dim), deal.sizes, enough)))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(group, pa.int32()), part.column(0).take(rows), part.column(1).take(rows)], names=["group", "query_id", "q"])

    return run


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id, in that order."""
    if len(score) > k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= floor)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


FOUND = "query_id long, vec_id long, score double"


def _searcher(index: Index, deal: Deal, k: int, rerank: int, enough: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            ids, at = left["vec_id"].to_numpy(), left["list"].to_numpy()
            order = np.lexsort((ids, at))
            ids, at = ids[order], at[order]
            x = _matrix(left["v"], index.dim)[order]
            codes = np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            flat = codes.astype(np.int32) + np.arange(codes.shape[1], dtype=np.int32) * index.width
            asked, q = right["query_id"].to_numpy(), _matrix(right["q"], index.dim)
            for lo in range(0, len(asked), 256):
                probed = index.probes(q[lo : lo + 256], deal.sizes, enough)
                coarse = q[lo : lo + 256] @ index.lists.T
                for i, (query, v) in enumerate(zip(asked[lo : lo + 256], q[lo : lo + 256], strict=True)):
                    here = np.flatnonzero(probed[i][at])
                    if not len(here):
                        continue
                    guess = coarse[i][at[here]] + index.tables(v)[flat[here]].sum(axis=1)
                    near = here[_best(guess, ids[here], rerank + 1)]
                    near = near[ids[near] != query]
                    # not a matrix product, whose sums may differ between equal rows
                    score = (x[near] * v).sum(axis=1)
                    best = _best(score, ids[near], k)
                    out.append((np.full(len(best), query), ids[near][best], score[best]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.Table.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, sample: int = SAMPLE, rerank: int = RERANK, groups: int = GROUPS, unit: int = UNIT, query_block: int = QUERY_BLOCK, **options) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that meets the condition `queries`."""
    rows = materialise(_valid(vectors).groupBy("vec_id").agg(F.min("v").alias("v")), "ivf-vectors")
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    if not chosen.num_rows:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths, n = np.unique(np.array([len(x) for x in chosen.column("v")]), return_counts=True)
    dim = int(lengths[np.argmax(n)])
    rows = rows.where(F.size("v") == dim)
    chosen = chosen.filter(pa.array([len(x) == dim for x in chosen.column("v")]))
    held = rows.count()
    index = Index(_matrix(chosen.column("v"), dim), held, k, **options)
    placed = materialise(rows.mapInArrow(_assigner(index), "vec_id long, v array<float>, list int, codes binary"), "ivf-lists")
    sizes = np.zeros(len(index.lists), np.int64)
    for r in placed.groupBy("list").count().collect():  # at most MOST_LISTS numbers
        sizes[r["list"]] = r["count"]
    deal = Deal(sizes, max(groups, -(-held * dim // GROUP_FLOATS)), unit)
    here = placed.mapInArrow(_dealer(deal), "group int, vec_id long, v array<float>, list int, codes binary")
    asked = rows.where(queries).withColumnRenamed("vec_id", "query_id").withColumnRenamed("v", "q")
    there = asked.mapInArrow(_prober(index, deal, 20 * k), "group int, query_id long, q array<float>")
    # a group meets the queries in blocks of bounded size
    blocks = max(1, -(-asked.count() // query_block))
    there = there.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    here = here.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = here.groupBy("group", "block").cogroup(there.groupBy("group", "block")).applyInArrow(_searcher(index, deal, k, rerank, 20 * k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_ivfpq_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
