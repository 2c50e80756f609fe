"""Token ids in files of Re-Pair grammars, with random access by document.

Documents are dealt by ranges of doc_id into shards; a shard is a run of blocks of about `BLOCK` ids, whole documents each.
In a block the most frequent pairs of neighbouring symbols within documents are replaced by nonterminals, again and again,
until no pair is frequent; each block has a grammar of its own. The block stores the rules, the expansion length of each nonterminal, and where each document's
symbols begin, so that one document is decoded without the others. A block is one binary value in a row of the shard's
file, which Spark writes and reads, so that files may lie in any store and a lost task leaves nothing behind.

Block: seven little-endian 32-bit numbers (MAGIC, first nonterminal, rules, symbols, documents, bytes per symbol, 0), the
rules (two uint32 each), expansion lengths (uint32), doc ids (int64), a byte for each document that is 1 where its id is
null, each document's symbols and ids (uint32), the symbols.

Defined results: null and empty texts are the end id alone; a null doc_id comes first; rows that repeat a doc_id are written
each, in an order fixed by their texts; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table
from .tokens import default_path, encoder

MAGIC, END_ID = 0x52505231, 1
#: Ids in a block, bytes of text in a shard, pairs replaced in one round, least count of a pair.
BLOCK, SHARD, PAIRS, LEAST = 1 << 16, 1 << 24, 1024, 8
_BUCKETS = 1 << 16


def _frequent(seq: np.ndarray, first: np.ndarray, least: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, places, pair of each place): the most frequent pairs within documents, those of at least a quarter of the
    best count, in order of their keys (left << 32 | right).

    Pairs are counted by hash bucket first; only those of buckets that reach the count are sorted."""
    key = (seq[:-1] << np.uint64(32)) | seq[1:]
    bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)
    bucket[first[1:]] = _BUCKETS
    held = np.bincount(bucket, minlength=_BUCKETS + 1)
    held[_BUCKETS] = 0
    floor = max(least, int(held.max()) // 4)
    while True:
        at = np.flatnonzero(held[bucket] >= floor)
        values, of, counts = np.unique(key[at], return_inverse=True, return_counts=True)
        best = int(counts.max()) if len(counts) else 0
        # a bucket of several pairs may have set the floor too high
        if floor == least or best >= floor:
            break
        floor = max(least, min(best, floor // 2))
    on = np.flatnonzero(counts >= max(least, best // 4))
    on = np.sort(on[np.lexsort((on, -counts[on]))[:most]])
    rank = np.full(len(values), -1, np.int64)
    rank[on] = np.arange(len(on))
    of = rank[of]
    return values[on], at[of >= 0], of[of >= 0]


def compress(ids: np.ndarray, lengths: np.ndarray, most: int = PAIRS, least: int = LEAST):
    """(rules, expansion lengths, first nonterminal, symbols, symbols by document) of documents laid end to end."""
    seq = ids.astype(np.uint64)
    first = np.zeros(len(seq) + 1, bool)
    first[np.concatenate([[0], np.cumsum(lengths)])] = True
    first = first[: len(seq)]
    base = int(seq.max()) + 1 if len(seq) else 1
    rules, size = np.zeros((0, 2), np.uint64), np.ones(0, np.int64)
    # each round makes the symbols fewer
    while len(seq) >= 2:
        pairs, hit, of = _frequent(seq, first, least, most)
        if not len(pairs):
            break
        # of pairs that overlap, every other one from the left
        begins = np.concatenate([[True], np.diff(hit) > 1])
        run = np.maximum.accumulate(np.where(begins, np.arange(len(hit)), 0))
        stays = (np.arange(len(hit)) - run) % 2 == 0
        hit, of = hit[stays], of[stays]
        new = np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1)
        held = np.concatenate([[1], size])
        size = np.concatenate([size, held[np.maximum(new.astype(np.int64) - (base - 1), 0)].sum(axis=1)])
        seq[hit] = of.astype(np.uint64) + np.uint64(base + len(rules))
        rules = np.concatenate([rules, new])
        seq, first = np.delete(seq, hit + 1), np.delete(first, hit + 1)
    starts = np.flatnonzero(first)
    return rules, size, base, seq, np.diff(np.concatenate([starts, [len(seq)]]))


def encode_block(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    lengths = np.array([len(x) for x in docs], np.int64)
    rules, size, base, seq, symbols = compress(np.concatenate(docs), lengths)
    wide = 2 if base + len(rules) <= 1 << 16 else 4
    head = np.array([MAGIC, base, len(rules), len(seq), len(docs), wide, 0], "<u4")
    parts = [head, rules.astype("<u4"), size.astype("<u4"), np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], "u1")]
    parts += [symbols.astype("<u4"), lengths.astype("<u4"), seq.astype(f"<u{wide}")]
    return b"".join(x.tobytes() for x in parts)


class Block:
    """A block of a file; ids(i) decodes one document."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, "<u4", 7)
        if head[0] != MAGIC:
            raise ValueError("not a block of a Re-Pair file")
        self.base, n_rules, n_symbols, n_docs, wide = (int(x) for x in head[1:6])
        at = 28
        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got
        self.rules = take("<u4", 2 * n_rules).reshape(-1, 2)
        self.sizes = take("<u4", n_rules)
        ids, null = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [None if z else int(x) for x, z in zip(ids, null, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(take("<u4", n_docs).astype(np.int64))])
        self.lengths = take("<u4", n_docs).astype(np.int64)
        self.symbols = take(f"<u{wide}", n_symbols).astype(np.uint32)

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while True:
            inner = seq >= self.base
            if not inner.any():
                return seq
            out = np.repeat(seq, 1 + inner)
            at = (np.cumsum(1 + inner) - 1 - inner)[inner]
            rule = self.rules[seq[inner] - self.base]
            out[at], out[at + 1] = rule[:, 0], rule[:, 1]
            seq = out

    def ids(self, i: int) -> np.ndarray:
        return self._expand(self.symbols[self.starts[i] : self.starts[i + 1]])

    def all(self) -> list[np.ndarray]:
        return np.split(self._expand(self.symbols), np.cumsum(self.lengths)[:-1])


BLOCK_ROW = "shard int, block int, before long, n_tokens long, data binary"


def _writer(path: str, end_id: int, block: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], "<u4").tobytes()
        shard, k, before = TaskContext.get().partitionId(), 0, 0
        names, docs, held = [], [], 0

        def made():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([k], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([encode_block(names, docs)], pa.binary())],
                names=["shard", "block", "before", "n_tokens", "data"],
            )

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, raw in zip(part.column(0).to_pylist(), enc.raws(part.column(1).to_pylist()), strict=True):
                    ids = np.frombuffer(raw + end, "<u4")
                    if docs and held + len(ids) > block:
                        yield made()
                        k, before, names, docs, held = k + 1, before + held, [], [], 0
                    names.append(doc)
                    docs.append(ids)
                    held += len(ids)
        if docs:
            yield made()

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, shard: int = SHARD) -> None:
    """Writes the ids of every row to `path`, shards in ascending order of doc_id: texts are dealt by ranges of doc_id, and
    each shard's task encodes, compresses and writes them as they come, a block in memory at a time."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    held = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    # rows of one doc_id in the order of a hash, which deals them to several shards as well
    keys = ["doc_id", F.xxhash64("text")]
    dealt = rows.repartitionByRange(max(1, -(-held // shard)), *keys).sortWithinPartitions(*keys)
    written = dealt.mapInArrow(_writer(tokenizer or default_path("word_bpe_49k.json"), end_id, block), BLOCK_ROW)
    written.write.option("compression", "zstd").parquet(path)


def _reader(bases: dict[int, int], digest: bool):
    def run(batches):
        for batch in batches:
            for shard, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                got = Block(data)
                n = pa.array(got.lengths, pa.int64())
                start = pa.array(np.cumsum(got.lengths) - got.lengths + bases[shard] + before, pa.int64())
                raw = [x.astype("<u4").tobytes() for x in got.all()]
                last = pa.array([zlib.crc32(x) for x in raw], pa.int64()) if digest else pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(got.doc_ids, pa.int64()), start, n, last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian uint32) of every document of the files; ids_crc32 for ids with `digest`."""
    rows = spark.read.schema(BLOCK_ROW).parquet(path)
    # one number for each shard (some megabytes of text): what the driver keeps
    bases, total = {}, 0
    for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        bases[r["shard"]] = total
        total += r["n"]
    kind = "ids_crc32 long" if digest else "ids binary"
    return rows.select("shard", "before", "data").mapInArrow(_reader(bases, digest), f"doc_id long, start long, n_tokens long, {kind}")


def op5_repair_token_files(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "repair-files")
    write(table(spark, sf_dir, "documents"), path)
    return read(spark, path, digest=True)
