"""Shared pieces of the training-data operators: table access, scratch tables, and array kernels over UTF-8 buffers.

Words are maximal runs of bytes other than space and the control characters 9 to 13; the kernels work on the Arrow
text buffer itself, so no Python string is made for a document.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"

#: Bytes of text that one kernel call works on; longer documents are taken alone.
CHUNK_BYTES = 1 << 19

_MULT = 0x9E3779B97F4A7C15
_BASE = 0x100000001B3
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = got.get() if got.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="scorelake-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/scorelake/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives the loss of executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that further columns of the input can't clash with ours."""
    return df.select(*[df[n] for n in names])


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def chunks(off: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about `most` bytes; one longer document makes a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD_BYTES = ~_SPACE

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a bare word: ASCII letters and digits, underscore and every byte of a non-ASCII character.
BARE_BYTES = np.zeros(256, bool)
BARE_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def spans(b: np.ndarray, local: np.ndarray, inside: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and number for each document of the words in b; local: offsets of the documents in b."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(local) - 1, np.int64)
    w = inside[b]
    first = w.copy()
    first[1:] &= ~w[:-1]
    heads = local[:-1][local[:-1] < len(b)]
    first[heads] = w[heads]
    last = w.copy()
    last[:-1] &= ~w[1:]
    tails = local[1:] - 1
    tails = tails[tails >= 0]
    last[tails] = w[tails]
    st, en = np.flatnonzero(first), np.flatnonzero(last) + 1
    return st, en, np.diff(np.searchsorted(st, local))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        x = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        x[0] = 1
        have = np.cumprod(x)
        if n <= 4 * CHUNK_BYTES:
            _powers[key] = have
    return have[:n]


class Rolling:
    """Hashes of any span of b in a constant number of array operations (polynomial prefix sums modulo 2**64)."""

    def __init__(self, b: np.ndarray):
        self.sums = np.zeros(len(b) + 1, dtype=np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(b)), out=self.sums[1:])
        self.back = _power(_BASE_INV, len(b) + 1)

    def of(self, st: np.ndarray, en: np.ndarray) -> np.ndarray:
        h = (self.sums[en] - self.sums[st]) * self.back[st]
        return mix(h + (en - st).astype(np.uint64) * np.uint64(_MULT))


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words, by document; a shorter document with a word has one shingle of all its words.

    Returns the hashes (repeats kept) and their number for each document."""
    n = len(h)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.zeros(n, dtype=np.uint64)
    mult = np.uint64(_MULT | 1)
    for i in range(k):
        out = out * mult
        out[: n - i] += h[i:] if i else h
    out = mix(out)
    keep = np.ones(n, bool)
    made = np.maximum(counts - (k - 1), np.minimum(counts, 1))
    long_enough = counts >= k
    tail = np.zeros(n + 1, np.int32)
    np.add.at(tail, (ends - (k - 1))[long_enough], 1)
    np.add.at(tail, ends[long_enough], -1)
    keep &= np.cumsum(tail[:-1]) == 0
    for d in np.flatnonzero((counts > 0) & ~long_enough):
        s, e = starts[d], ends[d]
        v = np.uint64(e - s)
        with np.errstate(over="ignore"):
            for x in h[s:e]:
                v = v * mult + x
        keep[s:e] = False
        keep[s] = True
        out[s] = mix(np.array([v], dtype=np.uint64))[0]
    return out[keep], made


def unique_by_doc(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values within each document, sorted there."""
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(counts))


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    off = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values, kind))
