"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Documents become ids, then pieces of at most `capacity` ids: only longer documents are cut, the first piece taking the
remainder. Full pieces fill a sequence each. The others are dealt by hash into shards of bounded size, and each shard is
packed: a first solution by best-fit decreasing, then, for shards above their lower bound, a grouping genetic algorithm.

Its genes are whole sequences. Crossover injects well-filled sequences of one parent into the other, takes out the sequences
that hold an injected piece a second time, and places the pieces displaced by that: displaced pieces first take the place of
one or two smaller pieces of a sequence where they fill it better, and what is displaced in the end is best-fitted, the
largest first. A large shard is evolved core by core, each of bounded size, until every sequence has been in one: a core takes
sequences that were in none yet, and those that earlier cores left with room; a packing cut down to the core's pieces is a
packing of the core. Several islands evolve a shard in tasks of their own from different seeds and cores; between epochs each
island's elite moves to the next. The best island's packing is the shard's. Last, the sequences with room of all shards are
dealt anew, whole, into shards of the same size, and evolved there, round after round, until all of them were in one shard, they
are as few as their volume allows, or a round saves none.

Defined results: null and empty texts are documents of the end id alone; a null doc_id is packed as any other; rows that
repeat a doc_id are packed each, in different shards too; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, table
from .tokens import default_path, encoder

CAPACITY, END_ID = 1024, 2
#: Pieces of one shard on average; the shards' number grows with the input, their size doesn't.
SHARD_PIECES = 16_384
#: Pieces of a core (all of a shard go through cores), and the crossovers of a core of that size (more for smaller ones).
CORE, GENERATIONS, MOST_GENERATIONS = 1024, 16, 300
ISLANDS, EPOCHS, POPULATION = 3, 2, 8

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: With a number that tells equal rows apart.
NUMBERED = PIECE + ", number long"
#: With the place, and the room that is left in the sequence.
PLACED = PIECE + ", sequence_id long, offset long, room long"


def _cutter(path: str, end_id: int, capacity: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                doc, piece, start, length, crc = [], [], [], [], []
                for d, raw in zip(part.column(0).to_pylist(), enc.raws(part.column(1).to_pylist()), strict=True):
                    ids = raw + end
                    at, no, n = 0, 0, len(ids) // 4
                    while at < n:
                        size = (n - at) % capacity or capacity
                        doc.append(d)
                        piece.append(no)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                        at, no = at + size, no + 1
                numbers = np.arange(number, number + len(doc))
                number += len(doc)
                arrays = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, numbers)]]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "number"])

    return run


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(path, end_id, capacity), NUMBERED)


class Bins:
    """Open sequences by room left; the fullest that still takes a piece is found in a bit set."""

    def __init__(self, capacity: int):
        self.capacity, self.at, self.mask, self.n = capacity, [[] for _ in range(capacity + 1)], 0, 0

    def add(self, room: int, name: int) -> None:
        if room > 0:
            self.at[room].append(name)
            self.mask |= 1 << room

    def fit(self, size: int) -> int:
        """The sequence that takes the piece, by its name; a new one if none has room."""
        high = self.mask >> size
        if not high:
            name, room = self.n, self.capacity
            self.n += 1
        else:
            room = size + (high & -high).bit_length() - 1
            name = self.at[room].pop()
            if not self.at[room]:
                self.mask &= ~(1 << room)
        self.add(room - size, name)
        return name


def best_fit(sizes: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins, out = Bins(capacity), np.zeros(len(sizes), np.int64)
    for k, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        out[k] = bins.fit(size)
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and the bounds that count pieces too large to share a sequence."""
    if not len(sizes):
        return 0
    best = -(-int(sizes.sum()) // capacity)
    count = np.bincount(sizes, minlength=capacity + 1)
    volume = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    n = len(sizes)
    big = n - number[capacity // 2]
    for k in range(0, capacity // 2 + 1, 8):
        alone = n - number[capacity - k]  # above capacity - k: no piece of at least k fits beside them
        half = big - alone
        small = (volume[capacity // 2] - volume[k - 1 if k else 0]) if k else volume[capacity // 2]
        room = half * capacity - (volume[capacity - k] - volume[capacity // 2])
        best = max(best, int(alone + half + max(0, -(-int(small - room) // capacity))))
    return best


def fitness(group: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[int, float]:
    fill = np.bincount(group, weights=sizes)
    fill = fill[fill > 0] / capacity
    return -len(fill), float((fill**4).sum())


class Lost:
    """Displaced pieces by size; the largest of at most a size, and the largest sum of two, are found in bit sets."""

    def __init__(self, pieces: list[int], sizes: list[int]):
        self.at: dict[int, list[int]] = {}
        self.mask, self.top = 0, max(sizes, default=0)
        #: The mask from above (size s at top - s), and all sums of two that there may be: some may be gone by now.
        self.back, self.sums = 0, 0
        for p, size in zip(pieces, sizes, strict=True):
            self.put(p, size)

    def put(self, piece: int, size: int) -> None:
        held = self.at.setdefault(size, [])
        held.append(piece)
        if len(held) == 1:
            if size > self.top:
                self.back <<= size - self.top
                self.top = size
            self.mask |= 1 << size
            self.back |= 1 << (self.top - size)
            self.sums |= self.mask << size
        elif len(held) == 2:
            self.sums |= 1 << 2 * size

    def take(self, size: int) -> int:
        piece = self.at[size].pop()
        if not self.at[size]:
            self.mask &= ~(1 << size)
            self.back &= ~(1 << (self.top - size))
        return piece

    def upto(self, most: int) -> int:
        """The largest size held of at most `most`; 0 if there is none."""
        return max((self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1, 0)

    def two_upto(self, most: int) -> int:
        """The largest sum of two pieces held of at most `most`; 0 if there is none."""
        while True:
            both = (self.sums & ((1 << (most + 1)) - 1)).bit_length() - 1
            if both < 0:
                return 0
            if self.halves(both):
                return both
            self.sums ^= 1 << both

    def halves(self, both: int) -> tuple[int, int] | None:
        """Two sizes held that make the sum."""
        found = self.mask & (self.back >> (self.top - both) if both <= self.top else self.back << (both - self.top))
        if not both % 2 and found >> both // 2 & 1 and len(self.at[both // 2]) < 2:
            found ^= 1 << both // 2
        size = (found & -found).bit_length() - 1
        return (size, both - size) if found else None


def replace(child: np.ndarray, sizes: np.ndarray, left: np.ndarray, lost: Lost, rng: np.random.Generator) -> None:
    """Puts displaced pieces in the place of one or two smaller ones where they fill a sequence better, in a pass over all
    sequences with room and all sizes in them. Works on child, left and lost in place."""
    open_ = rng.permutation(np.flatnonzero(left > 0)).tolist()
    if not open_ or not lost.mask:
        return
    order = np.argsort(child, kind="stable")
    placed = child[order]
    first, last = np.searchsorted(placed, open_), np.searchsorted(placed, open_, "right")
    for k, i, j in zip(open_, first.tolist(), last.tolist(), strict=True):
        room, held = int(left[k]), order[i:j]
        # pieces of one size are alike: one of each size is tried, and two where there are two
        here: dict[int, list[int]] = {}
        for p, size in zip(held.tolist(), sizes[held].tolist(), strict=True):
            here.setdefault(size, []).append(p)
        kinds = list(here)
        gain, out, into, pair = 0, (), 0, False
        for n, x in enumerate(kinds):
            d = lost.upto(x + room)
            if d - x > gain:
                gain, out, into, pair = d - x, (x,), d, False
            for y in kinds[: n + (len(here[x]) > 1)]:
                both = x + y
                d = lost.upto(both + room)
                if d - both > gain:
                    gain, out, into, pair = d - both, (x, y), d, False
                if gain < room:
                    d = lost.two_upto(both + room)
                    if d - both > gain:
                        gain, out, into, pair = d - both, (x, y), d, True
            if gain == room:
                break
        if gain:
            for d in lost.halves(into) if pair else (into,):
                child[lost.take(d)] = k
            for x in out:
                p = here[x].pop()
                child[p] = -1
                lost.put(p, x)
            left[k] = room - gain


def crossover(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """a with well-filled sequences of b."""
    fill = np.bincount(b, weights=sizes)
    good = np.flatnonzero(fill >= np.quantile(fill[fill > 0], 0.5))
    give = np.zeros(len(fill), bool)
    give[good[rng.random(len(good)) < rng.uniform(0.1, 0.7)]] = True
    injected = give[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    # sequences with room are opened too: their pieces find better places beside the displaced ones
    poor = np.bincount(a, weights=sizes, minlength=len(hit)) < capacity
    out_of = hit | (poor & (rng.random(len(poor)) < rng.uniform(0, 0.5)))
    displaced = out_of[a] & ~injected
    child = np.where(injected, b + a.max() + 1, a)
    stay = ~displaced
    names, child[stay] = np.unique(child[stay], return_inverse=True)
    child[displaced] = -1
    left = capacity - np.bincount(child[stay], weights=sizes[stay], minlength=len(names)).astype(np.int64)
    gone = np.flatnonzero(displaced).tolist()
    lost = Lost(gone, sizes[gone].tolist())
    replace(child, sizes, left, lost, rng)
    bins = Bins(capacity)
    bins.n = len(names)
    for k in np.flatnonzero(left > 0).tolist():
        bins.add(int(left[k]), k)
    gone = np.flatnonzero(child < 0)
    gone = gone[np.argsort(-(sizes[gone] + rng.integers(0, 3, len(gone))), kind="stable")]
    for k, size in zip(gone.tolist(), sizes[gone].tolist(), strict=True):
        child[k] = bins.fit(size)
    return child


def evolve(sizes: np.ndarray, start: list[np.ndarray], capacity: int, rng: np.random.Generator, generations: int, population: int, bound: int) -> np.ndarray:
    """The best packing that crossovers of the pool make; start: packings of the pieces, the best one first, which stays if it is at the bound."""
    if -fitness(start[0], sizes, capacity)[0] <= bound:
        return start[0]
    pool = list(start)[:population]
    while len(pool) < population:
        noisy = np.argsort(-(sizes + rng.integers(0, 1 + capacity // int(rng.integers(4, 65)), len(sizes))), kind="stable")
        pool.append(best_fit(sizes, noisy, capacity))
    score = [fitness(g, sizes, capacity) for g in pool]
    for _ in range(generations):
        if -max(score)[0] <= bound:
            break
        i, j = rng.choice(len(pool), 2, replace=False)
        if score[j] > score[i] and rng.random() < 0.7:
            i, j = j, i
        child = crossover(pool[i], pool[j], sizes, capacity, rng)
        got = fitness(child, sizes, capacity)
        worst = min(range(len(pool)), key=score.__getitem__)
        if got > score[worst] and got not in score:
            pool[worst], score[worst] = child, got
    return pool[max(range(len(pool)), key=score.__getitem__)]


def improve(sizes: np.ndarray, start: list[np.ndarray], capacity: int, seed: int, bound: int, core: int = CORE, generations: int = GENERATIONS, population: int = POPULATION) -> np.ndarray:
    """The first of the packings, evolved against the others core by core, until each of its sequences has been in a core or it is at the bound.

    A core takes sequences that were in none yet, those with room first, the others by chance, and of those that were in one, those
    with room, up to half of its pieces: what room a core couldn't use meets the next one's pieces. A core whose
    sequences are as few as its lower bound is done."""
    rng = np.random.default_rng(seed)
    base = np.unique(start[0], return_inverse=True)[1]
    seen = np.zeros(len(sizes), bool)
    while not seen.all():
        fill, count = np.bincount(base, weights=sizes), np.bincount(base)
        if len(fill) <= bound:
            break
        chance, room = rng.random(len(fill)), fill < capacity
        new = np.zeros(len(fill), bool)
        new[base[~seen]] = True
        again = np.flatnonzero(~new & room)
        again = again[np.argsort(chance[again])]
        again = again[np.cumsum(count[again]) <= core // 2]
        fresh = np.flatnonzero(new)
        fresh = fresh[np.lexsort((chance[fresh], ~room[fresh]))]
        some = np.cumsum(count[fresh]) <= core - count[again].sum()
        some[0] = True
        within = np.isin(base, np.concatenate([again, fresh[some]]))
        base = _evolve_core(sizes, [base, *start[1:]], within, capacity, rng, bound, core, generations, population)
        seen |= within
    return base


def _evolve_core(sizes: np.ndarray, start: list[np.ndarray], within: np.ndarray, capacity: int, rng: np.random.Generator, bound: int, core: int, generations: int, population: int) -> np.ndarray:
    """The first of the packings, whose sequences lie within or without, those within evolved against the others' part of these pieces."""
    base, part = start[0], sizes[within]
    if len(part) < 2:
        return base
    bins = base.max() + 1
    turns = int(np.clip(generations * core // len(part), generations, MOST_GENERATIONS))
    parents = [np.unique(g[within], return_inverse=True)[1] for g in start]
    least = parents[0].max() + 1 - (bins - bound)
    best = evolve(part, parents, capacity, rng, turns, population, max(lower_bound(part, capacity), least))
    if fitness(best, part, capacity) <= fitness(parents[0], part, capacity):
        return base
    out = base.copy()
    out[within] = best + bins
    return np.unique(out, return_inverse=True)[1]


def _packed(group: np.ndarray) -> bytes:
    return zlib.compress(group.astype("<i4").tobytes(), 1)


def _unpacked(genome: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(genome), dtype="<i4").astype(np.int64)


def _sorted(items: pd.DataFrame) -> pd.DataFrame:
    """The order that genomes speak of; rows equal in all of it are interchangeable."""
    return items.sort_values(["length", "number"], ascending=[False, True], kind="stable", ignore_index=True)


def _laid(rows: pd.DataFrame, group: np.ndarray, shard: int, capacity: int) -> pd.DataFrame:
    """Rows of PLACED; group: the sequence of each row in its shard, named from 0."""
    order = np.argsort(group, kind="stable")
    size = rows["length"].to_numpy()[order]
    before = np.cumsum(size) - size
    first = np.searchsorted(group[order], group[order], "left")
    offset = np.empty(len(rows), np.int64)
    offset[order] = before - before[first]
    room = capacity - np.bincount(group, weights=rows["length"]).astype(np.int64)
    return rows[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(shard << 32) + group, offset=offset, room=room[group])


STATE = "shard long, island int, bins long, bound long, fit double, genome binary"


def pack(items: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, islands: int = ISLANDS, epochs: int = EPOCHS, **evolution) -> DataFrame:
    """Rows of PIECE with sequence_id and offset; items: rows of NUMBERED, materialised by the caller (they are read several times)."""
    short = items.where(F.col("length") < capacity)
    full = items.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).drop("number")
    shards = max(1, -(-short.count() // shard_pieces))
    short = short.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "number"), F.lit(shards)))

    def state(shard: int, island: int, group: np.ndarray, sizes: np.ndarray, bound: int) -> pd.DataFrame:
        used, fit = fitness(group, sizes, capacity)
        return pd.DataFrame({"shard": [shard], "island": [island], "bins": [-used], "bound": [bound], "fit": [fit], "genome": [_packed(group)]})

    def begin(key, pdf):
        sizes = np.sort(pdf["length"].to_numpy())[::-1].astype(np.int64)
        return state(key[0], 0, best_fit(sizes, np.arange(len(sizes)), capacity), sizes, lower_bound(sizes, capacity))

    def live(epoch: int):
        def step(key, left, right):
            shard, island = key
            sizes = np.sort(left["length"].to_numpy())[::-1].astype(np.int64)
            bound = int(right["bound"].iloc[0])
            start = [_unpacked(g) for g in right.sort_values(["bins", "fit"], ascending=[True, False])["genome"]]
            seed = hash((int(shard), int(island), epoch)) & 0xFFFFFFFF
            return state(shard, island, improve(sizes, start, capacity, seed, bound, **evolution), sizes, bound)

        return step

    best = materialise(short.select("shard", "length").groupBy("shard").applyInPandas(begin, STATE), "pack-start")
    open_ = best.where("bins > bound")
    if epochs and not open_.isEmpty():
        work = short.join(open_.select("shard"), "shard", "left_semi").select("shard", "length").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        here = open_.drop("island").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).select("shard", "island", "bins", "bound", "fit", "genome")
        for epoch in range(epochs):
            evolved = work.groupBy("shard", "island").cogroup(here.groupBy("shard", "island")).applyInPandas(live(epoch), STATE)
            evolved = materialise(evolved, "pack-islands")
            best = best.unionByName(evolved)
            # the elite of each island goes to the next; it keeps its own as well
            moved = evolved.withColumn("island", (F.col("island") + 1) % islands)
            here = evolved.unionByName(moved)
            done = evolved.groupBy("shard").agg(F.min(F.col("bins") - F.col("bound")).alias("gap")).where("gap > 0").select("shard")
            here, work = here.join(done, "shard", "left_semi"), work.join(done, "shard", "left_semi")
            if epoch + 1 < epochs and done.isEmpty():
                break
    chosen = best.groupBy("shard").agg(F.max_by("genome", F.struct(-F.col("bins"), "fit")).alias("genome"))

    def place(key, left, right):
        return _laid(_sorted(left), _unpacked(right["genome"].iloc[0]), int(key[0]), capacity)

    placed = short.groupBy("shard").cogroup(chosen.groupBy("shard")).applyInPandas(place, PLACED)
    if shards > 1:
        placed = across(materialise(placed, "pack-placed"), shards, capacity, shard_pieces, **evolution)
    return placed.drop("room").unionByName(full)


def across(placed: DataFrame, shards: int, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES, **evolution) -> DataFrame:
    """Rows of PLACED, of as many sequences or fewer; placed: the same by shards 0 to `shards` - 1, whose pieces haven't met, materialised.

    Full sequences stay as they are; the others go on from round to round, until they are as few as their volume allows, too."""

    def meet(key, rows):
        # the place is another one for each row, so that a task run again has the same order
        rows = rows.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True], ignore_index=True)
        sizes = rows["length"].to_numpy().astype(np.int64)
        start = [np.unique(rows["sequence_id"].to_numpy(), return_inverse=True)[1], best_fit(sizes, np.arange(len(sizes)), capacity)]
        start.sort(key=lambda g: fitness(g, sizes, capacity), reverse=True)
        seed = hash((int(key[0]), len(sizes))) & 0xFFFFFFFF
        return _laid(rows, improve(sizes, start, capacity, seed, lower_bound(sizes, capacity), **evolution), int(key[0]), capacity)

    full, open_, named = [], placed, shards
    while shards > 1:
        full.append(open_.where("room = 0"))
        open_ = open_.where("room > 0")
        held = open_.agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("used"), F.coalesce(F.sum("length"), F.lit(0)).alias("volume")).first()
        if held["used"] <= -(-held["volume"] // capacity):
            break
        shards = -(-held["n"] // shard_pieces)
        # names of shards go on, so that no sequence has the name of another
        dealt = open_.withColumn("shard", F.pmod(F.xxhash64("sequence_id"), F.lit(shards)) + F.lit(named))
        open_ = materialise(dealt.groupBy("shard").applyInPandas(meet, PLACED), "pack-across")
        named += shards
        if open_.where("offset = 0").count() == held["used"]:
            break
    for rows in full:
        open_ = open_.unionByName(rows)
    return open_


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row."""
    return pack(materialise(pieces(docs, path or default_path("byte_bpe_50k.json"), end_id, capacity), "pack-pieces"), capacity, **options)


def op2_grouping_genetic_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
