"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

Each element (a distinct run of five words, weight 1, or weighted by its count) owns the region [0, weight) x [0, inf)
of a plane on which darts fall as a Poisson process of rate one, seeded by the element's hash alone: two documents that
hold the element see the same darts. A dart belongs to one of k coordinates; the earliest dart in each coordinate is
the document's signature there. Darts are made only as far as needed: about k ln k + 2k for a document, whatever its
length, and further only for documents that still have an empty coordinate. P(two signatures agree in a coordinate) is
the (weighted) Jaccard similarity.

Copies of one text are joined by a 128-bit hash of the whole text first; one of each goes on. Documents that share a
band of the signature are candidates. Within a bucket everyone is compared with one centre (and, in a second round,
another), which is linear in the bucket. Members of buckets that still hold different components are then compared by exact
prefix filtering of their shingle sets: they meet only on shingles that few of them hold. Each pair is verified on its whole shingle sets, and classes are the connected components of verified links.

Defined results: null, empty or word-free texts are in a class of their own each; a text of one to four words has one
shingle, all its words; repeated rows of a doc_id are one document; a null doc_id gives no row (near_dedup keeps such rows: see there); ties go to the smallest doc_id;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, chunks, list_array, materialise, mix, shingles, spans, unique_by_doc, utf8

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
SALTS = 16
#: Rows of one key from which it is salted, and the most keys that may be (a larger table raises the first to keep to the second).
HOT, MOST_HOT = 20_000, 5_000
#: Centres of a group of buckets in the first round, and in the second, which only those take part in that the first left apart.
CENTRES = (3, 8)
#: Identifiers that may be broadcast (8 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
_NEXT = np.uint64(0xD1342543DE82EF95)


def dart_signatures(h: np.ndarray, counts: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(documents, k) ranks of the earliest darts; h: distinct elements by document. Documents without elements: inf."""
    n = len(counts)
    sig = np.full((n, k), np.inf)
    flat = sig.reshape(-1)
    doc = np.repeat(np.arange(n), counts)
    if weights is None:
        cell_h, cell_doc, room = h, doc, None
        total = counts.astype(float)
    else:
        cells = np.ceil(weights).astype(np.int64)
        cell_doc = np.repeat(doc, cells)
        nth = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        cell_h = mix(np.repeat(h, cells) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        room = np.repeat(weights, cells) - nth
        total = np.bincount(doc, weights=weights, minlength=n)
    want = k * np.log(k) + 2 * k
    reach = np.where(total > 0, want / np.maximum(total, 1e-12), 0)
    state = mix(cell_h ^ np.uint64(0x5851F42D4C957F2D))
    time = -np.log1p(-_unit(state))
    live = np.arange(len(cell_h))
    while len(live):
        # live darts are the next ones of their cells; those within reach are thrown, the others wait
        inside = time < reach[cell_doc[live]]
        waiting, waiting_state, waiting_time = live[~inside], state[~inside], time[~inside]
        held = [(waiting, waiting_state, waiting_time)]
        live, state, time = live[inside], state[inside], time[inside]
        while len(live):
            coord = (mix(state + np.uint64(1)) >> np.uint64(33)) % np.uint64(k)
            slot = cell_doc[live] * k + coord.astype(np.int64)
            if room is None:
                np.minimum.at(flat, slot, time)
            else:
                ok = _unit(mix(state + np.uint64(2))) < room[live]
                np.minimum.at(flat, slot[ok], time[ok])
            state = mix(state + _NEXT)
            time = time - np.log1p(-_unit(state))
            inside = time < reach[cell_doc[live]]
            held.append((live[~inside], state[~inside], time[~inside]))
            live, state, time = live[inside], state[inside], time[inside]
        short = np.isinf(sig).any(axis=1) & (total > 0)
        if not short.any():
            break
        reach = np.where(short, reach * 2, 0)
        live, state, time = (np.concatenate(x) for x in zip(*held, strict=True))
        on = short[cell_doc[live]]
        live, state, time = live[on], state[on], time[on]
    return sig


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    out = np.zeros((len(sig), bands), dtype=np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return out


def _sets(texts, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, off = utf8(texts)
    for i, j in chunks(off):
        b, local = buf[off[i] : off[j]], off[i : j + 1] - off[i]
        st, en, counts = spans(b, local)
        sh, made = shingles(Rolling(b).of(st, en), counts, words)
        yield i, j, *unique_by_doc(sh, made)


def _signer(words: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for i, j, h, counts in _sets(batch.column(1), words):
                sig = band_hashes(dart_signatures(h, counts, bands * rows), bands, rows)
                full = counts > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(counts, pa.int64()), list_array(sig[full].reshape(-1).view(np.int64), full * bands, pa.int64())],
                    names=["doc_id", "digest", "n_sh", "bands"],
                )

    return run


def _shingler(words: int):
    def run(batches):
        for batch in batches:
            for i, j, h, counts in _sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), list_array(h.view(np.int64), counts, pa.int64())], names=["id", "sh"])

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (its smallest doc_id), class_size, kept (doc_id = class_id)."""
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = src.withColumn("digest", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).mapInArrow(_signer(words, bands, rows), "doc_id long, digest string, n_sh long, bands array<long>")
    signed = materialise(signed, "dart-signatures")

    # copies of one text: one of them, the first, goes on
    solid = signed.where("n_sh > 0")
    exact = materialise(solid.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.max("n_sh").alias("n_sh"), F.count("*").alias("n"), F.min_by("bands", "doc_id").alias("bands")), "dart-texts")
    buckets = materialise(
        exact.select("rep", "n_sh", F.posexplode("bands").alias("band", "h")).select("rep", "n_sh", F.xxhash64("band", "h").alias("h")),
        "dart-buckets",
    )
    shared = buckets.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(_salted_join(buckets, shared, "h", "rep", "left_semi", buckets.count()), "dart-shared")
    if members.isEmpty():
        return _classes(signed, exact, None)

    # the shingle sets of the documents that share a bucket; the texts are read again, nothing is kept of the others
    ids = materialise(members.select(F.col("rep").alias("doc_id")).distinct(), "dart-ids")
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    sets = materialise(src.join(ids, "doc_id", "left_semi").mapInArrow(_shingler(words), "id long, sh array<long>").dropDuplicates(["id"]), "dart-sets")

    links, labels = None, None
    for turn in range(3):
        if turn < 2:
            pairs = _star_pairs(members, labels, turn, similarity)
        else:
            pairs = _rest_pairs(members, labels, sets, similarity)
        found = materialise(_verify(pairs, sets, similarity), "dart-links")
        links = found if links is None else links.unionByName(found)
        labels = components(links)
        # buckets whose members are all in one component are done
        open_ = _labelled(members, labels).groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
        members = materialise(_salted_join(members.select("rep", "n_sh", "h"), open_, "h", "rep", "left_semi", members.count()), "dart-open")
        if turn == 2 or members.isEmpty():
            break
    return _classes(signed, exact, labels)


def _salted_join(left: DataFrame, right: DataFrame, key: str, salt_by: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """left join right on key, where one key may hold most of left's rows.

    right has one row for each key. With `rows` (of left), it also has the key's number of rows in left, n, and only keys of many
    rows are salted: at most MOST_HOT, whose names are broadcast. Without, right's rows are repeated for each salt."""
    salt = F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int")
    spread = F.sequence(F.lit(0), F.lit(SALTS - 1))
    if rows is None:
        salted = right.withColumn("_salt", F.explode(spread))
        return left.withColumn("_salt", salt).join(salted, [key, "_salt"], how).drop("_salt")
    hot = F.col("n") > max(HOT, rows // MOST_HOT)
    salted = right.withColumn("_salt", F.explode(F.when(hot, spread).otherwise(F.array(F.lit(0)))))
    names = F.broadcast(right.where(hot).select(key, F.lit(True).alias("_hot")))
    marked = left.join(names, key, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    return marked.join(salted if how == "left_semi" else salted.drop("n"), [key, "_salt"], how).drop("_salt")


def _labelled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return members.withColumn("c", F.col("rep"))
    return members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").withColumn("c", F.coalesce("label", "rep")).drop("label")


def _near_size(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)


def _star_pairs(members: DataFrame, labels: DataFrame | None, turn: int, similarity: float) -> DataFrame:
    """Each member of a bucket with the bucket's centre, unless they are in one component.

    Buckets of the same documents have up to CENTRES[turn] different centres, so that a group of near copies is met from many sides."""
    m = _labelled(members, labels)
    centre = m.groupBy("h").agg(F.min_by(F.struct("rep", "n_sh", "c"), F.xxhash64("rep", F.pmod("h", F.lit(CENTRES[turn])), F.lit(turn))).alias("x"), F.count("*").alias("n"))
    pairs = _salted_join(m, centre, "h", "rep", rows=members.count()).where("c <> x.c").select(F.least("rep", "x.rep").alias("a"), F.greatest("rep", "x.rep").alias("b"), "n_sh", F.col("x.n_sh").alias("m_sh"))
    return pairs.where(_near_size("n_sh", "m_sh", similarity)).select("a", "b").distinct()


def _rest_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs of members in different components that could be similar, by prefix filtering, exactly.

    Sets of n and m shingles with at least the similarity share ceil(similarity x max(n, m)) of them. With the shingles of
    each set in one global order, two such sets share one among their first n - ceil(similarity x n) + 1, at places behind
    which enough is left of both. The order is the rarest first, so that a passage that many documents share comes last, and documents
    meet only on what few others hold.
    """
    own = _labelled(members.select("rep", "n_sh").distinct(), labels)
    each = sets.join(own.select(F.col("rep").alias("id")), "id", "left_semi").select("id", F.explode("sh").alias("s"))
    each = materialise(each, "dart-rest")
    often = each.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    # a shingle that one document alone holds links nothing: it only takes up a place at the front
    known = _salted_join(each, often.withColumn("often", F.col("n")), "s", "id", rows=each.count()).withColumnRenamed("often", "n")
    prefix = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("x"))
    prefix = prefix.join(own.withColumnRenamed("rep", "id"), "id")
    # i: places behind the front of the whole set, from 0; at i, at most n_sh - i shingles can be shared
    flat = prefix.select("id", "c", "n_sh", (F.col("n_sh") - F.size("x")).alias("alone"), F.posexplode("x").alias("at", "y"))
    flat = flat.select("id", "c", "n_sh", F.col("y.s").alias("s"), (F.col("alone") + F.col("at")).alias("i"))
    front = flat.where(F.expr(f"n_sh - i >= {similarity}D * n_sh - 1e-6D"))
    front = materialise(front, "dart-front")
    mixed = front.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("s", "n")
    front = materialise(_salted_join(front, mixed, "s", "id", "left_semi", front.count()), "dart-mixed")
    # the smaller set (the smaller id, of equal sizes) brings a shorter front still: it shares this part of itself or more
    both = 2 * similarity / (1 + similarity)
    small = front.where(F.expr(f"n_sh - i >= {both}D * n_sh - 1e-6D")).select("s", F.col("id").alias("a"), "c", "n_sh", "i")
    large = front.select("s", F.col("id").alias("b"), F.col("c").alias("d"), F.col("n_sh").alias("m_sh"), F.col("i").alias("j"))
    left = F.expr(f"least(n_sh - i, m_sh - j) >= {both / 2}D * (n_sh + m_sh) - 1e-6D and c <> d and (n_sh < m_sh or (n_sh = m_sh and a < b))")
    pairs = small.join(large, "s").where(left & _near_size("n_sh", "m_sh", similarity))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
    both = left.join(sets.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("m"))
    return both.where(F.col("m") >= F.lit(similarity) * (F.col("na") + F.col("nb") - F.col("m"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """id, label (the component's smallest id) for every end of a link: labels spread over links and jump to their label's label."""
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "cc-links")
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = materialise(step.join(jump, "label", "left").select("id", "was", F.least("label", F.coalesce("far", "label")).alias("label")), "cc-labels")
        labels = step.select("id", "label")
        if step.where("label < was").isEmpty():
            return labels


def _classes(signed: DataFrame, exact: DataFrame, labels: DataFrame | None) -> DataFrame:
    reps = exact.where("n > 1").select("digest", "rep", "n")
    held = signed.count()
    rows = _salted_join(signed.where("n_sh > 0").select("doc_id", "digest"), reps, "digest", "doc_id", "left", held)
    rows = rows.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).unionByName(signed.where("n_sh = 0").select("doc_id", F.col("doc_id").alias("rep")))
    if labels is not None:
        rows = _salted_join(rows, labels.select(F.col("id").alias("rep"), "label"), "rep", "doc_id", how="left").select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    else:
        rows = rows.withColumnRenamed("rep", "class_id")
    rows = rows.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    sizes = rows.groupBy("class_id").agg(F.count("*").alias("class_size")).withColumn("n", F.col("class_size"))
    return _salted_join(rows, sizes, "class_id", "doc_id", rows=held).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The documents of which doc_id is the smallest of its class.

    Rows without a doc_id, and those of a doc_id with different texts, are judged by their texts, those without doc_id last; rows
    that repeat a doc_id and its text are one document; rows without doc_id and without words are kept each.
    """
    digest = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"))
    odd = ids.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("doc_id is null or lo < hi")
    if odd.isEmpty():
        kept = near_duplicates(docs, **options).where("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    # each pair of doc_id and text has a number, in their order; the documents' own columns are one struct
    at = lambda by: F.concat_ws("/", F.col("doc_id").cast("long").cast("string"), by).alias("at")
    order = [F.col("doc_id").asc_nulls_last(), F.col("digest")]
    pairs = ids.distinct().repartitionByRange(*order).sortWithinPartitions(*order).select(at(F.col("digest")), F.monotonically_increasing_id().alias("key"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.col("doc_id").isNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), at(digest), text.alias("text"), bare.alias("bare"), F.monotonically_increasing_id().alias("own"))
    keyed = materialise(_salted_join(keyed, materialise(pairs, "dedup-pairs"), "at", "own").drop("at"), "dedup-keyed")
    kept = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), **options).where("kept").select(F.col("doc_id").alias("key"))
    rows = _salted_join(keyed, kept, "key", "own", how="left_semi")
    return rows.withColumn("own", F.when(F.col("bare"), F.col("own"))).dropDuplicates(["key", "own"]).select("doc.*")


def classes_sql(words: int = WORDS, similarity: float = SIMILARITY) -> str:
    """near_duplicates() as DuckDB SQL: all pairs of documents that share a run of words, and paths over the similar ones."""
    runs = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END"
    return f"""WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, list_distinct({runs}) AS s FROM d), u AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE m >= {similarity!r}::DOUBLE * (na + nb - m)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, label) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.id),
c AS (SELECT id AS doc_id, min(label) AS class_id FROM r GROUP BY id)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size, doc_id = class_id AS kept FROM c"""
