"""Mixing sources to target weights by hash-threshold histograms.

Every source gets a budget in words; a document is taken a whole number of times. The budget's whole multiples of the source's
size go to all its documents; the rest is spent on the documents whose hash is below a threshold. The threshold is found
without sorting: sizes are summed by source and hash bucket, the bucket in which the budget ends is found, and only that
one is refined, first into finer buckets, then document by document. A document too large for what is left would stop the
threshold short, so that the thresholds are nested: the remainder is spent again, twice, on the documents that fit in it.

Defined results: null text has size 0; a null source is a source of its own, the last; a source without words has target 0
and takes nothing; rows of one doc_id are taken together; further columns are ignored; an empty table gives an empty
result. The hash depends on doc_id alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WORD_RE, materialise, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
ROUNDS = 3
#: Bits of the hash; of the first buckets, and of the finer ones within the boundary bucket.
BITS, COARSE, FINE = 60, 12, 12


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), h: a 60-bit hash of doc_id."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.expr(f"cast(coalesce(regexp_count(text, r'{WORD_RE}'), 0) as long)").alias("size"),
        F.expr("cast(conv(substring(md5(cast(coalesce(cast(doc_id as string), '') as binary)), 1, 15), 16, 10) as long)").alias("h"),
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, sid, source_size, target; totals has one row per source: source, source_size.

    What a full source can't take is shared again by weight until no source is above its cap."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    t = totals.withColumn("sid", rank).withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    t = materialise(t, "mix-sources").withColumn("full", F.lit(False))
    budget = (t.agg(F.sum("source_size").alias("s")).first()["s"] or 0) * share
    level = 0.0
    while True:
        now = t.agg(F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).alias("w")).first()
        if not now["w"]:
            break
        level = (budget - now["used"]) / now["w"]
        above = F.col("w") * F.lit(level) >= F.col("cap")
        if t.where(above & ~F.col("full")).isEmpty():
            break
        t = t.withColumn("full", F.col("full") | above)
    return t.select("source", "sid", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * F.lit(level)).alias("target"))


def _boundary(rows: DataFrame, by: list[str], shift: int, bits: int) -> DataFrame:
    """The first bucket in which a source's budget ends: sid, bucket, rest (what is left before it)."""
    bucket = F.shiftright("h", shift).bitwiseAND(F.lit((1 << bits) - 1))
    hist = rows.withColumn("bucket", bucket).groupBy(*by, "rest", "bucket").agg(F.sum("size").alias("s"))
    cum = F.sum("s").over(W.partitionBy(*by).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    over = hist.withColumn("cum", cum).where("cum > rest")
    return over.groupBy(*by).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("cum") + F.col("s")).alias("left")), "bucket").alias("x")).select(*by, "x.bucket", F.col("x.left").alias("rest"))


def _thresholds(rows: DataFrame) -> DataFrame:
    """sid, cut: hashes below cut are taken. rows: sid, h, size, rest (the budget); sources whose rows all fit are left out."""
    coarse = _boundary(rows, ["sid"], BITS - COARSE, COARSE)
    inside = rows.drop("rest").withColumn("bucket", F.shiftright("h", BITS - COARSE)).join(coarse, ["sid", "bucket"])
    fine = _boundary(inside.withColumnRenamed("bucket", "b1"), ["sid", "b1"], BITS - COARSE - FINE, FINE).withColumnRenamed("bucket", "b2")
    mask = F.lit((1 << FINE) - 1)
    last = inside.drop("rest").withColumnRenamed("bucket", "b1").withColumn("b2", F.shiftright("h", BITS - COARSE - FINE).bitwiseAND(mask)).join(fine, ["sid", "b1", "b2"])
    one = last.groupBy("sid", "h", "rest").agg(F.sum("size").alias("s"))
    cum = F.sum("s").over(W.partitionBy("sid").orderBy("h").rowsBetween(W.unboundedPreceding, 0))
    return one.withColumn("cum", cum).where("cum > rest").groupBy("sid").agg(F.min("h").alias("cut"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (times the document is taken), one row for each row of docs."""
    rows = materialise(sized(docs), "mix-sizes")
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = goals.withColumn("base", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    goals = materialise(goals.withColumn("rest", F.col("target") - F.col("base") * F.col("source_size")), "mix-targets")
    mine = goals.select(F.col("source").alias("_source"), "sid", "rest")
    open_ = rows.join(mine, rows["source"].eqNullSafe(F.col("_source"))).select("sid", "h", "size", "rest")
    # the rows of a doc_id go together, as they share a hash
    cuts = None
    for k in range(rounds):
        left = open_.where("size > 0 and size <= rest")
        # written, so that its size is known and the rows, where one source may be hot, stay where they are
        cut = materialise(_thresholds(left), "mix-cut")
        fit = left.join(cut, "sid", "left").where("cut is null or h < cut").groupBy("sid").agg(F.sum("size").alias("spent"))
        budget = mine.select("sid", "rest") if cuts is None else cuts.select("sid", F.col(f"rest{k}").alias("rest"))
        now = budget.join(cut, "sid", "left").join(fit, "sid", "left")
        now = now.select("sid", F.col("rest").alias(f"r{k}"), F.coalesce("cut", F.lit(1 << BITS)).alias(f"cut{k}"), (F.col("rest") - F.coalesce("spent", F.lit(0))).alias(f"rest{k + 1}"))
        cuts = now if cuts is None else cuts.drop(f"rest{k}").join(now, "sid")
        cuts = materialise(cuts, "mix-cuts")
        if k + 1 < rounds:
            step = cuts.select("sid", F.col(f"r{k}").alias("r"), F.col(f"cut{k}").alias("cut"), F.col(f"rest{k + 1}").alias("rest"))
            open_ = open_.drop("rest").join(step, "sid").where("not (size <= r and h < cut)").select("sid", "h", "size", "rest")
    plan = goals.drop("rest").join(cuts.drop(f"rest{rounds}"), "sid").withColumnRenamed("source", "_source")
    extra = F.lit(False)
    for k in range(rounds):
        extra = extra | ((F.col("size") <= F.col(f"r{k}")) & (F.col("h") < F.col(f"cut{k}")))
    out = rows.join(plan, rows["source"].eqNullSafe(F.col("_source")))
    copies = (F.col("base") + F.when(extra & (F.col("size") > 0), 1).otherwise(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them. Rows of one doc_id share their fate."""
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias("times")).where("times > 0")
    # the documents' own columns are one struct, so that their names can't meet ours
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col("doc_id").cast("long").alias("id"))
    out = rows.join(copies, rows["id"].eqNullSafe(copies["doc_id"])).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return out.select("doc.*")


def op4_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mix_sql(documents: str = "documents", rounds: int = ROUNDS) -> str:
    """DuckDB SQL for mix(), by cumulative sums in hash order."""
    steps = []
    for k in range(rounds):
        prev = "sized" if k == 0 else f"left{k - 1}"
        steps.append(f"""
cum{k} AS (SELECT *, sum(size) OVER (PARTITION BY sid ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM {prev} WHERE size > 0 AND size <= rest),
got{k} AS (SELECT sid, h FROM cum{k} WHERE cum <= rest GROUP BY sid, h),
spent{k} AS (SELECT sid, sum(size) AS spent FROM cum{k} WHERE cum <= rest GROUP BY sid),
left{k} AS (SELECT l.sid, l.h, l.size, l.rest - coalesce(s.spent, 0) AS rest FROM {prev} l LEFT JOIN spent{k} s USING (sid) LEFT JOIN got{k} g ON l.sid = g.sid AND l.h = g.h WHERE g.h IS NULL OR l.size > l.rest)""")
    hit = " OR ".join(f"g{k}.h IS NOT NULL" for k in range(rounds))
    joins = " ".join(f"LEFT JOIN got{k} g{k} ON g{k}.sid = z.sid AND g{k}.h = z.h AND z.size <= r{k}" for k in range(rounds))
    budgets = "z0.rest AS r0" + "".join(f", z0.rest{''.join(f' - coalesce(s{i}.spent, 0)' for i in range(k))} AS r{k}" for k in range(1, rounds))
    spent = " ".join(f"LEFT JOIN spent{k} s{k} ON s{k}.sid = z0.sid" for k in range(rounds - 1))
    return f"""
WITH base AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM {documents}),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM base GROUP BY source),
wt AS (SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM tot),
water AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, (sum(source_size) OVER ()) * 1.5::DOUBLE AS budget FROM wt),
lev AS (SELECT *, (budget - used) / open_w AS level FROM water),
first_open AS (SELECT arg_min(level, cap / w) AS level FROM lev WHERE w * level < cap),
goal AS (SELECT source, sid, source_size, CASE WHEN w * (SELECT level FROM first_open) >= cap OR (SELECT level FROM first_open) IS NULL THEN cap ELSE w * (SELECT level FROM first_open) END AS target FROM wt),
goals AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS base_n FROM goal),
sized AS (SELECT g.sid, b.h, b.size, g.target - g.base_n * g.source_size AS rest FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source),{",".join(steps)},
bud AS (SELECT z0.sid, {budgets} FROM (SELECT sid, target - base_n * source_size AS rest FROM goals) z0 {spent}),
z AS (SELECT b.doc_id, b.h, b.size, g.sid, g.source_size, g.target, g.base_n, bud.* EXCLUDE (sid) FROM base b JOIN goals g ON b.source IS NOT DISTINCT FROM g.source JOIN bud ON bud.sid = g.sid)
SELECT z.doc_id, z.size, z.source_size, z.target, CAST((z.base_n + CASE WHEN z.size > 0 AND ({hit}) THEN 1 ELSE 0 END) * z.size AS BIGINT) AS taken FROM z {joins}"""
