"""Quality rules whose cutoffs come with a bound on false rejection; built-in functions only.

Each rule rejects documents whose ratio is above a cutoff. The cutoffs of all rules fall together along one scale of
strictness, `LEVELS` steps from the loosest to the strictest, so that each level rejects all that the one before rejects.
Labelled good documents are the holdout, a text that comes again counting once, as it is no further trial. In a stratum, a
level rejects k of its n good texts, and the exact binomial tail P(X <= k) at the rate `alpha` tests "more than alpha of the
good documents are rejected". Levels are tested from the loosest on and testing stops at the first that isn't valid (a fixed
sequence, which needs no correction among its levels, as the rejected sets are nested); strata are corrected for by Bonferroni:
a level is valid if its tail is at most delta / strata. The strictest valid level holds. So, with probability 1 - delta, the
rules reject at most `alpha` of the good documents in every stratum. A stratum with too few good texts (fewer than 86 at 0.05,
0.05 and four strata) has no valid level, and the base rule alone decides there. A stratum is a language; null is one of its
own.

Defined results: null text has no words and fails the base rule; rows with a null doc_id are judged and never learnt from;
repeated rows are each judged; a ratio that equals a cutoff is not above it; without labels no level is valid and the base rule
decides; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_RE, materialise, table

ALPHA, DELTA, LEVELS = 0.05, 0.05, 16
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Rules: the ratio of two counts, its loosest and its strictest cutoff.
RULES = {"symbols": ("n_symbols", "word_chars", 0.5, 0.005), "dup_lines": ("n_dup_lines", "n_lines", 0.9, 0.02), "repeats": ("n_repeat_words", "n_words", 0.3, 0.01)}


def cutoffs_of(rule: str, levels: int = LEVELS) -> list[float]:
    """Cutoffs of a rule by level, in equal steps of their logarithm."""
    loose, strict = RULES[rule][2:]
    return [float(f"{loose * (strict / loose) ** (i / (levels - 1)):.4g}") for i in range(levels)]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _tail(a: Column) -> Column:
    return F.slice(a, 2, F.greatest(F.size(a), F.lit(1)))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of words found twice or more in the array."""

    def windows(h: Column) -> Column:
        shifted = [F.slice(h, 1 + i, F.size(h) - (window - 1)) for i in range(window)]
        names = [f"`{i}`" for i in range(window)]
        return F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(*[z.getField(n.strip("`")) for n in names]))

    def spread(win: Column) -> Column:
        placed = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        both = _let(placed, lambda s: F.zip_with(s, _tail(s), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])).otherwise(F.array().cast("array<int>"))))
        at = F.array_sort(F.array_distinct(F.flatten(both)))
        gaps = _let(at, lambda p: F.zip_with(p, _tail(p), lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    counted = _let(_let(hashed, windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), spread(w)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(counted)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, digest (a hash of the text), n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = lambda c: F.translate(c, SPACES, "")
    words = F.filter(F.split(text, SPACE_RE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda s: bare(s) != "")
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    word_counts = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("r")))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.xxhash64(text).alias("digest"),
        F.length(bare(text)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        line_counts.alias("l"),
        word_counts.alias("w"),
    )
    return base.select("doc_id", "lang", "digest", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n trials at rate p, exactly: the largest term's logarithm, then the terms below it by their ratios."""
    upto = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_term = F.aggregate(upto, F.lit(0.0), lambda s, i: s + F.log((n - i + 1) / i)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    sums = F.aggregate(F.reverse(upto), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, i: _step(a, i, n, odds))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(log_term) * sums["s"])


def _step(a: Column, i: Column, n: Column, odds: float) -> Column:
    t = a["t"] * i / (n - i + 1) * odds
    return F.struct(t.alias("t"), (a["s"] + t).alias("s"))


def _ratio(rule: str) -> Column:
    over, under = RULES[rule][:2]
    return F.when(F.col(under) > 0, F.col(over) / F.col(under)).otherwise(F.lit(0.0))


def levels(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, steps: int = LEVELS) -> DataFrame:
    """stratum, n (its good texts), level (the strictest valid one, null if none) and one column cut_<rule> (null: no cutoff)."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    known = stats.join(good, "doc_id", "left_semi").dropDuplicates(["lang", "digest"])
    cuts = {r: cutoffs_of(r, steps) for r in RULES}
    rejected = lambda i: F.greatest(*[(_ratio(r) > c[i]).cast("int") for r, c in cuts.items()])
    counts = known.groupBy("lang").agg(F.count("*").alias("n"), *[F.sum(rejected(i)).cast("long").alias(f"k{i}") for i in range(steps)])
    # a few languages; the number of strata is the correction among them
    counts = counts.withColumn("allowed", F.lit(delta) / F.lit(max(1, counts.count())))
    valid = F.array(*[binomial_tail(F.col(f"k{i}"), F.col("n"), alpha) <= F.col("allowed") for i in range(steps)])
    # before the first invalid level; array_position counts from 1 and is 0 where there is none
    passed = F.when(F.array_position(valid, False) == 0, steps).otherwise(F.array_position(valid, False) - 1).cast("int")
    level = F.when(passed > 0, passed - 1)
    found = counts.select(F.col("lang").alias("stratum"), "n", level.alias("level"))
    return found.select("*", *[F.get(F.array(*[F.lit(x) for x in c]), F.col("level")).alias(f"cut_{r}") for r, c in cuts.items()])


def judge(stats: DataFrame, cuts: DataFrame) -> DataFrame:
    """stats with base_failed and kept; cuts has one row for each stratum (a few languages), and is broadcast only if small."""
    if cuts.count() <= 10_000:
        cuts = F.broadcast(cuts)
    rows = stats.join(cuts, stats["lang"].eqNullSafe(cuts["stratum"]), "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rejected = F.lit(False)
    for r in RULES:
        rejected = rejected | F.coalesce(_ratio(r) > F.col(f"cut_{r}"), F.lit(False))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def op8_risk_controlled_rules(spark, sf_dir: str) -> DataFrame:
    stats = materialise(statistics(table(spark, sf_dir, "documents")), "rule-counts")
    out = judge(stats, materialise(levels(stats, table(spark, sf_dir, "labels")), "rule-levels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _word_sql() -> str:
    return "regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')"


def rules_sql(alpha: float = ALPHA, delta: float = DELTA, steps: int = LEVELS) -> str:
    """op8's rows as DuckDB SQL."""
    bare = "regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')"
    ratio = {r: f"CASE WHEN {x[1]} > 0 THEN {x[0]} / {x[1]} ELSE 0 END" for r, x in RULES.items()}
    cut = {r: "[" + ", ".join(f"{c!r}::DOUBLE" for c in cutoffs_of(r, steps)) + "]" for r in RULES}
    over = " OR ".join(f"{ratio[r]} > {cut[r]}[i + 1]" for r in RULES)
    log = lambda x: f"ln({x!r}::DOUBLE)"
    term = f"exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * {log(alpha)} + (n - j) * {log(1 - alpha)})"
    tail = f"CASE WHEN k >= n * {alpha!r}::DOUBLE THEN 1 ELSE list_sum(list_transform(range(0, k::BIGINT + 1), lambda j: {term})) END"
    rejected = " OR ".join(f"coalesce({ratio[r]} > {cut[r]}[level + 1], false)" for r in RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_word_sql()} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
p AS (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW}),
g AS (SELECT rid, list(i) AS spots FROM p GROUP BY rid, array_to_string(words[i:i + {WINDOW - 1}], ' ') HAVING count(*) > 1),
c AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS j FROM (SELECT rid, unnest(spots) AS i FROM g)) GROUP BY rid),
s AS (SELECT doc_id, lang, text, len(words) AS n_words, length({bare}) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (rid)),
good AS (SELECT DISTINCT lang, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)),
l AS (SELECT lang, i, count(*) AS n, count(*) FILTER ({over}) AS k FROM good, range(0, {steps}) t(i) GROUP BY ALL),
v AS (SELECT lang, i, {tail} <= {delta!r}::DOUBLE / (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)) AS valid FROM l),
h AS (SELECT lang, coalesce(min(i) FILTER (NOT valid), {steps}) - 1 AS level FROM v GROUP BY lang),
j AS (SELECT s.*, CASE WHEN level >= 0 THEN level END AS level, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM s LEFT JOIN h ON s.lang IS NOT DISTINCT FROM h.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({rejected}) AS kept FROM j"""
