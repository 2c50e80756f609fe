"""Weighted composites, z-scores, statistics across groups and leaderboards, as columns and group aggregates.

Statistics of a group are aggregated with partial sums before the shuffle and joined back by group, so that a large group is
never sorted or gathered in one task. A null group is a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.rounding import exact_round

# Weights of the summary profiles; redundancy counts against, as does what is left of the source's length.
_SUMMARY = ("rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu", "chrf", "tfidf_cosine", "coverage", "compression_ratio", "lexical_diversity", "information_density", "redundancy", "prompt_adherence")
SUMMARY_PROFILES = {
    "balanced": dict(zip(_SUMMARY, (0.15, 0.10, 0.10, 0.05, 0.05, 0.10, 0.10, 0.05, 0.05, 0.05, -0.05, 0.15), strict=True)),
    "coverage_heavy": dict(zip(_SUMMARY, (0.10, 0.05, 0.05, 0.05, 0.10, 0.15, 0.25, 0, 0.05, 0.05, -0.05, 0.15), strict=True)),
    "conciseness_heavy": dict(zip(_SUMMARY, (0.10, 0.10, 0.10, 0.05, 0.05, 0.05, 0.05, 0.15, 0.10, 0.10, -0.10, 0.10), strict=True)),
}
# Weights of the translation profiles; error rates count against.
_TRANSLATION = ("bleu_4", "rouge_1_f1", "rouge_l_f1", "chrf", "tfidf_cosine", "jaccard", "content_word_overlap", "bigram_overlap", "wer", "cer", "length_score")
TRANSLATION_PROFILES = {
    "balanced": dict(zip(_TRANSLATION, (0.10, 0.08, 0.10, 0.10, 0.12, 0.08, 0.08, 0.08, 0.13, 0.07, 0.06), strict=True)),
    "meaning_heavy": dict(zip(_TRANSLATION, (0.18, 0.10, 0.15, 0.15, 0.12, 0.10, 0.10, 0.06, 0.02, 0.01, 0.01), strict=True)),
    "fluency_heavy": dict(zip(_TRANSLATION, (0.05, 0.04, 0.05, 0.06, 0.06, 0.05, 0.05, 0.04, 0.35, 0.15, 0.10), strict=True)),
}
SUMMARY_METRICS = ("rouge1_f1", "rouge2_f1", "rougeL_f1", "bleu", "chrf", "tfidf_cosine", "jaccard", "content_word_overlap", "bigram_overlap", "compression_ratio", "coverage", "redundancy", "sentence_overlap", "lexical_diversity", "information_density", "novel_bigram_ratio", "abstractivity")
TRANSLATION_METRICS = _TRANSLATION


def _sum(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def inverted(name: str) -> Column:
    """1 - value, for values above 1 as for 1."""
    return 1 - F.least(F.col(name), F.lit(1.0))


def composite(weights: dict[str, float], turned: Iterable[str] = ()) -> Column:
    """Sum of weight x value over the sum of |weight|, of the values that are there; those of `turned` are inverted."""
    turned = set(turned)
    value = {k: inverted(k) if k in turned else F.col(k) for k in weights}
    top = _sum(F.coalesce(value[k] * float(w), F.lit(0.0)) for k, w in weights.items())
    under = _sum(F.when(F.col(k).isNotNull(), abs(float(w))).otherwise(0.0) for k, w in weights.items())
    return F.when(under > 0, top / under).otherwise(0.0)


def summary_composite(profile: str = "balanced", weights: dict[str, float] | None = None) -> Column:
    """Over the summary measures and prompt_adherence, rounded; redundancy is inverted and weighs negatively, as defined."""
    return exact_round(composite(weights or SUMMARY_PROFILES[profile], ("compression_ratio", "redundancy")), 4)


def translation_composite(profile: str = "balanced", weights: dict[str, float] | None = None) -> Column:
    return exact_round(composite(weights or TRANSLATION_PROFILES.get(profile, TRANSLATION_PROFILES["balanced"]), ("wer", "cer")), 4)


def zscores(df: DataFrame, group: str | None, value: str, name: str = "z", places: int | None = None, rounded_stats: int | None = None, missing: float | None = None) -> DataFrame:
    """df with (value - mean) / population deviation within its group, or within all rows; 0 for groups of one value or without spread.

    rounded_stats: mean and deviation are rounded to so many places first. missing: the z of a missing value (else null)."""
    given = F.col(group) if group else F.lit(1)
    stats = df.groupBy(given.alias("_g")).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"), F.count(value).alias("_n"))
    if rounded_stats is not None:
        stats = stats.select("_g", "_n", *[exact_round(F.col(c), rounded_stats).alias(c) for c in ("_mean", "_std")])
    z = F.when((F.col("_n") > 1) & (F.col("_std") > 1e-12), (F.col(value) - F.col("_mean")) / F.col("_std")).otherwise(0.0)
    if places is not None:
        z = exact_round(z, places)
    absent = F.lit(missing).cast("double")
    out = df.join(stats, (df[group] if group else F.lit(1)).eqNullSafe(F.col("_g")), "left")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), z).otherwise(absent)).drop("_g", "_mean", "_std", "_n")


def unpivot(df: DataFrame, keys: Iterable[str], metrics: Iterable[str]) -> DataFrame:
    """keys, metric, value: one row for each metric of a row."""
    return df.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")


def group_stats(df: DataFrame, group, value: str, median: bool = False, places: int | None = None) -> DataFrame:
    """n, mean, std (population), low, high, spread (and median) of a value by group (a name or names); nulls don't count."""
    v, groups = F.col(value), [group] if isinstance(group, str) else list(group)
    found = [F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("spread")]
    found += [F.median(v).alias("median")] if median else []
    out = df.groupBy(*groups).agg(F.count(v).alias("n"), *found)
    if places is None:
        return out
    return out.select(*groups, "n", *[exact_round(F.col(c), places).alias(c) for c in out.columns[len(groups) + 1 :]])


def leaderboard(df: DataFrame, group: str, by: str, score: str) -> DataFrame:
    """group, by, score (mean), rank: position by mean score, ties by name; only the means are sorted."""
    means = df.groupBy(group, by).agg(F.avg(score).alias("score"))
    return means.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.round("score", 9).desc(), F.col(by).asc_nulls_last())))


def ranked(df: DataFrame, batch: str, score: str, order: str) -> DataFrame:
    """df with rank: the place in its batch by score, a missing one counting 0, equal scores in the order given.

    A batch is one request's submissions; only it is sorted."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(batch).orderBy(F.coalesce(F.col(score), F.lit(0.0)).desc(), order)))


def band(score: str) -> Column:
    """Bands of a score of 0 to 100."""
    return F.when(F.col(score) >= 75, "high").when(F.col(score) >= 50, "mid").when(F.col(score).isNotNull(), "low")
