"""Queries of the engine on the driver's tables; their SQL is in plans.sql."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.rounding import exact_round
from ..operators import analytics, constraints, faithfulness, pairs, writing
from ..sources.tables import parquet, turn_pairs
from . import sql

KEYS = ["conv_id", "turn"]
WEIGHTS = {"ttr": 0.6, "redundancy": -0.4}


def _documents(spark, sf: str) -> DataFrame:
    return parquet(spark, sf, "documents").select("doc_id", "text")


def token_stats(spark, sf: str) -> DataFrame:
    words = parquet(spark, sf, "documents").select("doc_id", "lang", "source", T.tokens(F.col("text")).alias("w"))
    grams = words.select("doc_id", "lang", "source", "w", T.ngrams(F.col("w"), 3).alias("g"))
    return grams.select(
        "doc_id", "lang", "source", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), T.diversity(F.col("w")).alias("ttr"), T.repeated_share(F.col("g")).alias("redundancy")
    )


def _scored(spark, sf: str) -> DataFrame:
    return token_stats(spark, sf).withColumn("score", analytics.composite(WEIGHTS))


def composite_balanced(spark, sf: str) -> DataFrame:
    return _scored(spark, sf).select("doc_id", "score")


def zscore_by_lang(spark, sf: str) -> DataFrame:
    # scored once: the statistics and the rows read the same narrow rows
    return analytics.zscores(_scored(spark, sf).select("doc_id", "lang", "score").persist(), "lang", "score")


def stats_by_lang(spark, sf: str) -> DataFrame:
    return analytics.group_stats(_scored(spark, sf), "lang", "score", median=True)


def leaderboard(spark, sf: str) -> DataFrame:
    return analytics.leaderboard(_scored(spark, sf), "lang", "source", "score")


def word_facts(spark, sf: str) -> DataFrame:
    return writing.word_facts(_documents(spark, sf), ["doc_id"])


def readability(spark, sf: str) -> DataFrame:
    return writing.readability(word_facts(spark, sf), ["doc_id"])


def lexical_richness(spark, sf: str) -> DataFrame:
    return writing.lexis(word_facts(spark, sf), ["doc_id"])


def structure(spark, sf: str) -> DataFrame:
    return writing.structure(_documents(spark, sf), ["doc_id"])


def tone(spark, sf: str) -> DataFrame:
    return writing.tone(_documents(spark, sf), ["doc_id"])


def repetition(spark, sf: str) -> DataFrame:
    return writing.repetition(_documents(spark, sf), ["doc_id"])


def coherence(spark, sf: str) -> DataFrame:
    return writing.coherence(writing.links(_documents(spark, sf), ["doc_id"]), ["doc_id"])


def sentence_repetition(spark, sf: str) -> DataFrame:
    return writing.sentence_repetition(writing.links(_documents(spark, sf), ["doc_id"]), ["doc_id"])


def _measured(spark, sf: str, measure) -> DataFrame:
    return pairs.measure_pairs(turn_pairs(spark, sf), "answer", "prompt", KEYS, measure)


def pair_sets(spark, sf: str) -> DataFrame:
    words = turn_pairs(spark, sf).select(*KEYS, T.tokens(F.col("answer")).alias("h"), T.tokens(F.col("prompt")).alias("r"))
    h, r = F.col("h"), F.col("r")
    grams = words.select(*KEYS, "h", "r", T.ngrams(h, 2).alias("h2"), T.ngrams(r, 2).alias("r2"))
    found = {"jaccard": T.jaccard(h, r), "bigram_overlap": T.jaccard(F.col("h2"), F.col("r2")), "novel_bigrams": T.novelty(F.col("h2"), F.col("r2")), "compression": T.ratio(F.size(h), F.size(r))}
    return grams.select(*KEYS, *[v.alias(k) for k, v in found.items()]).select(*KEYS, *[exact_round(F.col(k), 4).alias(k) for k in found])


def pair_rouge1(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.rouge_measures(1))


def pair_rouge2(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.rouge_measures(2))


def pair_bleu_tfidf(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.bleu_measures)


def pair_chrf(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.chrf_measures)


def pair_cer(spark, sf: str) -> DataFrame:
    a, b = F.lower("answer"), F.lower("prompt")
    return turn_pairs(spark, sf).select(*KEYS, T.ratio(F.levenshtein(a, b), F.length(b)).alias("cer"))


def pair_wer_rouge_l(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.edit_measures)


def summary_measures(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.summary_measures)


def summary_overlaps(spark, sf: str) -> DataFrame:
    """The measures of summaries that SQL can state: word, n-gram and sentence sets."""
    names = "lexical_diversity information_density redundancy summary_word_count summary_sent_count jaccard content_word_overlap bigram_overlap compression_ratio coverage sentence_overlap novel_bigram_ratio abstractivity source_word_count"
    return summary_measures(spark, sf).select(*KEYS, *names.split())


def translation_measures(spark, sf: str) -> DataFrame:
    return _measured(spark, sf, pairs.translation_measures)


def translation_overlaps(spark, sf: str) -> DataFrame:
    names = "jaccard length_ratio length_score lex_div_original lex_div_backtranslation content_word_overlap bigram_overlap sentence_overlap orig_word_count bt_word_count"
    return translation_measures(spark, sf).select(*KEYS, *names.split())


def translation_board(spark, sf: str) -> DataFrame:
    """Composite by the balanced profile's set measures, and its z-score over all rows."""
    kept = ("jaccard", "content_word_overlap", "bigram_overlap", "length_score")
    weights = {k: w for k, w in analytics.TRANSLATION_PROFILES["balanced"].items() if k in kept}
    scored = translation_overlaps(spark, sf).select(*KEYS, analytics.translation_composite(weights=weights).alias("composite"))
    return analytics.zscores(scored.persist(), None, "composite", places=4, missing=0.0)


def summary_board(spark, sf: str) -> DataFrame:
    """Composites of the three profiles, with how far each answer keeps to its prompt."""
    rows = turn_pairs(spark, sf)
    asked = faithfulness.evaluate(rows, [*KEYS, "answer", "prompt"], "prompt", "answer").withColumn("prompt_adherence", F.col("prompt_faithfulness.overall_adherence"))
    measured = pairs.measure_pairs(asked, "answer", "prompt", [*KEYS, "prompt_adherence"], pairs.summary_measures)
    return measured.select(*KEYS, *[analytics.summary_composite(p).alias(p) for p in analytics.SUMMARY_PROFILES])


def prompt_faithfulness(spark, sf: str) -> DataFrame:
    return faithfulness.evaluate(turn_pairs(spark, sf), KEYS, "prompt", "answer").select(*KEYS, "prompt_faithfulness.*")


def constraint_adherence(spark, sf: str) -> DataFrame:
    return constraints.evaluate(turn_pairs(spark, sf), KEYS, "prompt", "answer").select(*KEYS, "n_constraints", "n_passed", "constraint_score")


def content(spark, sf: str) -> DataFrame:
    return writing.content(turn_pairs(spark, sf), KEYS, "prompt", None, "answer")


def writing_evaluation(spark, sf: str) -> DataFrame:
    rows = constraints.evaluate(turn_pairs(spark, sf), [*KEYS, "prompt", "answer"], "prompt", "answer")
    return writing.evaluate(rows, KEYS, "prompt", None, "answer", "constraint_score")


def queries() -> dict:
    found = [token_stats, composite_balanced, zscore_by_lang, stats_by_lang, leaderboard]
    found += [word_facts, readability, lexical_richness, structure, tone, repetition, coherence, sentence_repetition]
    found += [pair_sets, pair_rouge1, pair_rouge2, pair_bleu_tfidf, pair_chrf, pair_cer, pair_wer_rouge_l]
    found += [summary_measures, summary_overlaps, translation_measures, translation_overlaps, translation_board, summary_board]
    found += [prompt_faithfulness, constraint_adherence, content, writing_evaluation]
    return {f.__name__: f for f in found}


oracle_sql = sql.oracle_sql
