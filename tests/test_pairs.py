"""Measures of pairs: plain dynamic programs, edge cases, stored scores."""

from __future__ import annotations

import json
import random
from pathlib import Path

import pytest

from scorelake.functions.sequences import common, edits
from scorelake.operators import faithfulness, pairs

GOLDEN = json.loads((Path(__file__).parent / "fixtures" / "golden.json").read_text(encoding="utf-8"))


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def _longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_sequences():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 80))] for _ in range(2))
        assert edits(a, b) == _edits(a, b) and common(a, b) == _longest(a, b)


def _rounded(found):
    return {k: round(v, 4) if isinstance(v, float) else v for k, v in found.items()}


def test_stored_translation_scores():
    g = GOLDEN["translation"]
    found = _rounded(pairs.translation_measures(g["back"], g["original"]))
    assert {k: found[k] for k in g["scores"] if k in found} == {k: v for k, v in g["scores"].items() if k in found}
    assert len(g["scores"].keys() & found.keys()) >= 18


def test_stored_summary_scores(spark):
    from pyspark.sql import functions as F

    from scorelake.operators import analytics

    g = GOLDEN["summary"]
    rows = spark.createDataFrame([(1, g["prompt"], g["source"], g["summary"]), (2, "", None, "a b")], "k int, prompt string, source string, summary string")
    got = {r["k"]: r for r in pairs.measure_pairs(rows, "summary", "source", ["k"], pairs.summary_measures).collect()}
    assert {k: got[1][k] for k in g["scores"]} == g["scores"]
    assert got[2]["no_source_warning"] and got[2]["rouge1_f1"] is None and got[2]["summary_word_count"] == 2
    assert faithfulness.signals(g["prompt"], g["summary"])["overall_adherence"] == g["adherence"]
    scored = spark.createDataFrame([got[1]]).withColumn("prompt_adherence", F.lit(g["adherence"])).select(analytics.summary_composite())
    assert 0 < scored.first()[0] < 1


def test_empty_sides(spark):
    rows = [(1, "a b a", "a a c"), (2, "", "x"), (3, "", ""), (4, None, "z"), (5, "x", "")]
    got = {r["k"]: r for r in pairs.measure_pairs(spark.createDataFrame(rows, "k int, h string, r string"), "h", "r", ["k"], pairs.translation_measures).collect()}
    assert got[1]["rouge_1_f1"] == 0.6667 and got[1]["bleu_1"] == 0.6667
    assert [got[k]["jaccard"] for k in (2, 3, 4, 5)] == [0.0, 1.0, 0.0, 0.0]
    assert [got[k]["wer"] for k in (2, 3, 4, 5)] == [1.0, 0.0, 1.0, 0.0] and got[3]["content_word_overlap"] == 1.0


def test_bleu_variants():
    pair = pairs.Pair("a b c x d", "a b c d e")
    assert pair.bleu(4, strict=True) == 0.0 and pair.bleu(4) > 0
    short = pairs.Pair("a b", "a b c")
    assert round(short.bleu(4, strict=True), 4) == round(2.718281828459045 ** (1 - 3 / 2), 4)


def test_rows_with_one_key_are_kept_apart(spark):
    rows = spark.createDataFrame([(1, "a", "a"), (1, "b", "a")], "k int, h string, r string")
    assert sorted(r["f1"] for r in pairs.measure_pairs(rows, "h", "r", ["k"], pairs.rouge_measures(1)).collect()) == [0.0, 1.0]


def test_key_sentences():
    text = "Cats sleep. Dogs bark at cats. The sun. Cats and cats."
    assert pairs.key_sentences(text, 2) == ["Cats and cats.", "Cats sleep."]
    assert pairs.key_sentences("", 3) == [] and pairs.summary_measures("x", "the of.")["wer_vs_key"] is None


@pytest.mark.parametrize(
    ("prompt", "summary", "score"),
    [
        ("Use exactly 2 bullets", "- a\n- b", 1.0),
        ("Use 4 bullets", "- a\n- b", 0.75),
        ("a numbered list", "1. a\n2) b", 1.0),
        ("at most 4 words", "a b c d e", 0.75),
        ("Write 2 sentences", "One. Two. Three.", 0.5),
        ("use sections: Intro, Body", "intro only", 0.5),
        ("with headings", "# Top\ntext", 1.0),
        ("titled: Pros, Cons", "pros and cons", 1.0),
        ("be brief", "a " * 350, 0.5),
        ("be thorough", "a " * 50, 0.5),
        ("one paragraph", "text", 1.0),
        ("do not speculate", "text", None),
    ],
)
def test_prompt_signals(prompt, summary, score):
    assert faithfulness.signals(prompt, summary)["overall_adherence"] == score
