"""Measures of prose and the constraint language: stored scores, brute force, hand-made prompts."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

import pytest

from scorelake.operators import constraints as C
from scorelake.operators import writing as W

GOLDEN = json.loads((Path(__file__).parent / "fixtures" / "golden.json").read_text(encoding="utf-8"))["writing"]


def test_stored_scores(spark):
    rows = spark.createDataFrame([(i, g["prompt"], g["text"]) for i, g in enumerate(GOLDEN)], "i int, prompt string, answer string")
    kept = C.evaluate(rows, ["i", "prompt", "answer"], "prompt", "answer")
    got = {r["i"]: r for r in W.evaluate(kept, ["i"], "prompt", None, "answer", "constraint_score").collect()}
    for i, g in enumerate(GOLDEN):
        assert {k: got[i][k] for k in g["scores"]} == g["scores"]
        parts = {k: got[i][k] for k in W.WEIGHTS}
        assert got[i]["composite_score"] == pytest.approx(sum(parts[k] * w for k, w in W.WEIGHTS.items()) / 100, abs=0.006)


def _links(sentences, stops):
    docs = [[w for w in re.findall(r"\b\w\w+\b", s.lower()) if w not in stops] for s in sentences]
    df = Counter(w for d in docs for w in set(d))
    vectors = []
    for d in docs:
        v = {w: c * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, c in Counter(d).items()}
        n = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / n for w, x in v.items()} if n else {})
    cos = lambda a, b: sum(x * b.get(w, 0) for w, x in a.items())
    near = [cos(a, b) for a, b in zip(vectors, vectors[1:], strict=False)]
    every = [cos(vectors[i], vectors[j]) for j in range(len(docs)) for i in range(j)]
    mean = sum(near) / len(near)
    return mean, min(near), sum((x - mean) ** 2 for x in near) / len(near), sum(every) / len(every), max(every)


def test_sentence_links_against_all_pairs(monkeypatch):
    sentences = ["Cats chase mice at night.", "Mice fear cats.", "Rain fell.", "Cats chase mice at night.", "the of", "Night rain."] * 3 + ["End"]
    for cells in (1 << 22, 16):
        monkeypatch.setattr(W, "_CELLS", cells)
        assert W.sentence_links(sentences, frozenset({"the", "of", "at"})) == pytest.approx(_links(sentences, {"the", "of", "at"}))
    assert W.sentence_links(["one sentence"]) == (None,) * 5 and W.sentence_links(["the", "of"]) == (None,) * 5


def test_coherence_defaults(spark):
    rows = spark.createDataFrame([(1, "One only"), (2, None), (3, "The. Of. And."), (4, "Cats sleep well. Dogs sleep well. Cats sleep well.")], "k int, text string")
    got = {r["k"]: r for r in W.coherence(W.links(rows, ["k"]), ["k"]).collect()}
    assert [got[k]["avg_inter_sentence_similarity"] for k in (1, 2)] == [50.0, 50.0] and got[4]["global_coherence"] > 0
    again = {r["k"]: r for r in W.sentence_repetition(W.links(rows, ["k"]), ["k"]).collect()}
    assert again[4]["max_sentence_similarity"] == 100.0 and again[1]["max_sentence_similarity"] == 0.0


def test_content(spark):
    rows = spark.createDataFrame([(1, "Ask Anna Smith about trains", "anna smith knows trains"), (2, "", ""), (3, None, "x y")], "k int, prompt string, text string")
    got = {r["k"]: r for r in W.content(rows, ["k"]).collect()}
    assert got[1]["entity_retention"] == 0.0 and got[1]["information_coverage"] == 60.0
    assert (got[2]["context_similarity"], got[2]["entity_retention"], got[3]["information_coverage"]) == (0.0, 100.0, 0.0)


PROMPT = """Write 50-60 words in exactly 3 paragraphs. Keep a professional tone. Include a subject line (max 4 words).
Must include the phrase: "by Friday". Do not use the words: urgent, ASAP. No bullet points. Include exactly 2 actions separated by semicolons.
Include the email help@example.org and a clear next step. Each section must have exactly 2 sentences. Do not include apologies.
Include exactly two technical terms from this list: {API, cache, shard}. Add a confidence statement. Mention "2 hours"."""


def test_extracted_constraints():
    kinds = Counter(c.type for c in C.extract(PROMPT))
    wanted = "word_count_range paragraph_count_exact tone_requirement requires_subject_line subject_line_max_words required_phrase forbidden_word no_bullet_points item_count semicolon_separated required_email requires_next_step sentences_per_section no_apologies technical_terms_required confidence_statement"
    assert set(wanted.split()) <= set(kinds) and kinds["forbidden_word"] == 2
    assert C.extract("") == () and C.adherence([]) == 100.0


def _score(kind, text, **payload):
    return C.check(text, [C.Constraint(kind, "d", **payload)])[0]["score"]


def test_constraint_scores():
    ten = "a b c d e f g h i j"
    assert [_score("word_count_range", ten, min=lo, max=hi) for lo, hi in ((5, 10), (20, 30), (1, 8))] == [100, 0, 50]
    assert (_score("word_count_max", ten, max=8), _score("word_count_min", ten, min=12), _score("word_count_exact", ten, count=10)) == (50, 67, 100)
    assert (_score("sentence_count_exact", "A b. C d.", count=4), _score("sentence_count_range", "A b. C d.", min=3, max=4)) == (0, 50)
    assert (_score("forbidden_word", "so urgently", word="urgent"), _score("forbidden_word", "Urgent!", word="urgent")) == (100, 0)
    assert (_score("required_heading", "## Plan\nx", word="Plan"), _score("no_bullet_points", "a\n1. b"), _score("item_count", "a; b; c", count=2, word="actions")) == (100, 0, 70)
    assert (_score("subject_line_max_words", "Subject: one two three", max=2), _score("subject_line_max_words", "x", max=2)) == (70, 0)
    assert (_score("tone_requirement", "x", word="warm"), _score("tone_requirement", "We blame you", word="non-accusatory")) == (50, 70)
    assert (_score("technical_terms_required", "api", count=2, terms=("API", "cache")), _score("technical_terms_forbidden", "api", terms=("API",))) == (50, 70)
    assert (_score("no_apologies", "we apologize"), _score("no_apologies", "sorry")) == (100, 0)
    assert (_score("output_format", "A) x", word="A) and B)"), _score("output_format", "x", word="free")) == (50, 50)
    assert set(C.CHECKS) >= {c.type for c in C.extract(PROMPT)}


def test_constraint_rows(spark):
    rows = spark.createDataFrame([(1, PROMPT, "x"), (2, None, None), (3, "No bullet points", "- a")], "k int, prompt string, text string")
    got = {r["k"]: r for r in C.evaluate(rows, ["k"]).collect()}
    assert (got[2]["constraint_score"], got[2]["n_constraints"], got[3]["constraint_score"], got[3]["n_passed"]) == (100.0, 0, 0.0, 0)
    listed = C.constraints_of(rows, ["k"]).where("k = 3").collect()
    assert [(r["pos"], r["type"]) for r in listed] == [(0, "no_bullet_points")]
