"""Measures of pairs of texts: a hypothesis (summary, back-translation) against a reference (source, original).

A pair is one row and is measured where it lies, without a shuffle: one pass over Arrow batches tokenizes both texts once
and counts their n-grams in linear time. Built-in higher-order functions were tried first; they have no multiset of
constant cost per item, and exploding n-grams shuffles every gram of every text. Memory: one pair's n-grams.
Values are rounded to four places, half to even on the exact binary value.

Null texts count as empty.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lexicons import SUMMARY_STOPS, TRANSLATION_STOPS
from ..functions.sequences import common, edits

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
#: Least Jaccard similarity of sentences that count as the same.
SAME_SENTENCE = 0.3
KEY_SENTENCES = 3


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[str]:
    """Pieces that white space after a full stop, exclamation or question mark sets apart."""
    return [s for s in map(str.strip, _SENTENCE_END.split(text.strip())) if s]


def clauses(text: str) -> list[str]:
    """Pieces between runs of full stops, exclamation and question marks, lower-cased."""
    return [s.strip().lower() for s in re.split(r"[.!?]+", text) if s.strip()]


def grams(items, n: int) -> Counter:
    """n-grams of a list of tokens (tuples) or of a string (pieces), with their numbers."""
    if isinstance(items, str):
        return Counter(items[i : i + n] for i in range(len(items) - n + 1))
    return Counter(zip(*(items[i:] for i in range(n)), strict=False))


def share(a: float, b: float) -> float:
    return a / b if b else 0.0


def overlap(a: set, b: set) -> float:
    return share(len(a & b), len(a | b))


def f_score(matches: int, n_h: int, n_r: int) -> tuple[float, float, float]:
    p, r = share(matches, n_h), share(matches, n_r)
    return p, r, share(2 * p * r, p + r)


class Side:
    """One text and what its measures share."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = tokens(self.text)
        self.known = set(self.words)
        self._grams: dict[int, Counter] = {}

    def grams(self, n: int) -> Counter:
        if n not in self._grams:
            self._grams[n] = grams(self.words, n)
        return self._grams[n]

    @cached_property
    def content(self) -> list[str]:
        return [w for w in self.words if len(w) > 1 and w not in SUMMARY_STOPS]

    def diversity(self) -> float:
        return share(len(self.known), len(self.words))

    def repeated(self, n: int) -> float:
        g = self.grams(n)
        return share(g.total() - len(g), g.total())


class Pair:
    def __init__(self, hypothesis: str | None, reference: str | None):
        self.h, self.r = Side(hypothesis), Side(reference)

    def matches(self, n: int) -> int:
        return (self.h.grams(n) & self.r.grams(n)).total()

    def rouge(self, n: int) -> tuple[float, float, float]:
        return f_score(self.matches(n), self.h.grams(n).total(), self.r.grams(n).total())

    @cached_property
    def longest(self) -> int:
        return common(self.r.words, self.h.words)

    def rouge_l(self) -> tuple[float, float, float]:
        return f_score(self.longest, len(self.h.words), len(self.r.words))

    def _brevity(self) -> float:
        return math.exp(min(0.0, 1 - len(self.r.words) / len(self.h.words)))

    def bleu(self, most: int, strict: bool = False) -> float:
        """Geometric mean of clipped precisions by order; an order without a match gives 0 if strict, and is left out otherwise."""
        if not self.h.words or not self.r.words:
            return 0.0
        held = [n for n in range(1, most + 1) if len(self.h.words) >= n and (strict or len(self.r.words) >= n)]
        p = [self.matches(n) / self.h.grams(n).total() for n in held]
        if strict and 0 in p:
            return 0.0
        logs = [math.log(x) for x in p if x]
        return self._brevity() * math.exp(sum(logs) / len(logs)) if logs else 0.0

    def chrf(self, spaced: bool, most: int = 6, beta: int = 2) -> float:
        """Character n-gram F-score, white space kept (but at the ends) or removed."""
        h, r = ((x.text.lower().strip() if spaced else re.sub(r"\s+", "", x.text.lower())) for x in (self.h, self.r))
        parts = [(grams(h, n), grams(r, n)) for n in range(1, min(most, len(h), len(r)) + 1)]
        if not parts:
            return 0.0
        met = [(a & b).total() for a, b in parts]
        p = sum(m / a.total() for m, (a, _) in zip(met, parts, strict=True)) / len(parts)
        r = sum(m / b.total() for m, (_, b) in zip(met, parts, strict=True)) / len(parts)
        return share((1 + beta**2) * p * r, beta**2 * p + r)

    def cosine(self) -> float:
        """Cosine of term frequencies; in a corpus of the two texts a word of both weighs 1, a word of one ln(3 / 2) + 1."""
        a, b = self.h.grams(1), self.r.grams(1)
        alone = (math.log(1.5) + 1) ** 2
        norm = lambda x, y: sum(c * c * (1 if w in y else alone) for w, c in x.items())
        return share(sum(c * b[w] for w, c in a.items() if w in b), math.sqrt(norm(a, b)) * math.sqrt(norm(b, a)))

    def wer(self) -> float:
        return share(edits(self.r.words, self.h.words), len(self.r.words))

    def content_overlap(self) -> float:
        """Of words that are no function words; 0 if a side has none."""
        return overlap(set(self.h.content), set(self.r.content)) if self.h.content and self.r.content else 0.0

    def long_word_overlap(self) -> float:
        """Of words of four letters or more that are no function words; 1 if neither side has one."""
        h, r = ({w for w in x.known if len(w) > 3 and w not in TRANSLATION_STOPS} for x in (self.h, self.r))
        return overlap(h, r) if h or r else 1.0

    def bigram_overlap(self) -> float:
        h, r = set(self.h.grams(2)), set(self.r.grams(2))
        return overlap(h, r) if h and r else 0.0

    def coverage(self) -> float:
        wanted = set(self.r.content)
        return share(len(wanted & self.h.known), len(wanted))

    def novelty(self, n: int) -> float:
        h, r = self.h.grams(n), self.r.grams(n)
        return share(sum(g not in r for g in h), len(h))

    def same_sentences(self) -> float:
        """Share of the hypothesis's sentences that are like one of the reference's."""
        r = [s for s in (set(tokens(x)) for x in sentences(self.r.text)) if s]
        h = [set(tokens(x)) for x in sentences(self.h.text)]
        like = lambda s: any(overlap(s, t) > SAME_SENTENCE for t in r)
        return share(sum(like(s) for s in h if s), len(h)) if sentences(self.r.text) else 0.0

    def best_sentences(self) -> float:
        """Mean over the reference's sentences of the best overlap with one of the hypothesis's."""
        r, h = ([set(tokens(x)) for x in clauses(s.text)] for s in (self.r, self.h))
        if not r or not h:
            return 0.0
        alike = lambda s, t: round(overlap(s, t), 4) if s or t else 1.0
        total = 0.0
        for s in r:  # added up one by one, as sum() corrects what it loses
            total += max(alike(s, t) for t in h)
        return total / len(r)


def key_sentences(text: str, most: int) -> list[str]:
    """The sentences whose content words are the most frequent in the text, best first, ties in their order."""
    held, n = Counter(tokens(text)), len(tokens(text))
    scored = []
    for s in sentences(text):
        words = Side(s).content
        if words:
            scored.append((sum(held[w] / n for w in words) / len(words), s))
    return [s for _, s in sorted(scored, key=lambda x: -x[0])[:most]]


def summary_measures(summary: str | None, source: str | None) -> dict:
    """The summary's own measures, and those against its source, null without one."""
    pair = Pair(summary, source)
    h, r = pair.h, pair.r
    out = {
        "lexical_diversity": h.diversity(),
        "information_density": share(len(h.content), len(h.words)),
        "redundancy": h.repeated(3),
        "summary_word_count": len(h.words),
        "summary_sent_count": len(sentences(h.text)),
        "no_source_warning": not r.text.strip(),
    }
    if out["no_source_warning"]:
        return out
    for name, got in (("rouge1", pair.rouge(1)), ("rouge2", pair.rouge(2)), ("rougeL", pair.rouge_l())):
        out |= dict(zip((f"{name}_p", f"{name}_r", f"{name}_f1"), got, strict=True))
    key = " ".join(key_sentences(r.text, KEY_SENTENCES))
    return out | {
        "bleu": pair.bleu(4, strict=True),
        "chrf": pair.chrf(spaced=True),
        "tfidf_cosine": pair.cosine(),
        "jaccard": overlap(h.known, r.known),
        "content_word_overlap": pair.content_overlap(),
        "bigram_overlap": pair.bigram_overlap(),
        "compression_ratio": share(len(h.words), len(r.words)),
        "coverage": pair.coverage(),
        "sentence_overlap": pair.same_sentences(),
        "wer_vs_key": Pair(h.text, key).wer() if key else None,
        "cer_vs_key": share(edits(key.lower(), h.text.lower()), len(key)) if key else None,
        "novel_bigram_ratio": pair.novelty(2),
        "abstractivity": pair.novelty(3),
        "source_word_count": len(r.words),
    }


def translation_measures(back: str | None, original: str | None) -> dict:
    pair = Pair(back, original)
    h, r = pair.h, pair.r
    out: dict = {f"bleu_{n}": pair.bleu(n) for n in (1, 2, 4)}
    for name, got in (("rouge_1", pair.rouge(1)), ("rouge_2", pair.rouge(2)), ("rouge_l", pair.rouge_l())):
        out |= dict(zip((f"{name}_p", f"{name}_r", f"{name}_f1"), got if h.words and r.words else (0.0, 0.0, 0.0), strict=True))
    bare_h, bare_r = (x.text.lower().replace(" ", "") for x in (h, r))
    ratio = round(share(len(h.words), len(r.words)), 4)
    return out | {
        "rouge_l_lcs": pair.longest,
        "chrf": pair.chrf(spaced=False),
        "wer": pair.wer(),
        "cer": share(edits(bare_r, bare_h), len(bare_r)),
        "tfidf_cosine": pair.cosine(),
        "jaccard": overlap(h.known, r.known) if h.known or r.known else 1.0,
        "length_ratio": ratio,
        "length_score": max(0.0, 1.0 - abs(1.0 - ratio)),
        "lex_div_original": r.diversity(),
        "lex_div_backtranslation": h.diversity(),
        "content_word_overlap": pair.long_word_overlap(),
        "bigram_overlap": pair.bigram_overlap(),
        "sentence_overlap": pair.best_sentences(),
        "orig_word_count": len(r.words),
        "bt_word_count": len(h.words),
    }


def edit_measures(hypothesis: str | None, reference: str | None) -> dict:
    """Order-sensitive measures alone: wer, lcs and its precision, recall and F-score."""
    pair = Pair(hypothesis, reference)
    p, r, f = pair.rouge_l()
    return {"wer": pair.wer(), "lcs": pair.longest, "precision": p, "recall": r, "f1": f}


def rouge_measures(n: int) -> Callable:
    return lambda h, r: dict(zip(("precision", "recall", "f1"), Pair(h, r).rouge(n), strict=True))


def bleu_measures(hypothesis: str | None, reference: str | None) -> dict:
    pair = Pair(hypothesis, reference)
    return {**{f"bleu_{n}": pair.bleu(n) for n in (1, 2, 4)}, "bleu_strict": pair.bleu(4, strict=True), "tfidf_cosine": pair.cosine()}


def chrf_measures(hypothesis: str | None, reference: str | None) -> dict:
    pair = Pair(hypothesis, reference)
    return {"chrf": pair.chrf(spaced=False), "chrf_spaced": pair.chrf(spaced=True)}


def _fields(measure: Callable) -> list[T.StructField]:
    """The columns of a measure: what it gives for a pair in which every value is there."""
    kinds = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType()}
    return [T.StructField(k, kinds[type(v)]) for k, v in measure("two words here.", "two other words.").items()]


def measure_pairs(pairs: DataFrame, hypothesis: str, reference: str, keys: Iterable[str], measure: Callable) -> DataFrame:
    """keys and the columns of measure(hypothesis, reference) for every row of pairs; numbers rounded to four places."""
    keys = list(keys)
    rows = pairs.select(*keys, F.col(hypothesis).cast("string").alias("_h"), F.col(reference).cast("string").alias("_r"))
    fields = _fields(measure)
    arrow = {T.BooleanType(): pa.bool_(), T.LongType(): pa.int64(), T.DoubleType(): pa.float64()}

    def run(batches):
        for batch in batches:
            h, r = batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist()
            found = [measure(x, y) for x, y in zip(h, r, strict=True)]
            made = []
            for f in fields:
                values = [row.get(f.name) for row in found]
                if f.dataType == T.DoubleType():
                    values = [None if v is None else round(float(v), 4) for v in values]
                made.append(pa.array(values, arrow[f.dataType]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=[*keys, *[f.name for f in fields]])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keys)], *fields]))
