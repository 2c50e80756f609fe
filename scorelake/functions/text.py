"""Text functions as columns: tokens, sentences, paragraphs, n-grams, lexical measures. All are row-local built-in functions.

A column that a lambda reads for each item must be an attribute that its projection reads more than once, or come in by
rounding.let: an alias read once is replaced by its definition, which would then be computed for each item.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import ABBREVIATIONS
from .rounding import let

TOKEN = r"[\p{L}\p{N}_]+"
ASCII_TOKEN = r"[a-z]+(?:'[a-z]+)?"
GREETING = "^(?:dear|hi|hello|hey|best|regards|sincerely|cheers|thanks|thank you|subject:|re:)"
_CUT = "\u0001"


def known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(known(text), r"(?U)^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(known(text)), F.lit(TOKEN), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, with one inner apostrophe; other letters and digits are dropped."""
    return F.regexp_extract_all(F.lower(known(text)), F.lit(ASCII_TOKEN), F.lit(0))


def clauses(text: Column) -> Column:
    """Pieces between runs of full stops, exclamation and question marks, trimmed, lower-cased, without empty ones."""
    return F.filter(F.transform(F.split(known(text), "[.!?]+"), lambda s: F.lower(stripped(s))), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Pieces that white space after a full stop, exclamation or question mark sets apart."""
    return F.filter(F.split(stripped(text), r"(?U)(?<=[.!?])\s+"), lambda s: s != "")


def prose_sentences(text: Column) -> Column:
    """Sentences of prose: cut before a capital or a quotation mark, not after abbreviations; a piece of one or two words
    without an end joins the sentence before it. White space is one space. Never empty."""
    abbreviations = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    flat = F.regexp_replace(stripped(text), r"(?U)\s+", " ")
    pieces = F.split(flat, rf"(?<=[.!?])(?<!(?:{abbreviations})\.) (?=[A-Z\"'])")

    def joined(p: Column) -> Column:
        words = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))) + 1
        stays = lambda s, i: (i > 0) & (words(s) <= 2) & ~s.rlike(r"[.!?]$")
        return F.split(F.array_join(F.transform(p, lambda s, i: F.when(i == 0, s).when(stays(s, i), F.concat(F.lit(" "), s)).otherwise(F.concat(F.lit(_CUT), s))), ""), _CUT)

    return let(pieces, joined)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, without blocks under three characters and single lines of greeting; where that leaves at
    most one, the lines of more than ten characters, if there are two or more. Never empty."""

    def blocks(t: Column) -> Column:
        greeting = lambda p: ~p.contains("\n") & (F.size(F.split(p, r"\s+")) <= 4) & F.lower(p).rlike(GREETING)
        return F.filter(F.transform(F.split(t, r"\n\s*\n"), stripped), lambda p: (F.length(p) >= 3) & ~greeting(p))

    def lines(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, "\n"), stripped), lambda x: F.length(x) > 10)

    def chosen(t: Column) -> Column:
        both = F.struct(blocks(t).alias("blocks"), lines(t).alias("lines"))
        pick = lambda b: F.when((F.size(b["blocks"]) <= 1) & (F.size(b["lines"]) > 1) & t.contains("\n"), b["lines"]).when(F.size(b["blocks"]) > 0, b["blocks"]).otherwise(F.array(t))
        return let(both, pick)

    return let(stripped(text), chosen)


def ngrams(words: Column, n: int) -> Column:
    """n-grams of an array column that is an attribute (it is read for each position), joined by spaces."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))


def char_ngrams(text: Column, n: int, spaced: bool) -> Column:
    """Character n-grams, lower-cased; white space is kept (but at the ends) or removed."""
    bare = F.lower(stripped(text)) if spaced else F.regexp_replace(F.lower(known(text)), r"(?U)\s+", "")

    def cut(t: Column) -> Column:
        at = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.substring(t, i, F.lit(n)))

    return let(bare, cut)


def without(words: Column, stops: Iterable[str], longer_than: int = 0) -> Column:
    """Words that are not in a list and have more than so many characters, repeats kept."""
    stops = sorted(stops)
    return F.filter(words, lambda w: ~w.isin(stops) & (F.length(w) > longer_than))


def hits(words: Column, lexicon: Iterable[str]) -> Column:
    """How many of the words are in a list."""
    lexicon = sorted(lexicon)
    return F.size(F.filter(words, lambda w: w.isin(lexicon))).cast("long")


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def diversity(words: Column) -> Column:
    return ratio(F.size(F.array_distinct(words)), F.size(words))


def repeated_share(grams: Column) -> Column:
    """Share of the items that come a second time or later."""
    return ratio(F.size(grams) - F.size(F.array_distinct(grams)), F.size(grams))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)), both_empty)


def novelty(grams: Column, source: Column) -> Column:
    """Share of distinct n-grams that the source doesn't hold."""
    return ratio(F.size(F.array_except(grams, source)), F.size(F.array_distinct(grams)))


def total(items: Column, value) -> Column:
    """Sum of value(item) over an array."""
    return F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + value(x).cast("long"))


def spectrum(words: Column) -> Column:
    """Struct of n, u (distinct words), h (words that come once) and m2 (sum of squared counts), in one pass over the sorted
    words with a state of constant size."""
    zero = F.lit(0).cast("long")
    start = F.struct(F.lit("").alias("last"), zero.alias("run"), zero.alias("u"), zero.alias("h"), zero.alias("m2"))

    def closed(a: Column) -> tuple[Column, Column]:
        return a["h"] + F.when(a["run"] == 1, 1).otherwise(0), a["m2"] + a["run"] * a["run"]

    def step(a: Column, w: Column) -> Column:
        h, m2 = closed(a)
        same = F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["u"].alias("u"), a["h"].alias("h"), a["m2"].alias("m2"))
        new = F.struct(w.alias("last"), F.lit(1).cast("long").alias("run"), (a["u"] + 1).alias("u"), h.alias("h"), m2.alias("m2"))
        return F.when((a["run"] > 0) & (a["last"] == w), same).otherwise(new)

    def finish(a: Column) -> Column:
        h, m2 = closed(a)
        return F.struct(a["u"].alias("u"), h.alias("h"), m2.alias("m2"))

    return F.aggregate(F.sort_array(words), start, step, finish)


def syllables(word: Column) -> Column:
    """Estimated syllables of a lower-case word: its vowel groups, with rules for final -e, -le and -tion, -sion, -cian."""
    silent = word.endswith("e") & ~word.endswith("le")
    groups = F.regexp_count(F.when(silent, F.regexp_replace(word, "e$", "")).otherwise(word), F.lit("[aeiouy]+"))
    groups = groups + F.when(word.rlike("[^aeiouy]le$"), 1).otherwise(0)
    groups = F.when(word.rlike("(tion|sion|cian)$"), F.greatest(groups, F.lit(2))).otherwise(groups)
    return F.when(F.length(word) <= 3, 1).otherwise(F.greatest(groups, F.lit(1)))


def is_complex(word: Column, count: Column | None = None) -> Column:
    """Three syllables or more, also without a final -ed, -es, -ing or -ly; count: the word's syllables, if known."""
    count = syllables(word) if count is None else count
    return F.when(count >= 3, syllables(F.regexp_replace(word, "(ed|es|ing|ly)$", "")) >= 3).otherwise(False)
