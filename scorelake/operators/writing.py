"""Measures of prose, by category: readability, lexis, structure, tone, redundancy, coherence, content.

Each function takes rows with a text column and returns its keys and measures, one row for each row. All but coherence and
the vector part of content are built-in functions on the row's own arrays, without a shuffle. Values are rounded to two
places where the category is defined so. Null texts count as empty.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.rounding import exact_round, let

TRANSITIONS = tuple(sorted(L.TRANSITION))


def _keyed(measure):
    """Carries the keys as one struct column, so that their names can't meet those of a measure's own columns."""

    @functools.wraps(measure)
    def run(df: DataFrame, keys: Iterable[str], *args, **options) -> DataFrame:
        out = measure(df.select(F.struct(*keys).alias("_keys"), "*"), ["_keys"], *args, **options)
        return out.select("_keys.*", *[c for c in out.columns if c != "_keys"])

    return run


def _round(df: DataFrame, keys: Iterable[str], whole: Iterable[str] = (), places: int = 2) -> DataFrame:
    """keys, the columns `whole` as they are and the others rounded."""
    keys, whole = list(keys), set(whole)
    return df.select(*keys, *[F.col(c) if c in whole else exact_round(F.col(c), places).alias(c) for c in df.columns if c not in keys])


def _least(x: Column, low: float) -> Column:
    return F.greatest(x, F.lit(low))


@_keyed
def word_facts(df: DataFrame, keys: Iterable[str], text: str = "text") -> DataFrame:
    """keys and whole numbers of the words and sentences: what readability and lexis are computed from."""
    c = F.col
    words = df.select(*keys, T.ascii_tokens(c(text)).alias("w"), F.size(T.prose_sentences(c(text))).alias("n_sentences"))
    measured = F.transform("w", lambda w: let(T.syllables(w), lambda n: F.struct(F.length(w).alias("c"), n.alias("s"), T.is_complex(w, n).alias("x"), w.alias("w"))))
    rows = words.select(*keys, "n_sentences", F.size("w").cast("long").alias("n_words"), T.spectrum(c("w")).alias("f"), measured.alias("m"))
    # a word of more than five letters, or a short verb, is content
    content = lambda m: (m["c"] > 5) | m["w"].isin(sorted(L.SHORT_VERBS))
    flag = lambda x: F.when(x, 1).otherwise(0)
    return rows.select(
        *keys,
        "n_words",
        c("n_sentences").cast("long").alias("n_sentences"),
        T.total(c("m"), lambda m: m["c"]).alias("n_letters"),
        T.total(c("m"), lambda m: m["s"]).alias("n_syllables"),
        T.total(c("m"), lambda m: flag(m["x"])).alias("n_complex"),
        T.total(c("m"), lambda m: flag((m["s"] >= 3) & (m["c"] >= 7))).alias("n_sophisticated"),
        T.total(c("m"), lambda m: flag(content(m))).alias("n_content"),
        c("f.u").alias("n_distinct"),
        c("f.h").alias("n_once"),
        c("f.m2").alias("sum_squares"),
    )


@_keyed
def readability(facts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Reading ease and grades from word_facts."""
    c = F.col
    n = _least(c("n_words"), 1)
    rows = facts.select(*keys, "n_complex", "n_sentences", (n / c("n_sentences")).alias("asl"), (c("n_syllables") / n).alias("asw"), (c("n_letters") / n).alias("letters"), (c("n_complex") / n).alias("hard"), (c("n_sentences") / n * 100).alias("per_100"))
    ease = 206.835 - 1.015 * c("asl") - 84.6 * c("asw")
    grade = 0.39 * c("asl") + 11.8 * c("asw") - 15.59
    smog = F.when(c("n_sentences") >= 3, 1.043 * F.sqrt(c("n_complex") * (30 / c("n_sentences"))) + 3.1291).otherwise(grade)
    out = rows.select(
        *keys,
        F.least(_least(ease, 0.0), F.lit(100.0)).alias("flesch_reading_ease"),
        _least(grade, 0.0).alias("flesch_kincaid_grade"),
        (0.4 * (c("asl") + 100 * c("hard"))).alias("gunning_fog_index"),
        _least(0.0588 * (c("letters") * 100) - 0.296 * c("per_100") - 15.8, 0.0).alias("coleman_liau_index"),
        _least(4.71 * c("letters") + 0.5 * c("asl") - 21.43, 0.0).alias("automated_readability_index"),
        _least(smog, 0.0).alias("smog_grade"),
        _least(100 - F.abs(ease - 60) * 1.5, 0.0).alias("readability_score"),
    )
    return _round(out, keys)


@_keyed
def lexis(facts: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Lexical richness from word_facts."""
    c = F.col
    n, u, h = _least(c("n_words"), 1).cast("double"), c("n_distinct"), c("n_once")
    rows = facts.withColumn("_yules", F.when(c("sum_squares") > n, 10000 * (c("sum_squares") - n) / (n * n)).otherwise(0.0))
    out = rows.select(
        *keys,
        (u / n * 100).alias("type_token_ratio"),
        F.least(u / F.sqrt(n) / 15 * 100, F.lit(100.0)).alias("root_ttr"),
        (h / _least(u, 1) * 100).alias("hapax_legomena_ratio"),
        c("_yules").alias("yules_k"),
        F.least(_least(100 - c("_yules") * 0.5, 0.0), F.lit(100.0)).alias("vocabulary_richness"),
        (c("n_letters") / n).alias("avg_word_length"),
        (c("n_sophisticated") / n * 100).alias("lexical_sophistication"),
        (c("n_content") / n * 100).alias("information_density"),
        F.when(u > 0, F.pow(n, F.pow(u.cast("double"), F.lit(-0.172)))).otherwise(0.0).alias("brunets_w"),
        F.when((h > 0) & (u > h), 100 * F.log(n) / (1 - h / u)).otherwise(0.0).alias("honores_r"),
    )
    return _round(out, keys)


def _spread(sizes: Column) -> Column:
    """Struct of n, sum, sum of squares, least and most of whole numbers: all that mean and deviation need, exactly."""
    return F.struct(F.size(sizes).alias("n"), T.total(sizes, lambda x: x).alias("s"), T.total(sizes, lambda x: x * x).alias("q"), F.array_min(sizes).alias("low"), F.array_max(sizes).alias("high"))


@_keyed
def structure(df: DataFrame, keys: Iterable[str], text: str = "text") -> DataFrame:
    """Counts, lengths of sentences and paragraphs, kinds of sentences."""
    c, t = F.col, T.known(F.col(text))
    sizes = lambda x: F.transform(x, lambda s: F.size(T.ascii_tokens(s)).cast("long"))
    rows = df.select(
        *keys,
        F.size(T.ascii_tokens(t)).cast("long").alias("word_count"),
        let(T.prose_sentences(t), lambda s: F.struct(sizes(s).alias("sizes"), F.size(F.filter(s, lambda x: x.endswith("?"))).alias("asks"), F.size(F.filter(s, lambda x: x.endswith("!"))).alias("calls"))).alias("sentences"),
        let(sizes(T.paragraphs(t)), _spread).alias("p"),
        F.length(t).cast("long").alias("character_count"),
        F.length(F.replace(t, F.lit(" "), F.lit(""))).cast("long").alias("character_count_no_spaces"),
    )
    rows = rows.select("*", let(c("sentences.sizes"), _spread).alias("s"), c("sentences.asks").alias("asks"), c("sentences.calls").alias("calls"))
    variance = lambda x: (c(f"{x}.n") * c(f"{x}.q") - c(f"{x}.s") * c(f"{x}.s")) / (c(f"{x}.n") * c(f"{x}.n"))
    n, plain = c("s.n"), c("s.n") - c("asks") - c("calls")
    kinds = sum((F.when(x > 0, 1).otherwise(0) for x in (c("asks"), c("calls"), plain)), F.lit(0))
    out = rows.select(
        *keys,
        "word_count",
        n.cast("long").alias("sentence_count"),
        c("p.n").cast("long").alias("paragraph_count"),
        "character_count",
        "character_count_no_spaces",
        (c("s.s") / n).alias("avg_sentence_length"),
        c("s.low").alias("min_sentence_length"),
        c("s.high").alias("max_sentence_length"),
        F.sqrt(variance("s")).alias("sentence_length_std"),
        variance("s").alias("sentence_length_variance"),
        F.when(c("s.s") > 0, F.sqrt(variance("s")) / (c("s.s") / n) * 100).otherwise(0.0).alias("sentence_length_cv"),
        (c("p.s") / c("p.n")).alias("avg_paragraph_length"),
        F.sqrt(variance("p")).alias("paragraph_length_std"),
        (c("asks") / n * 100).alias("question_ratio"),
        (c("calls") / n * 100).alias("exclamation_ratio"),
        (plain / n * 100).alias("declarative_ratio"),
        (kinds / 3 * 100).alias("sentence_type_variety"),
        (c("word_count") / c("p.n")).alias("words_per_paragraph"),
    )
    return _round(out, keys, [x for x in out.columns if x.endswith("_count") or x.startswith(("min_", "max_", "character"))])


@_keyed
def tone(df: DataFrame, keys: Iterable[str], text: str = "text") -> DataFrame:
    """Sentiment, subjectivity, formality and their evenness over sentences."""
    c, t = F.col, T.known(F.col(text))

    def balance(s: Column) -> Column:
        return let(T.ascii_tokens(s), lambda w: let(F.struct(T.hits(w, L.POSITIVE).alias("p"), T.hits(w, L.NEGATIVE).alias("n")), lambda x: (x["p"] - x["n"]) / _least(x["p"] + x["n"], 1)))

    add = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    rows = df.select(
        *keys,
        let(T.ascii_tokens(t), lambda w: F.struct(F.size(w).alias("n"), T.total(w, F.length).alias("letters"), *[T.hits(w, x).alias(k) for k, x in (("pos", L.POSITIVE), ("neg", L.NEGATIVE), ("subj", L.SUBJECTIVE), ("formal", L.FORMAL), ("informal", L.INFORMAL))])).alias("w"),
        F.regexp_count(t, F.lit(r"(?U)\b\w+'\w+\b")).alias("contractions"),
        let(F.transform(T.prose_sentences(t), balance), lambda b: F.struct(F.size(b).alias("n"), add(b, lambda x: x).alias("s"), add(b, lambda x: x * x).alias("q"))).alias("b"),
    )
    n = _least(c("w.n"), 1)
    felt = c("w.pos") + c("w.neg")
    informal = c("w.informal") + c("contractions")
    plain = F.when(c("w.n") > 0, F.least(c("w.letters") / c("w.n") / 8, F.lit(1.0))).otherwise(5 / 8)
    mean = c("b.s") / c("b.n")
    out = rows.select(
        *keys,
        ((F.when(felt > 0, (c("w.pos") - c("w.neg")) / felt).otherwise(0.0) + 1) * 50).alias("sentiment_polarity"),
        (F.least(c("w.subj") / n * 10, F.lit(1.0)) * 100).alias("subjectivity"),
        (F.when(c("w.formal") + informal > 0, c("w.formal") / (c("w.formal") + informal)).otherwise(plain) * 100).alias("formality_score"),
        F.when(c("b.n") >= 2, _least(1 - (c("b.q") / c("b.n") - mean * mean), 0.0) * 100).otherwise(80.0).alias("tone_consistency"),
        (F.least(felt / n * 20, F.lit(1.0)) * 100).alias("emotional_range"),
    )
    return _round(out, keys)


@_keyed
def repetition(df: DataFrame, keys: Iterable[str], text: str = "text") -> DataFrame:
    """Shares of repeated bigrams, trigrams and content words, and the score from them as rounded."""
    c = F.col
    words = df.select(*keys, T.ascii_tokens(c(text)).alias("w"))
    parts = words.select(*keys, T.ngrams(c("w"), 2).alias("b"), T.ngrams(c("w"), 3).alias("t"), T.without(c("w"), L.REPETITION_STOPS).alias("c"))
    names = {"b": "bigram_repetition_rate", "t": "trigram_repetition_rate", "c": "content_word_repetition"}
    out = _round(parts.select(*keys, *[(T.repeated_share(c(k)) * 100).alias(v) for k, v in names.items()]), keys)
    score = 100 - (c(names["b"]) * 2 + c(names["t"]) * 3 + c(names["c"]) * 0.5)
    return out.withColumn("redundancy_score", exact_round(_least(score, 0.0), 2))


_TERM = re.compile(r"\b\w\w+\b")
#: Cells of a block of term vectors.
_CELLS = 1 << 22


class Vectors:
    """Unit vectors of smoothed tf-idf weights, one for each text, in blocks of bounded memory."""

    def __init__(self, texts: list[str], stops: frozenset[str], most: int | None = None):
        docs = [[w for w in _TERM.findall(t.lower()) if w not in stops] for t in texts]
        held = Counter(w for d in docs for w in set(d))
        if most is not None and len(held) > most:
            often = Counter(w for d in docs for w in d)
            held = {w: held[w] for w in sorted(held, key=lambda w: (-often[w], w))[:most]}
        at = {w: i for i, w in enumerate(held)}
        self.n, self.width = len(docs), len(at)
        counts = [Counter(w for w in d if w in at) for d in docs]
        self.row = np.repeat(np.arange(self.n), [len(c) for c in counts])
        self.col = np.array([at[w] for c in counts for w in c], np.int64)
        idf = np.log((1 + self.n) / (1 + np.array([held[w] for w in at], float))) + 1
        value = np.array([x for c in counts for x in c.values()], float) * idf[self.col] if self.width else np.zeros(0)
        norm = np.sqrt(np.bincount(self.row, weights=value * value, minlength=self.n))
        self.value = value / norm[self.row] if len(value) else value

    def block(self, lo: int, hi: int) -> np.ndarray:
        a, b = np.searchsorted(self.row, [lo, hi])
        out = np.zeros((hi - lo, self.width))
        out[self.row[a:b] - lo, self.col[a:b]] = self.value[a:b]
        return out

    def step(self) -> int:
        return max(2, _CELLS // max(self.width, 1))

    def neighbours(self) -> np.ndarray:
        """Cosine of each text and the next."""
        parts = [self.block(lo, min(lo + self.step() + 1, self.n)) for lo in range(0, self.n - 1, self.step())]
        return np.concatenate([(x[:-1] * x[1:]).sum(axis=1) for x in parts])

    def mean(self) -> float:
        """Mean cosine of all pairs, from the sum of the vectors."""
        whole = np.bincount(self.col, weights=self.value, minlength=self.width)
        own = len(np.unique(self.row))
        return float((whole @ whole - own) / (self.n * (self.n - 1)))

    def most(self) -> float:
        """The largest cosine of two texts, at least 0."""
        best, step = 0.0, self.step()
        for lo in range(0, self.n, step):
            left = self.block(lo, min(lo + step, self.n))
            for at in range(lo, self.n, step):
                cosine = left @ (left if at == lo else self.block(at, min(at + step, self.n))).T
                if at == lo:
                    np.fill_diagonal(cosine, 0)
                best = max(best, float(cosine.max()))
        return best


LINKS = ("near_mean", "near_least", "near_var", "mean", "most")


def sentence_links(sentences: list[str], stops: frozenset[str] = L.VECTOR_STOPS) -> tuple[float | None, ...]:
    """Cosines of neighbouring sentences (mean, least, variance) and of all pairs (mean, most); None without two sentences or
    without a term."""
    v = Vectors(sentences, stops) if len(sentences) > 1 else None
    if v is None or not v.width:
        return (None,) * len(LINKS)
    near = v.neighbours()
    return float(near.mean()), float(near.min()), float(near.var()), v.mean(), v.most()


def _linker(n_keys: int, stops: frozenset[str]):
    def run(batches):
        for batch in batches:
            links = [sentence_links(s, stops) for s in batch.column(n_keys).to_pylist()]
            made = [pa.array([x[i] for x in links], pa.float64()) for i in range(len(LINKS))]
            names = [*batch.schema.names[:n_keys], *batch.schema.names[n_keys + 1 :], *LINKS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keys], *batch.columns[n_keys + 1 :], *made], names=names)

    return run


@_keyed
def links(df: DataFrame, keys: Iterable[str], text: str = "text", stops: frozenset[str] = L.VECTOR_STOPS) -> DataFrame:
    """keys, link_sentences, link_transitions (entries of the list that the text holds) and LINKS, null where not defined."""
    keys, t = list(keys), T.known(F.col(text))
    entries = F.array(*[F.lit(x) for x in TRANSITIONS])
    held = let(F.lower(t), lambda x: F.size(F.filter(entries, lambda e: F.contains(x, e))))
    rows = df.select(*keys, T.prose_sentences(t).alias("s"), held.cast("long").alias("link_transitions"))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)]], "link_transitions long, link_sentences long", *[f"{x} double" for x in LINKS]])
    return rows.select(*keys, "s", "link_transitions", F.size("s").cast("long").alias("link_sentences")).mapInArrow(_linker(len(keys), stops), schema)


@_keyed
def coherence(linked: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Flow of a text, from links."""
    c, keys = F.col, list(keys)
    out = linked.select(
        *keys,
        F.coalesce(c("near_mean") * 100, F.lit(50.0)).alias("avg_inter_sentence_similarity"),
        F.coalesce(c("near_least") * 100, F.lit(50.0)).alias("min_inter_sentence_similarity"),
        F.coalesce(c("near_var") * 100, F.lit(0.0)).alias("coherence_variance"),
        (c("link_transitions") / c("link_sentences") * 100).alias("transition_density"),
        F.coalesce(F.when(c("link_sentences") >= 3, c("mean") * 100), F.lit(50.0)).alias("global_coherence"),
    )
    flow = 0.4 * c("avg_inter_sentence_similarity") + 0.3 * F.least(c("transition_density") * 10, F.lit(100.0)) + 0.3 * c("global_coherence")
    return _round(out, keys).withColumn("flow_score", exact_round(flow, 2))


@_keyed
def sentence_repetition(linked: DataFrame, keys: Iterable[str]) -> DataFrame:
    """How alike the sentences of a text are, from links."""
    keys = list(keys)
    whole = lambda x: F.coalesce(F.col(x) * 100, F.lit(0.0))
    return _round(linked.select(*keys, whole("most").alias("max_sentence_similarity"), whole("mean").alias("avg_cross_sentence_similarity")), keys)


def _similar(n_keys: int, stops: frozenset[str], most: int):
    def run(batches):
        for batch in batches:
            found = []
            for a, b in zip(batch.column(n_keys).to_pylist(), batch.column(n_keys + 1).to_pylist(), strict=True):
                v = Vectors([a, b], stops, most)
                found.append(float(v.neighbours()[0]) * 100 if v.width else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "similarity"])

    return run


@_keyed
def content(df: DataFrame, keys: Iterable[str], prompt: str = "prompt", context: str | None = None, text: str = "text", stops: frozenset[str] = L.VECTOR_STOPS, most: int = 5000) -> DataFrame:
    """How far a text takes up its prompt (and context): term vectors, words, capitalised names."""
    c, keys = F.col, list(keys)
    wanted = T.known(c(prompt))
    if context is not None:
        wanted = F.when(F.length(T.known(c(context))) > 0, F.concat(wanted, F.lit(" "), c(context))).otherwise(wanted)
    rows = df.select(*keys, wanted.alias("_r"), T.known(c(text)).alias("_t"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields] + ["similarity double"])
    rows = rows.mapInArrow(_similar(len(keys), stops, most), schema)
    sets = rows.select(
        *keys,
        "similarity",
        F.array_distinct(T.without(T.ascii_tokens(c("_r")), L.COVERAGE_STOPS)).alias("words"),
        T.ascii_tokens(c("_t")).alias("held"),
        F.array_distinct(F.regexp_extract_all("_r", F.lit(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)*\b"), F.lit(0))).alias("names"),
        F.lower("_t").alias("low"),
    )
    kept = let(F.struct("names", "low"), lambda x: F.size(F.filter(x["names"], lambda e: F.contains(x["low"], F.lower(e)))))
    out = sets.select(
        *keys,
        c("similarity").alias("context_similarity"),
        (T.ratio(F.size(F.array_intersect("words", "held")), F.size("words")) * 100).alias("information_coverage"),
        F.when(F.size("names") > 0, kept / F.size("names") * 100).otherwise(100.0).alias("entity_retention"),
    )
    return _round(out, keys).withColumn("relevance_score", exact_round(0.5 * c("context_similarity") + 0.3 * c("information_coverage") + 0.2 * c("entity_retention"), 2))


# Default weights of the categories.
WEIGHTS = {"content_quality": 20, "tone_sentiment": 15, "readability": 15, "lexical_analysis": 10, "structural": 10, "constraint_adherence": 20, "coherence_flow": 5, "redundancy": 5}


def categories() -> dict[str, Column]:
    """Category scores as columns over the rounded measures (and constraint_score), a missing measure taking a middle value."""
    c = lambda name, missing=50.0: F.coalesce(F.col(name), F.lit(float(missing)))
    spread = _least(100 - F.abs(c("sentence_length_cv", 0) - 40) * 2, 0.0)
    cap = lambda x: F.least(x, F.lit(100.0))
    return {
        "content_quality": c("relevance_score"),
        "tone_sentiment": exact_round(0.3 * c("formality_score") + 0.3 * c("tone_consistency") + 0.2 * c("sentiment_polarity") + 0.2 * (100 - c("subjectivity")), 2),
        "readability": c("readability_score"),
        "lexical_analysis": exact_round(0.3 * c("vocabulary_richness") + 0.25 * cap(c("type_token_ratio")) + 0.25 * cap(c("lexical_sophistication") * 3) + 0.2 * cap(c("information_density")), 2),
        "structural": exact_round(0.5 * c("sentence_type_variety", 33) + 0.5 * spread, 2),
        "constraint_adherence": c("constraint_score"),
        "coherence_flow": c("flow_score"),
        "redundancy": c("redundancy_score"),
    }


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of category columns that are there; 0 without weight."""
    total = sum(weights.values())
    if not total:
        return F.lit(0.0)
    return exact_round(sum((F.coalesce(F.col(k), F.lit(0.0)) * (w / total) for k, w in weights.items()), F.lit(0.0)), 2)


def evaluate(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt", context: str | None = None, text: str = "text", constraint_score: str | None = None, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """keys, the category scores and the composite of every row.

    The families are computed one after another on the same rows, each as further columns, so that texts are read once and
    nothing is joined: a row's own key travels with its measures."""
    keys = list(keys)
    base = rows.select(*keys, F.col(prompt).alias("_p"), (F.col(context) if context else F.lit(None).cast("string")).alias("_c"), F.col(text).alias("_x"), (F.col(constraint_score) if constraint_score else F.lit(100.0)).alias("constraint_score"))
    carried = [*keys, "_p", "_c", "_x", "constraint_score"]

    def add(df: DataFrame, measures, wanted: list[str]) -> DataFrame:
        nonlocal carried
        out = measures(df, carried).select(*carried, *wanted)
        carried = [*carried, *wanted]
        return out

    df = add(base, lambda d, k: content(d, k, "_p", "_c", "_x"), ["relevance_score"])
    df = add(df, lambda d, k: tone(d, k, "_x"), ["formality_score", "tone_consistency", "sentiment_polarity", "subjectivity"])
    facts = word_facts(df, carried, "_x")
    both = [x for x in facts.columns if x not in carried]
    df = add(facts, lambda d, k: readability(d, [*k, *both]), ["readability_score", *both])
    df = add(df, lambda d, k: lexis(d, k), ["vocabulary_richness", "type_token_ratio", "lexical_sophistication", "information_density"])
    df = add(df, lambda d, k: structure(d, k, "_x"), ["sentence_type_variety", "sentence_length_cv"])
    df = add(df, lambda d, k: coherence(links(d, k, "_x"), k), ["flow_score"])
    df = add(df, lambda d, k: repetition(d, k, "_x"), ["redundancy_score"])
    scored = df.select(*keys, *[v.alias(k) for k, v in categories().items()])
    return scored.withColumn("composite_score", composite(weights))
