"""A constraint language read out of writing prompts, and how far a text keeps to it.

A prompt's constraints are rows of one type with nullable payload: its kind, a description, numbers, words. Each kind has a
reader (prompt to constraints) and a check (text and constraint to what was found and a score of 0 to 100). Prompts are parsed
row by row on Arrow batches, as their grammar is a set of patterns with context; a text is checked in the same pass.

Null prompts and texts count as empty; a prompt without constraints is kept to fully.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicons as L
from ..functions import prose

_QUOTE, _INNER = "[\"\"\"']", "[^\"\"\"']+"
_TO = r"(\d+)\s*[-–—]\s*(\d+)\s*"
_ITEMS = r"(actions?|steps?|items?|points?|reasons?|examples?|benefits?)"

# Wordings of each kind.
WORD_RANGES = (rf"(?:body|total|length|text)\s+(?:must be\s+)?{_TO}words", rf"(?<!subject\s)(?<!line\s){_TO}words", rf"total\s+(?:length\s+)?(?:must be\s+)?{_TO}words")
SENTENCE_COUNTS = (r"(?:exactly|precisely|total[^.]*?=\s*)\s*(\d+)\s*sentences", rf"{_TO}sentences", r"(?:exactly|precisely)\s+(\d+)\s+sentences", r"total\s*=\s*(\d+)\s+sentences")
PARAGRAPH_COUNTS = (r"(?:exactly|precisely|use)\s+(\d+)\s+paragraphs?", rf"{_TO}paragraphs?")
PHRASES = (rf"(?:must |should )?include (?:the )?(?:phrase|text|words?|statement):?\s*{_QUOTE}({_INNER}){_QUOTE}", rf"must (?:mention|include|contain)[^.]*?{_QUOTE}({_INNER}){_QUOTE}")
INLINE_PHRASE = r'include[^.]*?[:\s]"([^"]+)"'
EXAMPLE_MARKS = ("e.g.", "for example", "such as")
FORBIDDEN = r"(?:do not|don't|avoid|must not|should not|never)\s+use\s+(?:the\s+)?words?:\s*(.+?)(?:\.\s|\.$|\n)"
HEADINGS = (r"(?:use|include)\s+(?:exactly\s+)?these\s+headings?[^:]*:\s*(.+?)(?:\n\n|\nConstraints|\n[A-Z])", r"headings?[^:]*?in\s+this\s+order:\s*(.+?)(?:\n\n|\nConstraints)")
TONES = ("professional", "formal", "informal", "casual", "neutral", "friendly", "persuasive", "academic", "informative", "non-accusatory", "non accusatory", "warm", "empathetic")
ITEM_COUNTS = (rf"(?:exactly|precisely)\s+(\d+)\s+{_ITEMS}", rf"include\s+(?:exactly\s+)?(\d+)\s+{_ITEMS}")
EMAIL = r"(?:include|must contain)[^.]*?([\w.]+@[\w.]+\.\w+)"
KNOWN_EMAIL = "support@example.com"
TERMS = r"(?:must\s+)?include\s+(?:exactly\s+)?(\w+)\s+technical\s+terms?\s+from\s+(?:this\s+)?list:\s*\{([^}]+)\}"
NO_TERMS = r"(?:must\s+)?include\s+zero\s+technical\s+terms?\s+from\s+(?:that|this)\s+list"
NUMBERS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "zero": 0, "no": 0, "none": 0}
FORMAT = r"output\s+format\s+must\s+be:\s*\n(.+?)(?:\n\n|$)"
CONFIDENCE = r"(?:confidence|confident)\s+statement\s*\(?\"?([^\")\n]*)\"?\)?"
DURATION = r'(?:include|mention)[^.]*?"([^"]*(?:hours?|minutes?|days?)[^"]*)"'
TIMES = ("next tuesday", "2 hours", "next Monday", "next Wednesday")
SUBJECT = r"(?:^|\n)\s*(?:subject|re|subj)[\s:]+(.+)"
NEXT_STEPS = (r"please\s+(?:reply|send|confirm|let|share|provide|submit|review|reach)", r"next\s+step", r"(?:our|your)\s+(?:next|immediate)\s+(?:action|step)", r"(?:will|going to|plan to)\s+\w+", r"(?:follow up|update|check in|circle back)")
CONFIDENT = (r"(?:we are|i am|we're|i'm)\s+confident", r"(?:we|i)\s+(?:firmly\s+)?believe", r"(?:confident|sure|certain|assured)\s+that", r"rest\s+assured")
APOLOGY = r"\b(?:sorry|apolog|regret|inconvenience)\b"
ACCUSING = frozenset("blame fault failed neglect irresponsible unacceptable".split())
URGING = frozenset("should must consider recommend strongly important essential crucial".split())


@dataclass(frozen=True)
class Constraint:
    type: str
    description: str
    min: int | None = None
    max: int | None = None
    count: int | None = None
    word: str | None = None
    terms: tuple[str, ...] = field(default=())


CONSTRAINT = T.StructType(
    [T.StructField(k, t) for k, t in (("type", T.StringType()), ("description", T.StringType()), ("min", T.LongType()), ("max", T.LongType()), ("count", T.LongType()), ("word", T.StringType()))]
    + [T.StructField("terms", T.ArrayType(T.StringType()))]
)
RESULT = T.StructType([T.StructField(k, t) for k, t in (("type", T.StringType()), ("description", T.StringType()), ("passed", T.BooleanType()), ("actual", T.StringType()), ("expected", T.StringType()), ("score", T.LongType()))])

Found = Iterator[Constraint]


def _counted(kind: str, unit: str, patterns: Iterable[str], low: str) -> Found:
    """Exact numbers and ranges of a unit, pattern by pattern."""
    for p in patterns:
        for m in re.finditer(p, low):
            if m.re.groups == 1:
                n = int(m[1])
                yield Constraint(f"{kind}_count_exact", f"Exactly {n} {unit}", count=n)
            else:
                yield Constraint(f"{kind}_count_range", f"{m[1]}–{m[2]} {unit}", min=int(m[1]), max=int(m[2]))


def _word_range(low: str) -> Found:
    for p in WORD_RANGES:
        for m in re.finditer(p, low):
            # a subject line's own limit is none of the text's
            if "subject" not in low[max(0, m.start() - 40) : m.start()]:
                yield Constraint("word_count_range", f"Word count must be {m[1]}–{m[2]}", min=int(m[1]), max=int(m[2]))
                return


def _phrases(text: str) -> Found:
    held = set()
    for i, p in enumerate((*PHRASES, INLINE_PHRASE)):
        inline = i == len(PHRASES)
        for m in re.finditer(p, text, re.IGNORECASE):
            phrase = m[1].strip()
            if any(x in text[max(0, m.start() - 20) : m.start()].lower() for x in EXAMPLE_MARKS) or not 2 < len(phrase) < 100 or (inline and phrase in held):
                continue
            held.add(phrase)
            yield Constraint("required_phrase", f'Must include{"" if inline else " phrase"}: "{phrase}"', word=phrase)


def _forbidden(text: str) -> Found:
    m = re.search(FORBIDDEN, text, re.IGNORECASE)
    for w in re.split(r"[,;]|\band\b|\bor\b", m[1]) if m else ():
        w = w.strip().strip("'\" ").strip()
        if 1 <= len(w) <= 20 and not w.startswith("the "):
            yield Constraint("forbidden_word", f'Must NOT use word: "{w}"', word=w.lower())


def _headings(text: str) -> Found:
    for p in HEADINGS:
        for block in re.findall(p, text, re.IGNORECASE | re.DOTALL):
            for h in re.split(r"[,\n.]", block):
                h = h.strip().strip(".-•*123456789)").strip()
                if 1 < len(h) < 50 and not h.lower().startswith("constraint"):
                    yield Constraint("required_heading", f'Must include heading: "{h}"', word=h)


def _subject(low: str) -> Found:
    if re.search(r"no\s+bullet\s*points?", low):
        yield Constraint("no_bullet_points", "No bullet points allowed")
    if re.search(r"(?:include|add)\s+(?:a\s+)?subject\s+line", low):
        yield Constraint("requires_subject_line", "Must include a subject line")
    m = re.search(r"subject\s+line\s*\(?\s*(?:max(?:imum)?|up to)\s+(\d+)\s+words?\s*\)?", low)
    if m:
        yield Constraint("subject_line_max_words", f"Subject line max {m[1]} words", max=int(m[1]))


def _tones(low: str) -> Found:
    for tone in TONES:
        word = re.escape(tone)
        if re.search(rf"(?:tone|keep|maintain|style|voice)[^.]*?{word}", low) or re.search(rf"{word}[^.]*?(?:tone|style)", low):
            yield Constraint("tone_requirement", f"Tone must be: {tone}", word=tone)


def _items(low: str) -> Found:
    for p in ITEM_COUNTS:
        for m in re.finditer(p, low):
            yield Constraint("item_count", f"Must include exactly {m[1]} {m[2]}", count=int(m[1]), word=m[2])
    m = re.search(r"each\s+(?:heading|section)\s+(?:must\s+)?(?:have|contain)\s+(?:exactly\s+)?(\d+)\s+sentences?", low)
    if m:
        yield Constraint("sentences_per_section", f"Each section must have exactly {m[1]} sentences", count=int(m[1]))


def _emails(text: str) -> Found:
    found = [m[1] for m in re.finditer(EMAIL, text, re.IGNORECASE)]
    if KNOWN_EMAIL in text and KNOWN_EMAIL not in found:
        found.append(KNOWN_EMAIL)
    for e in found:
        yield Constraint("required_email", f"Must include email: {e}", word=e)


def _terms(text: str) -> Found:
    m = re.search(TERMS, text, re.IGNORECASE)
    if m:
        n = m[1].lower()
        count = NUMBERS.get(n, int(n) if n.isdecimal() else None)
        terms = tuple(x.strip() for x in m[2].split(","))
        if count is not None:
            yield Constraint("technical_terms_required", f"Must include exactly {count} technical terms from: {', '.join(terms)}", count=count, terms=terms)
    listed = re.search(r"\{([^}]+)\}", text)
    if listed and re.search(NO_TERMS, text, re.IGNORECASE):
        terms = tuple(x.strip() for x in listed[1].split(","))
        yield Constraint("technical_terms_forbidden", f"Must include ZERO technical terms from: {', '.join(terms)}", terms=terms)


def _wholes(text: str, low: str) -> Found:
    """Constraints on the text as a whole."""
    m = re.search(FORMAT, text, re.IGNORECASE | re.DOTALL)
    if m:
        yield Constraint("output_format", f"Output format: {m[1].strip()}", word=m[1].strip())
    if re.search(r"(?:do not|don't)\s+include\s+apolog", low):
        yield Constraint("no_apologies", "Must not include apologies")
    if re.search(r"separated\s+by\s+semicolons?", low):
        yield Constraint("semicolon_separated", "Items must be separated by semicolons (not bullets)")
    if re.search(r"next\s+step", low):
        yield Constraint("requires_next_step", "Must include a clear next step")
    m = re.search(CONFIDENCE, text, re.IGNORECASE)
    if m:
        yield Constraint("confidence_statement", f'Must include a confidence statement (e.g., "{m[1].strip()}")', word=m[1].strip())


def _times(text: str, low: str, held: set[str]) -> Found:
    for d in re.findall(DURATION, text, re.IGNORECASE):
        if d not in held:
            held.add(d)
            yield Constraint("required_phrase", f'Must include: "{d}"', word=d)
    for t in TIMES:
        asked = re.search(rf"must\s+include[^.]*?{re.escape(t)}", text, re.IGNORECASE) or f'"{t}"' in low
        if asked and t.lower() not in {h.lower() for h in held}:
            held.add(t)
            yield Constraint("required_phrase", f'Must include phrase: "{t}"', word=t)


@functools.lru_cache(maxsize=1024)
def extract(prompt: str) -> tuple[Constraint, ...]:
    """The constraints of a prompt, the first of each kind and description, in the order of the kinds."""
    text = prompt.strip()
    low = text.lower()
    found = [*_word_range(low), *_counted("sentence", "sentences", SENTENCE_COUNTS, low), *_counted("paragraph", "paragraphs", PARAGRAPH_COUNTS, low)]
    found += [*_phrases(text), *_forbidden(text), *_headings(text), *_subject(low), *_tones(low), *_items(low), *_emails(text), *_terms(text), *_wholes(text, low)]
    found += _times(text, low, {c.word for c in found if c.type == "required_phrase"})
    return tuple({(c.type, c.description): c for c in reversed(found)}[k] for k in dict.fromkeys((c.type, c.description) for c in found))


class Text:
    """A text and what its checks share."""

    def __init__(self, text: str):
        self.text, self.low = text, text.lower()
        self.words = prose.words(text)

    @functools.cached_property
    def n_sentences(self) -> int:
        return len(prose.sentences(self.text))

    @functools.cached_property
    def n_paragraphs(self) -> int:
        return len(prose.paragraphs(self.text))

    @functools.cached_property
    def tones(self) -> dict[str, int]:
        formal, informal = (sum(w in x for w in self.words) for x in (L.FORMAL, L.INFORMAL))
        contractions = len(re.findall(r"\b\w+'\w+\b", self.text))
        within = lambda x: min(100, max(0, x))
        poised = within(50 + 10 * formal - 10 * informal - 5 * contractions)
        return {
            "professional": poised,
            "formal": poised,
            "neutral": 70 if formal < 5 and informal < 3 else 50,
            "informative": min(100, 50 + len(self.words) // 10),
            "non-accusatory": max(0, 100 - 30 * sum(w in ACCUSING for w in self.words)),
            "friendly": within(50 + 5 * informal - 3 * formal),
            "persuasive": min(100, 10 * max(0, 50 + sum(w in URGING for w in self.words))),
        }


#: What a check gives: found, wanted, kept to, score.
Outcome = tuple[str, str, bool, int]


def _within(n: int, unit: str, low: int | None, high: int | None, cost: float | None) -> Outcome:
    """A number between two bounds; outside, `cost` points for each time the bound that it misses it by, or half the points."""
    if low is not None and low == high:
        wanted = f"Exactly {low} {unit}"
    elif low is None:
        wanted = f"≤ {high} {unit}"
    elif high is None:
        wanted = f"≥ {low} {unit}"
    else:
        wanted = f"{low}–{high} {unit}"
    under, over = low is not None and n < low, high is not None and n > high
    kept = not under and not over
    bound = low if under else high
    score = 100 if kept else 50 if cost is None else max(0, round(100 - abs(n - bound) / max(bound, 1) * cost))
    return f"{n} {unit}", wanted, kept, score


def _yes(kept: bool, wanted: str, found: str = "Found", not_found: str = "Not found") -> Outcome:
    return found if kept else not_found, wanted, kept, 100 if kept else 0


def _heading(t: Text, c: Constraint) -> Outcome:
    line = rf"(?:^|\n)\s*(?:#+\s*|(?:\*\*|__))?{re.escape(c.word)}(?:\*\*|__)?[\s:]*(?:\n|$)"
    return _yes(bool(re.search(line, t.text, re.IGNORECASE | re.MULTILINE)) or c.word.lower() in t.low, f'Contains heading: "{c.word}"')


def _subject_words(t: Text, c: Constraint) -> Outcome:
    m = re.search(SUBJECT, t.text, re.IGNORECASE)
    wanted = f"Subject line ≤ {c.max} words"
    if not m:
        return "No subject line found", wanted, False, 0
    n = len(prose.words(m[1]))
    return f"{n} words", wanted, n <= c.max, 100 if n <= c.max else max(0, 100 - 30 * (n - c.max))


def _tone(t: Text, c: Constraint) -> Outcome:
    score = t.tones.get(c.word)
    return ("Tone not evaluated", f"Tone: {c.word}", True, 50) if score is None else (f"Tone score: {score}/100", f"Tone: {c.word}", score >= 50, score)


def _terms_held(t: Text, c: Constraint, most: int) -> Outcome:
    held = [x for x in c.terms if x.lower() in t.low]
    kept = len(held) == most
    if c.type == "technical_terms_forbidden":
        score = max(0, 100 - 30 * len(held))
        return f"Found {len(held)}: {held}" if held else "None found (good)", f"Zero terms from {list(c.terms)}", kept, score
    score = 100 if kept else max(0, round(100 - abs(len(held) - most) / most * 100)) if most else 0
    return f"Found {len(held)}: {held}", f"Exactly {most} terms from {list(c.terms)}", kept, score


def _item_count(t: Text, c: Constraint) -> Outcome:
    n = sum(bool(x.strip()) for x in t.text.split(";"))
    return f"~{n} items (semicolon-separated)", f"Exactly {c.count} {c.word}", n == c.count, max(0, 100 - 30 * abs(n - c.count))


def _sections(t: Text, c: Constraint) -> Outcome:
    sections, wanted = re.split(r"\n(?=[A-Z\*#])", t.text), f"{c.count} sentences per section"
    if len(sections) == 1:
        return "Could not detect sections", wanted, False, 50
    wrong = sum(len(x.strip()) > 10 and len(prose.sentences(x)) != c.count for x in sections)
    return f"{wrong} sections with wrong count" if wrong else "All sections correct", wanted, not wrong, max(0, 100 - 20 * wrong)


def _format(t: Text, c: Constraint) -> Outcome:
    if "a)" not in c.word.lower():
        return "Format check not specific", f"Format: {c.word}", False, 50
    a, b = (bool(re.search(rf"\b{x}\)", t.text)) for x in "AB")
    return f"A)={a}, B)={b}", f"Format: {c.word}", a and b, 50 * (a + b)


def _any(patterns: Iterable[str], low: str) -> bool:
    return any(re.search(p, low) for p in patterns)


CHECKS: dict[str, Callable[[Text, Constraint], Outcome]] = {
    "word_count_range": lambda t, c: _within(len(t.words), "words", c.min, c.max, 200),
    "word_count_max": lambda t, c: _within(len(t.words), "words", None, c.max, 200),
    "word_count_min": lambda t, c: _within(len(t.words), "words", c.min, None, 200),
    "word_count_exact": lambda t, c: _within(len(t.words), "words", c.count, c.count, 200),
    "sentence_count_exact": lambda t, c: _within(t.n_sentences, "sentences", c.count, c.count, 200),
    "sentence_count_range": lambda t, c: _within(t.n_sentences, "sentences", c.min, c.max, None),
    "paragraph_count_exact": lambda t, c: _within(t.n_paragraphs, "paragraphs", c.count, c.count, 150),
    "paragraph_count_range": lambda t, c: _within(t.n_paragraphs, "paragraphs", c.min, c.max, None),
    "required_phrase": lambda t, c: _yes(c.word.lower() in t.low, f'Contains: "{c.word}"'),
    "forbidden_word": lambda t, c: _yes(not re.search(rf"\b{re.escape(c.word)}\b", t.low), f'Does NOT contain: "{c.word}"', "Not found (good)", "Found (violation!)"),
    "required_heading": _heading,
    "no_bullet_points": lambda t, c: _yes(not re.search(r"^\s*(?:[-•*]|\d+[.)])\s+\S", t.text, re.MULTILINE), "No bullet points", "No bullet points (good)", "Has bullet points (violation!)"),
    "requires_subject_line": lambda t, c: _yes(bool(re.search(SUBJECT, t.text, re.IGNORECASE)), "Has subject line"),
    "subject_line_max_words": _subject_words,
    "tone_requirement": _tone,
    "technical_terms_required": lambda t, c: _terms_held(t, c, c.count),
    "technical_terms_forbidden": lambda t, c: _terms_held(t, c, 0),
    "item_count": _item_count,
    "sentences_per_section": _sections,
    "no_apologies": lambda t, c: _yes(not re.search(APOLOGY, t.low), "No apologies", "No apologies (good)", "Apology found (violation!)"),
    "semicolon_separated": lambda t, c: _yes(";" in t.text, "Items separated by semicolons", "Uses semicolons", "No semicolons found"),
    "requires_next_step": lambda t, c: _yes(_any(NEXT_STEPS, t.low), "Includes a next step", "Next step found", "No clear next step"),
    "confidence_statement": lambda t, c: _yes(_any(CONFIDENT, t.low), "Includes confidence statement", "Confidence statement found"),
    "required_email": lambda t, c: _yes(c.word.lower() in t.low, f"Contains: {c.word}"),
    "output_format": _format,
}


def check(text: str, constraints: Iterable[Constraint]) -> list[dict]:
    held, out = Text(text), []
    for c in constraints:
        actual, expected, passed, score = CHECKS[c.type](held, c)
        out.append({"type": c.type, "description": c.description, "passed": passed, "actual": actual, "expected": expected, "score": score})
    return out


def adherence(results: list[dict]) -> float:
    return round(sum(r["score"] for r in results) / len(results), 2) if results else 100.0


def constraints_of(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt") -> DataFrame:
    """keys and one row for each constraint of a prompt, in order (pos)."""
    keys = list(keys)
    picked = rows.select(*keys, F.coalesce(F.col(prompt).cast("string"), F.lit("")).alias("_p"))
    schema = T.StructType([*picked.schema.fields[:-1], T.StructField("found", T.ArrayType(CONSTRAINT))])

    def run(batches):
        for batch in batches:
            found = [[asdict(c) for c in extract(p)] for p in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, _arrow(CONSTRAINT))], names=[*keys, "found"])

    return picked.mapInArrow(run, schema).select(*keys, F.posexplode("found").alias("pos", "c")).select(*keys, "pos", "c.*")


def _arrow(kind: T.StructType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(T.ArrayType(kind))


def evaluate(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt", text: str = "text") -> DataFrame:
    """keys, results (array, one for each constraint of the row's prompt), constraint_score, n_constraints, n_passed."""
    keys = list(keys)
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((prompt, "_p"), (text, "_t"))]
    picked = rows.select(*keys, *known)
    schema = T.StructType([*picked.schema.fields[:-2], T.StructField("results", T.ArrayType(RESULT)), T.StructField("constraint_score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = [check(t, extract(p)) for p, t in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            made = [pa.array(found, _arrow(RESULT)), pa.array([adherence(x) for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=[*keys, "results", "constraint_score"])

    out = picked.mapInArrow(run, schema)
    return out.select("*", F.size("results").cast("long").alias("n_constraints"), F.size(F.filter("results", lambda r: r["passed"])).cast("long").alias("n_passed"))
