"""How far a summary keeps to the form that its prompt asks for.

Each signal is a wording in the prompt, what it looks for in the summary and a score of 0 to 1; the adherence is the mean of
the signals that the prompt calls for, null if it calls for none. Patterns of prompt and text are read row by row on Arrow
batches. Null prompts and summaries count as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pairs import sentences, tokens

# Wordings of the requests, and the marks looked for.
BULLET, NUMBERED = r"(?:^|\n)\s*[-•*]\s", r"(?:^|\n)\s*\d+[.)]\s"
HEADER = r"(?:^|\n)\s*(?:[A-Z][^.!?\n]{2,}:|\*\*[^*]+\*\*|#+\s)"
NAMES = r"((?:[A-Z][A-Za-z /&]*(?:,\s*)?){2,})"
WORD_LIMITS = (r"(\d+)\s*(?:words?)\s*(?:or\s*(?:less|fewer))?", r"(?:max|under|no more than|at most)\s*(\d+)\s*words?")
BRIEF, DETAILED = ("brief", "concise", "short", "succinct"), ("detailed", "comprehensive", "thorough")

SIGNALS = T.StructType(
    [T.StructField(k, T.BooleanType()) for k in ("bullet_points_requested", "bullet_points_found", "numbered_list_requested", "numbered_list_found", "word_limit_respected", "sections_requested", "headers_found", "brevity_requested", "detail_requested", "paragraph_format_requested")]
    + [T.StructField(k, T.LongType()) for k in ("bullet_count", "expected_bullet_count", "word_limit", "actual_word_count", "sentence_limit", "actual_sentence_count", "sections_found_count", "titled_bullets_found", "summary_word_count", "paragraph_count")]
    + [T.StructField(k, T.ArrayType(T.StringType())) for k in ("expected_sections", "expected_titled_bullets", "negative_constraints")]
    + [T.StructField("overall_adherence", T.DoubleType())]
)


def _near(n: int, wanted: int) -> float:
    """1 for the wanted number, less by the share it is missed by."""
    if n == wanted:
        return 1.0
    return max(0.0, 1 - abs(n - wanted) / wanted) if wanted else 0.0


def _named(pattern: str, prompt: str, low: str) -> tuple[list[str], int] | None:
    """Names listed in the prompt, and how many of them the text holds."""
    m = re.search(pattern + NAMES, prompt)
    if not m:
        return None
    names = [x.strip().lower() for x in m[1].split(",") if x.strip()]
    return names, sum(x in low for x in names)


def _signals(prompt: str, summary: str) -> Iterator[tuple[dict, float | None]]:
    """(what was found, score or None) of each request in the prompt."""
    asked, low, n = prompt.lower(), summary.lower(), len(tokens(summary))
    has = lambda words: any(w in asked for w in words)
    if "bullet" in asked:
        bullets = len(re.findall(BULLET, summary))
        yield {"bullet_points_requested": True, "bullet_points_found": bullets > 0, "bullet_count": bullets}, float(bullets > 0)
        m = re.search(r"(\d+)\s*bullet", asked)
        if m:
            yield {"expected_bullet_count": int(m[1])}, _near(bullets, int(m[1]))
    if has(("numbered", "number the")):
        found = bool(re.search(NUMBERED, summary))
        yield {"numbered_list_requested": True, "numbered_list_found": found}, float(found)
    limit = next((m for m in (re.search(p, asked) for p in WORD_LIMITS) if m), None)
    if limit:
        most = int(limit[1])
        score = 1.0 if n <= most else max(0.0, 1 - (n - most) / most) if most else 0.0
        yield {"word_limit": most, "actual_word_count": n, "word_limit_respected": n <= most}, score
    m = re.search(r"(\d+)\s*sentences?", asked)
    if m:
        held = len(sentences(summary))
        yield {"sentence_limit": int(m[1]), "actual_sentence_count": held}, _near(held, int(m[1]))
    sections = _named(r"(?:sections?|order)\s*[:\s]*", prompt, low)
    if sections:
        yield {"expected_sections": sections[0], "sections_requested": True, "sections_found_count": sections[1]}, sections[1] / len(sections[0]) if sections[0] else 0.0
    elif has(("section", "headings")):
        found = bool(re.search(HEADER, summary))
        yield {"sections_requested": True, "headers_found": found}, float(found)
    titled = _named(r"titled\s*:\s*", prompt, low)
    if titled:
        yield {"expected_titled_bullets": titled[0], "titled_bullets_found": titled[1]}, titled[1] / len(titled[0]) if titled[0] else 0.0
    if has(BRIEF):
        yield {"brevity_requested": True, "summary_word_count": n}, 1.0 if n < 200 else max(0.0, 1 - (n - 200) / 300)
    if has(DETAILED):
        yield {"detail_requested": True, "summary_word_count": n}, 1.0 if n > 100 else n / 100
    if "paragraph" in asked:
        blocks = sum(bool(p.strip()) for p in summary.split("\n\n"))
        yield {"paragraph_format_requested": True, "paragraph_count": blocks}, float(blocks >= 1)
    refused = re.findall(r"do\s+not\s+([^.!?\n]+)", asked)
    if refused:
        yield {"negative_constraints": refused}, None


def signals(prompt: str, summary: str) -> dict:
    out, scores = {}, []
    for found, score in _signals(prompt, summary):
        out |= found
        scores += [score] * (score is not None)
    return out | {"overall_adherence": round(sum(scores) / len(scores), 4) if scores else None}


def evaluate(rows: DataFrame, keys: Iterable[str], prompt: str = "prompt", summary: str = "summary") -> DataFrame:
    """keys and prompt_faithfulness, a struct of SIGNALS, null where the prompt doesn't ask."""
    from pyspark.sql.pandas.types import to_arrow_type

    keys, kind = list(keys), to_arrow_type(SIGNALS)
    known = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((prompt, "_p"), (summary, "_s"))]
    picked = rows.select(*keys, *known)

    def run(batches):
        for batch in batches:
            found = [signals(p, s) for p, s in zip(batch.column(len(keys)).to_pylist(), batch.column(len(keys) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, kind)], names=[*keys, "prompt_faithfulness"])

    return picked.mapInArrow(run, T.StructType([*picked.schema.fields[: len(keys)], T.StructField("prompt_faithfulness", SIGNALS)]))
