"""Words, sentences and paragraphs of prose as plain functions, equal to the columns of functions.text, for row kernels."""

from __future__ import annotations

import re

from .lexicons import ABBREVIATIONS
from .text import GREETING

_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")
_GUARD = "|".join(rf"(?<!{re.escape(a)}\.)" for a in ABBREVIATIONS).replace("|", "")
_END = re.compile(rf"(?<=[.!?]){_GUARD} (?=[A-Z\"'])")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def sentences(text: str) -> list[str]:
    out: list[str] = []
    for s in _END.split(re.sub(r"\s+", " ", text.strip())):
        if out and len(s.split()) <= 2 and s[-1:] not in (".", "!", "?"):
            out[-1] += " " + s
        else:
            out.append(s)
    return out


def paragraphs(text: str) -> list[str]:
    text = text.strip()
    blocks = [b for b in map(str.strip, re.split(r"\n\s*\n", text)) if len(b) >= 3]
    blocks = [b for b in blocks if "\n" in b or len(b.split()) > 4 or not re.match(GREETING, b.lower())]
    lines = [x for x in map(str.strip, text.split("\n")) if len(x) > 10]
    if len(blocks) <= 1 and len(lines) > 1:
        return lines
    return blocks or [text]
