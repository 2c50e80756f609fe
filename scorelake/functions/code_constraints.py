"""What a programming prompt asks of the code, and whether the code keeps to it."""

from __future__ import annotations

import ast
import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

from .code_measures import _FUNCTIONS, _LOOPS, STANDARD, Source, documented, imported

# Words by which a prompt's task is known, the first that fits.
TASKS = (("debugging", ("fix", "bug", "debug", "broken", "incorrect")), ("optimization", ("refactor", "optimize", "rewrite", "improve")), ("design", ("class ", "design", "implement a python class")))
# Wordings of the requests.
REQUESTS = {
    "docstrings": ("add a docstring", "add docstring", "include docstring", "add type hints and a docstring", "add type hints and docstrings"),
    "type_hints": ("type hint",),
    "no_external": ("do not use external", "no external libraries", "without external libraries"),
    "edge_cases": ("edge case", "handle edge", "corner case", "empty input", "empty list"),
    "preserve": ("do not change the function signature", "preserve the original function name", "do not change the external api", "don't change the function signature"),
    "comments": ("inline comment", "add comments explaining"),
    "comprehensions": ("list comprehension",),
}
FORBIDDEN = (r"do not use\s+`?(\w+(?:\.\w+)?)`?", r"don't use\s+`?(\w+(?:\.\w+)?)`?", r"not use\s+`?(\w+(?:\.\w+)?)\(\)`?", r"without using\s+`?(\w+(?:\.\w+)?)`?")
FORBIDDEN_NAMES = ((("do not use `eval()`", "do not use eval"), ("eval",)), (("do not use `exec()`",), ("exec",)), (("do not use built-in sort", "do not use `sort`"), ("sort", "sorted")))
EDGE_SIGNS = (("len(", "== []", '== ""', "is none", "not ", "== {}", "== ()"), ("<= 0", "<= 1", "== 0", "== 1", "len("))
# Standard modules that a prompt against external libraries leaves out.
NOT_GRANTED = frozenset(
    """unicodedata calendar hmac secrets glob shutil tempfile pytest traceback threading multiprocessing concurrent asyncio socket http
    urllib email struct codecs pprint dis fractions""".split()
)


@dataclass(frozen=True)
class Asked:
    task_type: str
    signatures: tuple[str, ...]
    classes: tuple[str, ...]
    requests: frozenset[str]
    allowed: tuple[str, ...]
    forbidden: tuple[str, ...]
    raised: tuple[str, ...]
    stable_sort: bool
    complexity: str | None
    tests: str


def tests_of(prompt: str) -> str:
    """Lines of fenced blocks from the first assertion of each on, and loose lines of set-up after one."""
    kept, fenced, testing = [], False, False
    for line in prompt.split("\n"):
        bare = line.strip()
        if bare.startswith("```"):
            fenced, testing = not fenced, testing and not fenced
        elif fenced:
            begins = bare.startswith("assert ") or (testing and bare.startswith(("try:", "except ")))
            testing = testing or begins
            follows = kept and bare.startswith(("results", "em", "idx", "def ", "result"))
            if testing or follows:
                kept.append(line)
    return "\n".join(kept)


@functools.lru_cache(maxsize=1024)
def extract(prompt: str) -> Asked:
    low = prompt.lower()
    has = lambda words: any(w in low for w in words)
    allowed = re.findall(r"(?:stdlib\s+)?`(\w+)`\s+(?:is|are)\s+(?:allowed|fine|ok)", low)
    for inside in re.findall(r"\((?:stdlib\s+)?([^)]*(?:are|is)\s+(?:fine|allowed|ok))\)", low):
        allowed += [m for m in re.findall(r"`(\w+)`", inside) if m not in allowed]
    forbidden = [m for p in FORBIDDEN for m in re.findall(p, low) if m not in ("external", "libraries")]
    forbidden += [n for words, names in FORBIDDEN_NAMES if has(words) for n in names]
    raised = [e for e, words in (("ValueError", ("raise valueerror", "raise `valueerror`")), ("TypeError", ("raise typeerror",))) if has(words)]
    order = re.search(r"[oO]\(([^)]+)\)", prompt)
    return Asked(
        task_type=next((t for t, words in TASKS if has(words)), "implementation"),
        signatures=tuple(re.findall(r"def\s+(\w+)\s*\([^)]*\)", prompt)),
        classes=tuple(re.findall(r"class\s+(\w+)", prompt)),
        requests=frozenset(k for k, words in REQUESTS.items() if has(words)),
        allowed=tuple(allowed),
        forbidden=tuple(forbidden),
        raised=tuple(raised),
        stable_sort="stable" in low and "sort" in low,
        complexity=f"O({order[1]})" if order else None,
        tests=tests_of(prompt),
    )


def _raises(source: Source, error: str) -> bool:
    thrown = (n.exc.func if isinstance(n.exc, ast.Call) else n.exc for n in source.all(ast.Raise))
    return any(isinstance(x, ast.Name) and x.id == error for x in thrown)


def _listed(names: list[str]) -> str:
    return ", ".join(names[:5])


def _checks(source: Source, asked: Asked) -> Iterator[tuple[str, bool, str, str]]:
    """(name, kept, detail if kept, detail if not) of each check that the prompt calls for."""
    functions, classes = source.all(*_FUNCTIONS), source.all(ast.ClassDef)
    args = {f.name: [a.arg for a in f.args.args] for f in functions}
    yield "Syntax Valid", True, "Code parses without errors", ""
    for name in asked.signatures:
        yield f"Function `{name}` defined", name in args, f"Found with args: {args.get(name)}", f"Function `{name}` not found in code"
    for name in asked.classes:
        yield f"Class `{name}` defined", any(c.name == name for c in classes), "Found", f"Class `{name}` not found"
    if "docstrings" in asked.requests:
        bare = [d.name for d in (n for n in source.nodes if isinstance(n, (*_FUNCTIONS, ast.ClassDef))) if not documented(d)]
        yield "Docstrings present", not bare, f"All {len(functions) + len(classes)} definitions have docstrings", f"Missing docstrings: {_listed(bare)}"
    if "type_hints" in asked.requests:
        bare = [f.name for f in functions if f.returns is None and not any(a.annotation is not None and a.arg != "self" for a in f.args.args)]
        yield "Type hints present", not bare, f"All {len(functions)} functions have type hints", f"Missing type hints: {_listed(bare)}"
    if "no_external" in asked.requests:
        granted = (STANDARD - NOT_GRANTED) | set(asked.allowed)
        other = [m for _, m in imported(source.tree) if m.split(".")[0] not in granted]
        yield "No external libraries", not other, "Only stdlib imports found", f"External imports found: {', '.join(other)}"
    for name in asked.forbidden:
        used = bool(re.search(rf"(?:\b|\.){re.escape(name)}\s*\(", source.code))
        yield f"Does not use `{name}`", not used, f"No usage of `{name}` found", f"Found usage of forbidden function `{name}`"
    if "comments" in asked.requests:
        n = sum("#" in x and not x.strip().startswith("#") for x in source.code.split("\n"))
        yield "Inline comments", n >= 2, f"Found {n} inline comments", f"Only {n} inline comment(s) found; expected more"
    if "comprehensions" in asked.requests:
        yield "Uses comprehensions", bool(source.all(*_LOOPS)), "Found list/set/dict comprehensions", "No comprehensions found"
    for error in asked.raised:
        yield f"Raises `{error}`", _raises(source, error), f"Found raise {error}", f"No `raise {error}` found"
    if "preserve" in asked.requests:
        for name in asked.signatures:
            yield f"Signature preserved: `{name}`", name in args, "Original function signature maintained", f"Function `{name}` not found or renamed"
    if "edge_cases" in asked.requests:
        low = source.code.lower()
        n = sum(any(s in low for s in signs) for signs in EDGE_SIGNS) + ("return" in low and ("if not" in low or "if len" in low))
        yield "Edge case handling", n >= 2, f"Found {n} edge case handling patterns", f"Only {n} edge case pattern(s) detected"


def check(source: Source, asked: Asked) -> dict:
    """checks (name, status, detail), total, passed and score (share passed of 100); a heuristic that fails is `partial`."""
    if source.tree is None:
        return {"checks": [{"name": "Syntax Valid", "status": "fail", "detail": "Code doesn't parse"}], "total": 1, "passed": 0, "score": 0.0}
    rows = list(_checks(source, asked))
    miss = lambda name: "partial" if name == "Edge case handling" else "fail"
    checks = [{"name": name, "status": "pass" if kept else miss(name), "detail": yes if kept else no} for name, kept, yes, no in rows]
    passed = sum(kept for _, kept, _, _ in rows)
    return {"checks": checks, "total": len(rows), "passed": passed, "score": round(passed / len(rows) * 100, 1)}
