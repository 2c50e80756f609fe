"""Measures of Python source text: one parse and one token list for each text, shared by all measures.

Source that doesn't parse (or holds null bytes, or nests beyond the parser's limits) has the values that each measure names for it.
"""

from __future__ import annotations

import ast
import difflib
import io
import json
import math
import re
import subprocess
import sys
import tokenize
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

# Keywords that count as operators.
KEYWORDS = frozenset(
    """and or not in is lambda if else elif for while def class return yield import from try except finally raise with as pass break
    continue del assert global nonlocal async await""".split()
)
# Modules that count as standard.
STANDARD = frozenset(
    """os sys math json csv re ast io copy collections itertools functools operator string textwrap unicodedata datetime time calendar
    hashlib hmac secrets random statistics pathlib glob shutil tempfile typing types abc dataclasses enum unittest doctest pytest
    logging warnings traceback threading multiprocessing concurrent asyncio socket http urllib email struct codecs pprint dis
    tokenize difflib heapq bisect contextlib decimal fractions""".split()
)
# Weights of the quality score.
QUALITY = {"maintainability": 0.15, "complexity": 0.10, "documentation": 0.15, "structure": 0.05, "dry": 0.05, "test_pass_rate": 0.35, "similarity": 0.15}

_BRANCHES = (ast.If, ast.For, ast.While, ast.And, ast.Or, ast.ExceptHandler, ast.With, ast.Assert, ast.IfExp)
_LOOPS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)
_BLOCKS = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.ExceptHandler)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LAYOUT = (tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING)


def documented(node: ast.AST) -> bool:
    body = getattr(node, "body", None)
    return bool(body) and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant)


def imported(tree: ast.AST) -> Iterator[tuple[bool, str]]:
    """(is a from-import, module) of each import."""
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from ((False, a.name) for a in node.names)
        elif isinstance(node, ast.ImportFrom) and node.module:
            yield True, node.module


class Source:
    def __init__(self, code: str | None):
        self.code = code or ""

    @cached_property
    def tree(self) -> ast.AST | None:
        import warnings

        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse(self.code)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    @cached_property
    def nodes(self) -> list[ast.AST]:
        return list(ast.walk(self.tree)) if self.tree else []

    def all(self, *kinds) -> list:
        return [n for n in self.nodes if isinstance(n, kinds)]

    @cached_property
    def tokens(self) -> list[tokenize.TokenInfo] | None:
        """Tokens but for layout and comments; None if the text can't be tokenized."""
        try:
            return [t for t in tokenize.generate_tokens(io.StringIO(self.code).readline) if t.type not in _LAYOUT]
        except (tokenize.TokenError, SyntaxError, ValueError):
            return None

    @cached_property
    def words(self) -> list[str]:
        return [t.string for t in self.tokens] if self.tokens is not None else re.findall(r"\w+|[^\s\w]", self.code)

    def lines(self) -> dict:
        rows = [x.strip() for x in self.code.split("\n")]
        blank, comments = sum(not x for x in rows), sum(x.startswith("#") for x in rows)
        texts = [n.body[0] for n in self.all(*_FUNCTIONS, ast.ClassDef, ast.Module) if documented(n)]
        documentation = sum(x.end_lineno - x.lineno + 1 for x in texts)
        sloc = max(len(rows) - blank - comments - documentation, 0)
        return {"total_loc": len(rows), "sloc": sloc, "blank_lines": blank, "comment_lines": comments, "docstring_lines": documentation, "code_to_comment_ratio": round(sloc / max(comments + documentation, 1), 2)}

    def complexity(self) -> dict:
        if self.tree is None:
            return {"cyclomatic_complexity": None, "decision_points": None, "risk_category": "parse_error"}
        points = len(self.all(*_BRANCHES)) + sum(len(n.generators) for n in self.all(*_LOOPS))
        risk = next((name for most, name in ((5, "low"), (10, "moderate"), (20, "high")) if points + 1 <= most), "very_high")
        return {"cyclomatic_complexity": points + 1, "decision_points": points, "risk_category": risk}

    def halstead(self) -> dict:
        names = ("vocabulary", "length", "volume", "difficulty", "effort", "time", "bugs", "unique_operators", "unique_operands", "total_operators", "total_operands")
        if self.tokens is None:
            return dict.fromkeys((f"halstead_{x}" for x in names))
        acts = Counter(t.string for t in self.tokens if t.type == tokenize.OP or (t.type == tokenize.NAME and t.string in KEYWORDS))
        things = Counter(t.string for t in self.tokens if t.type in (tokenize.NUMBER, tokenize.STRING) or (t.type == tokenize.NAME and t.string not in KEYWORDS))
        n1, n2, t1, t2 = len(acts), len(things), acts.total(), things.total()
        volume = (t1 + t2) * math.log2(n1 + n2) if n2 else 0
        difficulty = n1 / 2 * (t2 / n2) if n2 else 0
        effort = difficulty * volume
        values = (n1 + n2, t1 + t2, round(volume, 2), round(difficulty, 2), round(effort, 2), round(effort / 18, 2), round(volume / 3000, 4), n1, n2, t1, t2)
        return {f"halstead_{k}": v for k, v in zip(names, values, strict=True)}

    def shape(self, most: int = 15) -> dict:
        if self.tree is None:
            return {"ast_node_count": None, "ast_max_depth": None, "ast_avg_branching_factor": None, "ast_node_types": {}, "parse_success": False}
        kinds, depth, widths, stack = Counter(), 0, [], [(self.tree, 0)]
        while stack:
            node, level = stack.pop()
            kinds[type(node).__name__] += 1
            depth = max(depth, level)
            below = list(ast.iter_child_nodes(node))
            widths += [len(below)] * bool(below)
            # the first child is taken next: kinds of one number stay in the order of the text
            stack.extend((x, level + 1) for x in reversed(below))
        return {"ast_node_count": kinds.total(), "ast_max_depth": depth, "ast_avg_branching_factor": round(sum(widths) / max(len(widths), 1), 2), "ast_node_types": dict(kinds.most_common(most)), "parse_success": True}

    def maintainability(self) -> dict:
        volume = max(self.halstead()["halstead_volume"] or 1, 1)
        branching = self.complexity()["cyclomatic_complexity"] or 1
        index = max(0, (171 - 5.2 * math.log(volume) - 0.23 * branching - 16.2 * math.log(max(self.lines()["sloc"], 1))) * 100 / 171)
        rating = next((name for least, name in ((85, "highly_maintainable"), (65, "moderately_maintainable"), (40, "low_maintainability")) if index >= least), "unmaintainable")
        return {"maintainability_index": round(index, 2), "mi_rating": rating}

    def structure(self) -> dict:
        functions, classes = self.all(*_FUNCTIONS), self.all(ast.ClassDef)
        within = {id(n) for c in classes for n in ast.walk(c) if isinstance(n, _FUNCTIONS)}
        # a method of a nested class counts once for each class around it
        methods = sum(isinstance(n, _FUNCTIONS) for c in classes for n in ast.walk(c))
        told = sum(map(documented, functions + classes))
        hinted = sum(any(a.annotation is not None for a in f.args.args) for f in functions)
        return {
            "function_count": sum(id(f) not in within for f in functions),
            "class_count": len(classes),
            "method_count": methods,
            "async_function_count": len(self.all(ast.AsyncFunctionDef)),
            "lambda_count": len(self.all(ast.Lambda)),
            "functions_with_docstrings": told,
            "functions_with_type_hints": hinted,
            "functions_with_return_type": sum(f.returns is not None for f in functions),
            "docstring_coverage": round(told / max(len(functions) + len(classes), 1) * 100, 1),
            "type_hint_coverage": round(hinted / max(len(functions), 1) * 100, 1),
        }

    def nesting(self) -> dict:
        if self.tree is None:
            return {"max_nesting_depth": None, "avg_nesting_depth": None}
        depths, stack = [], [(self.tree, 0)]
        while stack:
            node, level = stack.pop()
            if isinstance(node, _BLOCKS):
                level += 1
                depths.append(level)
            stack.extend((x, level) for x in ast.iter_child_nodes(node))
        return {"max_nesting_depth": max(depths, default=0), "avg_nesting_depth": round(sum(depths) / max(len(depths), 1), 2)}

    def identifiers(self) -> dict:
        of = {ast.Name: "id", ast.FunctionDef: "name", ast.AsyncFunctionDef: "name", ast.ClassDef: "name", ast.arg: "arg"}
        names = [x for x in (getattr(n, of[type(n)]) for n in self.nodes if type(n) in of) if not x.startswith("__")]
        n, short = max(len(names), 1), sum(len(x) == 1 for x in names)
        return {
            "total_identifiers": len(names),
            "avg_identifier_length": round(sum(map(len, names)) / n, 2),
            "single_char_identifiers": short,
            "single_char_ratio": round(short / n * 100, 1),
            "snake_case_ratio": round(sum(bool(re.match(r"[a-z_][a-z0-9_]*$", x)) for x in names) / n * 100, 1),
        }

    def imports(self) -> dict:
        found = list(imported(self.tree)) if self.tree else []
        roots = {m.split(".")[0] for _, m in found}
        return {
            "import_count": sum(not f for f, _ in found),
            "from_import_count": sum(f for f, _ in found),
            "total_imports": len(found),
            "external_libs": sorted(roots - STANDARD),
            "stdlib_imports": sorted(roots & STANDARD),
            "uses_external_libs": bool(roots - STANDARD),
        }

    def errors(self) -> dict:
        handlers = self.all(ast.ExceptHandler)
        return {"try_blocks": len(self.all(ast.Try)), "except_handlers": len(handlers), "raise_statements": len(self.all(ast.Raise)), "bare_excepts": sum(h.type is None for h in handlers), "assert_statements": len(self.all(ast.Assert))}

    def repetition(self, least: int = 3) -> dict:
        """Runs of `least` lines or more that come again, blank lines and comments left out.

        Every run's place in a numbering of equal runs of its length gives that of the next length, so that no run is built."""
        lines = [x for x in map(str.strip, self.code.split("\n")) if x and not x.startswith("#")]
        n = len(lines)
        if n < 2 * least:
            return {"duplicate_blocks": 0, "duplicate_lines": 0, "dry_score": 100.0}
        base = {x: i for i, x in enumerate(dict.fromkeys(lines))}
        number = last = [base[x] for x in lines]
        blocks, dirty = 0, set()
        for size in range(2, n // 2 + 1):
            keys = list(zip(number, last[size - 1 :], strict=False))
            first: dict[tuple, int] = {}
            number = [first.setdefault(k, i) for i, k in enumerate(keys)]
            if size >= least:
                again = [(i, f) for i, f in enumerate(number) if f != i]
                if not again:
                    break  # no longer run can come again either
                blocks += len(again)
                for i, f in again:
                    dirty.update(range(i, i + size))
                    dirty.update(range(f, f + size))
        return {"duplicate_blocks": blocks, "duplicate_lines": len(dirty), "dry_score": round(max(0, 100 - len(dirty) / n * 100), 2)}

    def measures(self) -> dict[str, dict]:
        return {
            "line_metrics": self.lines(),
            "cyclomatic": self.complexity(),
            "halstead": self.halstead(),
            "ast_metrics": self.shape(),
            "maintainability": self.maintainability(),
            "structure": self.structure(),
            "nesting": self.nesting(),
            "identifiers": self.identifiers(),
            "imports": self.imports(),
            "error_handling": self.errors(),
            "dry": self.repetition(),
        }


SIMILARITIES = ("jaccard_similarity", "sequence_match_ratio", "structural_similarity", "token_sequence_similarity", "combined_similarity")


def similarity(a: Source, b: Source) -> dict[str, float]:
    """How alike two sources are: token sets, characters, kinds of syntax nodes, token sequences, and a blend."""
    alike = lambda x, y: difflib.SequenceMatcher(None, x, y).ratio()
    s, t = set(a.words), set(b.words)
    parts = [len(s & t) / len(s | t) if s or t else 1.0, alike(a.code.strip(), b.code.strip())]
    kinds = [[type(n).__name__ for n in x.nodes] for x in (a, b)]
    parts += [alike(*kinds) if a.tree and b.tree else 0.0, alike(a.words, b.words)]
    parts.append(sum(w * x for w, x in zip((0.25, 0.30, 0.25, 0.20), parts, strict=True)))
    return {k: round(v, 4) for k, v in zip(SIMILARITIES, parts, strict=True)}


def test_blocks(tests: str) -> list[str]:
    """Blocks that begin with an assertion or a try; lines before the first are no test."""
    blocks: list[list[str]] = []
    for line in tests.split("\n"):
        if line.strip().startswith(("assert ", "try:")):
            blocks.append([line])
        elif blocks:
            blocks[-1].append(line)
    return ["\n".join(b) for b in blocks]


_RUNNER = """
import json, math, sys
code, blocks = json.load(sys.stdin)
out, sys.stdout = sys.stdout, sys.stderr
space = {}
def report(**row):
    out.write(json.dumps(row) + "\\n"); out.flush()
try:
    exec(code, space)
except BaseException as e:
    report(test="code_execution", status="error", message=str(e)); sys.exit()
space.update(math=math, isclose=math.isclose)
for block in blocks:
    row = {"test": block.strip()[:80], "status": "passed", "message": None}
    try:
        exec(block, space)
    except AssertionError as e:
        row.update(status="failed", message=str(e))
    except BaseException as e:
        row.update(status="error", message=str(e))
    report(**row)
"""


def run_tests(code: str, tests: str, seconds: float = 10.0, memory: int = 1 << 30) -> dict:
    """Outcomes of the test blocks, run on the code in a process of its own, in isolated mode, without the environment, with
    limits of time and memory. A block that the process doesn't live to answer is an error."""
    blocks = test_blocks(tests)
    out: dict = {"total": 0, "passed": 0, "failed": 0, "errors": 0, "pass_rate": 0.0, "details": []}
    if not tests.strip():
        return out

    def limit():
        import resource

        resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
        resource.setrlimit(resource.RLIMIT_CPU, (int(seconds) + 1, int(seconds) + 1))

    with subprocess.Popen([sys.executable, "-I", "-c", _RUNNER], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, env={}, preexec_fn=limit) as run:
        try:
            answer = run.communicate(json.dumps([code, blocks]), timeout=seconds)[0]
        except subprocess.TimeoutExpired:
            run.kill()
            answer = run.communicate()[0]
    rows = [json.loads(x) for x in (answer or "").splitlines()]
    if rows and rows[0]["test"] == "code_execution":
        return out | {"errors": 1, "details": rows}
    rows += [{"test": b.strip()[:80], "status": "error", "message": "stopped"} for b in blocks[len(rows) :]]
    count = Counter(r["status"] for r in rows)
    rate = round(count["passed"] / len(rows) * 100, 1) if rows else 0.0
    return {"total": len(rows), "passed": count["passed"], "failed": count["failed"], "errors": count["error"], "pass_rate": rate, "details": rows}


def quality(found: dict[str, dict], alike: float | None, pass_rate: float) -> dict[str, float]:
    """The parts of the quality score and overall, from the measures as rounded."""
    parts = {
        "maintainability": min(found["maintainability"]["maintainability_index"], 100),
        "complexity": max(0, 100 - 5 * ((found["cyclomatic"]["cyclomatic_complexity"] or 10) - 1)),
        "documentation": found["structure"]["docstring_coverage"] * 0.6 + found["structure"]["type_hint_coverage"] * 0.4,
        "structure": max(0, 100 - 15 * (found["nesting"]["max_nesting_depth"] or 0)),
        "dry": found["dry"]["dry_score"],
        "test_pass_rate": pass_rate,
        "similarity": 50 if alike is None else alike * 100,
    }
    return {k: round(float(v), 2) for k, v in parts.items()} | {"overall": round(sum(parts[k] * w for k, w in QUALITY.items()), 2)}
