"""Chat formatting with linked tool calls.

A turn's text is a message as it stands, or a JSON object that carries tool use:

- {"tools": [{"name": ..., "parameters": {JSON schema}}]} declares tools for the conversation;
- {"tool_calls": [{"id": ..., "name": ..., "arguments": {...} or its JSON text}], "content": ...} calls them;
- {"tool_call_id": ..., "content": ...} is a call's result.

A result belongs to the nearest earlier call of its identifier in the conversation, or, where there is none, to the first later one; found
in runs of `RUN` turns first and then across runs, so that an identifier used in every turn isn't gathered in one task either. Calls
are joined with their tools by (conversation, name), by hash. Messages are ordered topologically: by turn, but a result that stands before its call comes behind it, and, where that message is a result placed later itself, behind
that one: a message's place, (place_turn, place_rank, turn), is the turn in which its chain of late calls begins and the number of
links from there, found by doubling over late messages alone, without sorting a conversation. Messages that wait for each other in a
circle stay at their turns. Arguments are checked against the tool's schema (JSON Schema's keywords for values, with $ref within
the schema; `format` is a note; a keyword or $ref that isn't followed is reported as unsupported). Each message is
serialised as canonical JSON: sorted keys, no spaces, characters as they are. A message is a row; no conversation is gathered in one task.

Defined results: text with NaN, an infinity or a number beyond a double's range is no JSON object; a lone surrogate is written as its
escape; a schema keyword with a value that it can't have is passed over, and a schema that can't be followed is reported as
malformed; a null text is empty content; a null role is "user"; text that isn't such a JSON object is plain content; of
tools that share a name the first turn's counts; every call counts, those with a repeated identifier, one that isn't a string (1 is not "1")
or none too; a result without its call is marked `orphan` and stays at its turn; a call
without result is marked `open`; rows with a null conv_id or turn are formatted and never linked; repeated rows are each
formatted; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from fractions import Fraction
from math import isfinite
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table

SALTS = 16
#: White space before a JSON object.
JSON_SPACE = " \t\n\r"
#: Turns within which calls and results are linked at once.
RUN = 1024
PART = "kind string, conv_id long, turn long, idx int, name string, key string, body string"


_SURROGATE = re.compile("[\ud800-\udfff]")


def _escaped(text: str) -> str:
    """Lone surrogates as JSON escapes, so that the text has a UTF-8 form."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(x) -> str:
    return _escaped(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    x = float(text)
    if not isfinite(x):
        raise ValueError("a number beyond a double's range")
    return x


def _loads(text):
    try:
        return json.loads(text, parse_float=_finite, parse_constant=_finite)
    except (ValueError, RecursionError):
        return None


def _key(x) -> str | None:
    """An identifier as a string; one that isn't a string differs from all that are."""
    return x if x is None or (isinstance(x, str) and not _SURROGATE.search(x)) else "\x00" + canonical(x)


_NUMBER = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": _NUMBER,
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}
#: By keyword: the kind of values it is for, and whether a value v keeps the limit x.
_LIMITS = {
    "minimum": ("number", lambda v, x: v >= x),
    "maximum": ("number", lambda v, x: v <= x),
    "exclusiveMinimum": ("number", lambda v, x: v > x),
    "exclusiveMaximum": ("number", lambda v, x: v < x),
    "multipleOf": ("number", lambda v, x: x <= 0 or isfinite(v) and (Fraction(str(v)) / Fraction(str(x))).denominator == 1),
    "minLength": ("string", lambda v, x: len(v) >= x),
    "maxLength": ("string", lambda v, x: len(v) <= x),
    "minItems": ("array", lambda v, x: len(v) >= x),
    "maxItems": ("array", lambda v, x: len(v) <= x),
    "minProperties": ("object", lambda v, x: len(v) >= x),
    "maxProperties": ("object", lambda v, x: len(v) <= x),
}
_UNSUPPORTED = ("unevaluatedProperties", "unevaluatedItems", "$dynamicRef", "$recursiveRef")


def _same(a, b) -> bool:
    """Equality of JSON values: 1 is 1.0 and isn't true."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _matches(pattern: str, text: str) -> bool | None:
    try:
        return re.search(pattern, text) is not None
    except re.error:
        return None


def _target(root, ref):
    """(schema,) that a $ref within the root names, else None."""
    if not isinstance(ref, str) or not (ref == "#" or ref.startswith("#/")):
        return None
    at = root
    for part in ref.split("/")[1:]:
        part = unquote(part).replace("~1", "/").replace("~0", "~")
        if isinstance(at, dict) and part in at:
            at = at[part]
        elif isinstance(at, list) and part.isdigit() and int(part) < len(at):
            at = at[int(part)]
        else:
            return None
    return (at,)


def violations(value, schema, at: str = "$", root=None, refs: tuple = ()) -> list[str]:
    """What of the schema the value breaks, as "place: rule". refs: those followed at this value, so that a circle ends."""
    if schema is False:
        return [f"{at}: false"]
    if not isinstance(schema, dict):
        return []
    root = schema if root is None else root
    has = lambda k, kind: isinstance(schema.get(k), kind)
    here = lambda x: violations(value, x, at, root, refs)
    below = lambda v, x, place: violations(v, x, place, root)
    found = [f"{at}: unsupported {k}" for k in _UNSUPPORTED if k in schema]
    if "$ref" in schema:
        ref, target = schema["$ref"], _target(root, schema["$ref"])
        if target is None:
            found.append(f"{at}: unsupported $ref")
        elif ref not in refs:
            found += violations(value, target[0], at, root, (*refs, ref))
    kind = schema.get("type")
    wanted = kind if isinstance(kind, list) else [kind] if isinstance(kind, str) else []
    if wanted and not any(k in _KINDS and _KINDS[k](value) for k in wanted):
        return [*found, f"{at}: type"]
    if has("enum", list) and not any(_same(value, x) for x in schema["enum"]):
        found.append(f"{at}: enum")
    if "const" in schema and not _same(value, schema["const"]):
        found.append(f"{at}: const")
    for k, (kind, keeps) in _LIMITS.items():
        # the booleans of older drafts make the limit beside them exclusive
        limit = schema.get({"exclusiveMinimum": "minimum", "exclusiveMaximum": "maximum"}[k]) if schema.get(k) is True and k.startswith("exclusive") else schema.get(k)
        if _NUMBER(limit) and _KINDS[kind](value) and not keeps(value, limit):
            found.append(f"{at}: {k}")
    if isinstance(value, str) and has("pattern", str):
        hit = _matches(schema["pattern"], value)
        if not hit:
            found.append(f"{at}: pattern" if hit is False else f"{at}: unsupported pattern")
    if isinstance(value, dict):
        known = schema["properties"] if has("properties", dict) else {}
        patterns = schema["patternProperties"] if has("patternProperties", dict) else {}
        found += [f"{at}.{k}: required" for k in (schema["required"] if has("required", list) else []) if k not in value]
        found += [f"{at}: unsupported pattern" for p in patterns if _matches(p, "") is None]
        for k, v in value.items():
            by = [known[k]] if k in known else []
            by += [x for p, x in patterns.items() if _matches(p, k)]
            for x in by:
                found += below(v, x, f"{at}.{k}")
            if not by and schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: additional")
            elif not by and has("additionalProperties", dict):
                found += below(v, schema["additionalProperties"], f"{at}.{k}")
            if "propertyNames" in schema and below(k, schema["propertyNames"], at):
                found.append(f"{at}.{k}: propertyNames")
        for word in ("dependentRequired", "dependentSchemas", "dependencies"):
            for k, x in schema[word].items() if has(word, dict) else ():
                if k in value:
                    found += [f"{at}.{n}: required" for n in x if n not in value] if isinstance(x, list) else here(x)
    if isinstance(value, list):
        fixed = schema["prefixItems"] if has("prefixItems", list) else schema["items"] if has("items", list) else []
        rest = schema.get("additionalItems") if has("items", list) else schema.get("items")
        for i, v in enumerate(value):
            found += below(v, fixed[i] if i < len(fixed) else rest, f"{at}[{i}]")
        if schema.get("uniqueItems") is True and any(_same(v, w) for i, v in enumerate(value) for w in value[:i]):
            found.append(f"{at}: uniqueItems")
        if "contains" in schema:
            n = sum(not below(v, schema["contains"], at) for v in value)
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            if _NUMBER(least) and n < least or _NUMBER(most) and n > most:
                found.append(f"{at}: contains")
    for x in schema["allOf"] if has("allOf", list) else ():
        found += here(x)
    if has("anyOf", list) and all(here(x) for x in schema["anyOf"]):
        found.append(f"{at}: anyOf")
    if has("oneOf", list) and sum(not here(x) for x in schema["oneOf"]) != 1:
        found.append(f"{at}: oneOf")
    if "not" in schema and not here(schema["not"]):
        found.append(f"{at}: not")
    if "if" in schema:
        found += here(schema.get("else" if here(schema["if"]) else "then"))
    return found


def _violations(value, schema) -> list[str]:
    try:
        return violations(value, schema)
    except RecursionError:
        return ["$: unsupported depth"]
    except (TypeError, ValueError, KeyError, AttributeError, ArithmeticError):
        return ["$: malformed schema"]


def _parts(batches):
    for batch in batches:
        rows = []
        for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x = _loads(text)
            if not isinstance(x, dict):
                continue
            for i, tool in enumerate(x["tools"] if isinstance(x.get("tools"), list) else []):
                if isinstance(tool, dict) and isinstance(tool.get("name"), str):
                    rows.append(("tool", conv, turn, i, _escaped(tool["name"]), None, canonical({} if tool.get("parameters") is None else tool["parameters"])))
            for i, call in enumerate(x["tool_calls"] if isinstance(x.get("tool_calls"), list) else []):
                if isinstance(call, dict):
                    args = call.get("arguments")
                    parsed = _loads(args) if isinstance(args, str) else args
                    rows.append(("call", conv, turn, i, _escaped(str(call.get("name"))), _key(call.get("id")), canonical(parsed if parsed is not None else args)))
            if x.get("tool_call_id") is not None:
                rows.append(("result", conv, turn, 0, None, _key(x["tool_call_id"]), None))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "conv_id", "turn", "idx", "name", "key", "body"])


def _checked(batches):
    for batch in batches:
        errors = []
        for body, schema in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            errors.append(["unknown tool"] if schema is None else [_escaped(e) for e in _violations(_loads(body), _loads(schema))])
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(errors, pa.list_(pa.string()))], names=["conv_id", "turn", "call", "errors"])


def _serialiser(batches):
    for batch in batches:
        out = []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            x = _loads(text) if text and text.lstrip(JSON_SPACE)[:1] == "{" else None
            message = {"role": role if role is not None else "user"}
            if isinstance(x, dict) and x.get("tool_call_id") is not None:
                message |= {"tool_call_id": x["tool_call_id"], "content": x.get("content", "")}
            elif isinstance(x, dict) and isinstance(x.get("tool_calls"), list):
                message |= {"content": x.get("content", ""), "tool_calls": [c | {"arguments": _loads(c["arguments"]) if isinstance(c.get("arguments"), str) and _loads(c["arguments"]) is not None else c.get("arguments")} if isinstance(c, dict) else c for c in x["tool_calls"]]}
            elif isinstance(x, dict) and isinstance(x.get("tools"), list):
                message |= {"content": x.get("content", ""), "tools": x["tools"]}
            else:
                message["content"] = text or ""
            out.append(canonical(message))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *batch.columns[4:], pa.array(out, pa.string())], names=["conv_id", "turn", *batch.schema.names[4:], "message"])


def _link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, key, result_turn, call for each result; call: the nearest before its turn, else the first at it or later, or null."""
    none = F.lit(None).cast("struct<turn:long,idx:int,h:long>")
    # at one turn results come first, as a call before them has an earlier turn
    both = calls.where("key is not null").select("conv_id", "key", F.col("call.turn").alias("at"), F.lit(1).alias("late"), "call")
    both = both.unionByName(results.select("conv_id", "key", F.col("result_turn").alias("at"), F.lit(0).alias("late"), none.alias("call")))
    both = both.withColumn("run", F.floor(F.col("at") / RUN))
    inside = Window.partitionBy("conv_id", "key", "run").orderBy("at", "late", "call")
    near = both.withColumn("before", F.last("call", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    near = near.withColumn("after", F.first("call", True).over(inside.rowsBetween(0, Window.unboundedFollowing))).where("late = 0")
    runs = Window.partitionBy("conv_id", "key").orderBy("run")
    far = both.groupBy("conv_id", "key", "run").agg(F.max("call").alias("hi"), F.min("call").alias("lo"))
    far = far.select(
        "conv_id", "key", "run", F.last("hi", True).over(runs.rowsBetween(Window.unboundedPreceding, -1)).alias("hi"), F.first("lo", True).over(runs.rowsBetween(1, Window.unboundedFollowing)).alias("lo")
    )
    out = near.join(far, ["conv_id", "key", "run"], "left")
    return out.select("conv_id", "key", F.col("at").alias("result_turn"), F.coalesce("before", "hi", "after", "lo").alias("call"))


def _places(late: DataFrame) -> DataFrame:
    """conv_id, turn, place_turn, place_rank for messages of late turns; late: conv_id, turn, call_turn, the turn at or after its own
    that a message waits for. Circles are left out."""
    steps = materialise(late.select("conv_id", "turn", F.col("call_turn").alias("root"), F.lit(1).alias("rank")).distinct(), "chat-late")
    reach, most = 1, steps.count()
    while True:
        further = steps.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("rank").alias("more"))
        joined = materialise(steps.join(further, ["conv_id", "root"], "left"), "chat-late")
        if reach > most or joined.where("next is not null").isEmpty():
            # whoever still waits after as many links as there are messages waits in a circle
            return joined.where("next is null").select("conv_id", "turn", F.col("root").alias("place_turn"), F.col("rank").alias("place_rank"))
        reach *= 2
        steps = joined.select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("rank") + F.coalesce("more", F.lit(0))).alias("rank"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, place_turn, place_rank, n_calls, n_open, orphan, errors, message for every row."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    tooled = rows.where(F.ltrim("text", F.lit(JSON_SPACE)).startswith("{") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    # a key may be written with escapes
    tooled = tooled.where(F.contains("text", F.lit("tool")) | F.contains("text", F.lit("\\u")))
    parts = materialise(tooled.select("conv_id", "turn", "text").mapInArrow(_parts, PART), "chat-parts")
    info = None
    if not parts.isEmpty():
        first = lambda df, by: df.groupBy("conv_id", by).agg(F.min_by(F.struct("turn", "idx", "name", "body"), F.struct("turn", "idx", "body")).alias("x"))
        tools = first(parts.where("kind = 'tool'"), "name").select("conv_id", "name", F.col("x.body").alias("schema"))
        calls = parts.where("kind = 'call'").select("conv_id", "turn", "idx", "name", "key", "body").distinct()
        calls = calls.withColumn("call", F.struct("turn", "idx", F.xxhash64("name", "key", "body").alias("h")))
        results = parts.where("kind = 'result'").select("conv_id", "key", F.col("turn").alias("result_turn")).distinct()
        linked = materialise(_link(calls.select("conv_id", "key", "call"), results), "chat-linked")
        # one conversation may call one tool in most of its turns
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        calls = calls.withColumn("salt", F.pmod(F.xxhash64("turn", "idx"), F.lit(SALTS)).cast("int"))
        checked = calls.join(tools.withColumn("salt", salt), ["conv_id", "name", "salt"], "left").select("conv_id", "turn", "call", "body", "schema")
        checked = checked.mapInArrow(_checked, "conv_id long, turn long, call struct<turn:long,idx:int,h:long>, errors array<string>")
        answered = linked.where("call is not null").select("conv_id", "call", F.lit(True).alias("answered")).distinct()
        by_call = checked.join(answered, ["conv_id", "call"], "left").groupBy("conv_id", "turn").agg(
            F.count("*").alias("n_calls"), F.sum(F.when(F.col("answered").isNull(), 1).otherwise(0)).alias("n_open"), F.array_sort(F.flatten(F.collect_list("errors"))).alias("errors")
        )
        by_result = linked.groupBy("conv_id", F.col("result_turn").alias("turn")).agg(F.max("call.turn").alias("call_turn"), F.lit(True).alias("is_result"))
        places = _places(by_result.where("call_turn >= turn").select("conv_id", "turn", "call_turn"))
        info = materialise(by_call.join(by_result, ["conv_id", "turn"], "full").join(places, ["conv_id", "turn"], "left"), "chat-links")
    else:
        info = turns.sparkSession.createDataFrame([], "conv_id long, turn long, n_calls long, n_open long, errors array<string>, call_turn long, is_result boolean, place_turn long, place_rank int")
    # (conv_id, turn) is nearly a key; a conversation that repeats its turns is salted
    salted = info.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = rows.withColumn("_salt", F.pmod(F.xxhash64("text", "role"), F.lit(SALTS)).cast("int")).join(salted, ["conv_id", "turn", "_salt"], "left")
    out = out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.coalesce("place_turn", "turn").alias("place_turn"),
        F.coalesce("place_rank", F.lit(0)).alias("place_rank"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open"),
        (F.coalesce("is_result", F.lit(False)) & F.col("call_turn").isNull()).alias("orphan"),
        F.concat_ws("; ", "errors").alias("errors"),
    )
    schema = "conv_id long, turn long, place_turn long, place_rank int, n_calls long, n_open long, orphan boolean, errors string, message string"
    return out.mapInArrow(_serialiser, schema)


def op9_linked_chats(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
