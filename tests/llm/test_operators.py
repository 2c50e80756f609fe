"""Small fixtures of the training-data operators: round trips, brute force, and odd rows."""

from __future__ import annotations

import json
import re
from collections import Counter

import numpy as np
import pytest

from scorelake.llm import chat, mixing, near_dedup, nearest, packing, pages, quality, repair_files, rules, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "one two three", "a b c d e f g h i a b c d e f g h i", "x\nx\n\ny # |\n x", "é " * 30, "word " * 3000, "one two three", " \t\r\n"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(500)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)]
    for i in range(20):
        words = list(rng.choice(vocab, 120))
        rows.append((100 + 2 * i, " ".join(words), "de", None, 0))
        words[-1] = "other"
        rows.append((101 + 2 * i, " ".join(words), "de", "t", 0))
    return spark.createDataFrame([*rows, (None, "no id at all", None, "s", None), rows[2]], DOC)


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 40, n).astype(np.uint32) for n in (0, 1, 2, 5000, 3, 1)]
    docs = [np.concatenate([d, np.array([1], np.uint32)]) for d in docs] + [np.full(999, 7, np.uint32)]
    block = repair_files.Block(repair_files.encode_block([None, *range(6)], docs))
    assert len(block.symbols) < sum(map(len, docs))
    assert all(np.array_equal(block.ids(i), d) for i, d in enumerate(docs))
    assert all(np.array_equal(a, b) for a, b in zip(block.all(), docs, strict=True))
    expansion = [len(block._expand(np.array([block.base + i], np.uint32))) for i in range(len(block.rules))]
    assert expansion == block.sizes.tolist()


def test_token_files(spark, docs, tmp_path):
    repair_files.write(docs, str(tmp_path / "f"), block=500, shard=2000)
    got = repair_files.read(spark, str(tmp_path / "f")).collect()
    enc = repair_files.encoder(repair_files.default_path("word_bpe_49k.json"))
    want = Counter((r["doc_id"], enc.by_library([r["text"] or ""])[0].astype("<u4").tobytes() + b"\1\0\0\0") for r in docs.collect())
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == want
    got.sort(key=lambda r: r["start"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert [r["doc_id"] for r in got if r["doc_id"] is not None] == sorted(r["doc_id"] for r in got if r["doc_id"] is not None)


def _base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(docs):
    for r, d in zip(rules.statistics(docs).collect(), docs.collect(), strict=True):
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == _base(d["text"])


def test_binomial_tail(spark):
    from math import comb

    cases = [(0, 10, 0.1), (3, 200, 0.05), (9, 10, 0.5), (0, 1, 0.02), (40, 3000, 0.02)]
    for k, n, p in cases:
        got = spark.range(1).select(rules.binomial_tail(rules.F.lit(k).cast("long"), rules.F.lit(n).cast("long"), p)).first()[0]
        want = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert got == pytest.approx(want, rel=1e-9)


def test_packing(docs):
    path = packing.default_path("byte_bpe_50k.json")
    got = packing.pack_documents(docs, capacity=128).toPandas()
    assert got["length"].max() <= 128
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 128
    enc = packing.encoder(path)
    total = sum(len(enc.by_library([r["text"] or ""])[0]) + 1 for r in docs.collect())
    assert got["length"].sum() == total


def test_mixing(docs):
    got = mixing.mix(docs).toPandas()
    assert len(got) == docs.count() and (got["taken"] <= 2 * got["size"]).all()


def test_near_duplicates(docs):
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    for i in range(20):
        assert got[100 + 2 * i] == got[101 + 2 * i] == 100 + 2 * i
    assert got[2] == got[7] == 2 and got[0] == 0 and got[1] == 1


def test_near_duplicates_against_all_pairs(spark):
    """Texts that share a long passage but differ enough, beside real near copies: buckets that hold many classes."""
    rng = np.random.default_rng(8)
    passage = [f"p{k}" for k in range(100)]
    texts = []
    for i in range(90):
        own = [f"o{k}" for k in rng.integers(0, 9000, int(rng.integers(5, 60)))]
        texts.append(passage[: int(rng.integers(60, 100))] + own)
    texts += [t[:-1] + ["x"] for t in texts[:20]]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    assert got == dict(enumerate(label)) and len(set(label)) > 20

    # the exact join of what the buckets leave, on its own: every similar pair of different components
    h = [sorted({hash(x) % (1 << 62) for x in s}) for s in sets]
    members = spark.createDataFrame([(i, len(x), 0) for i, x in enumerate(h)], "rep long, n_sh long, h long")
    own = spark.createDataFrame([(i, x) for i, x in enumerate(h)], "id long, sh array<long>")
    none = spark.createDataFrame([], "id long, label long")
    found = {(r["a"], r["b"]) for r in near_dedup._verify(near_dedup._rest_pairs(members, none, own, 0.8), own, 0.8).collect()}
    assert found == {(a, b) for b in range(len(h)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[50:150] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (420, [0.0] * 8), (440, [float("nan")] * 8), (None, [1.0] * 8)]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5, per_list=400, groups=3, unit=40).toPandas()
    ids = np.arange(300)
    for q, g in got.groupby("query_id"):
        s = (x.astype(float) * x[q].astype(float)).sum(axis=1)
        s[q] = -np.inf
        assert g.sort_values("rank")["vec_id"].tolist() == ids[np.lexsort((ids, -s))][:5].tolist()
    assert set(got["query_id"]) == set(range(0, 300, 20))


def test_nearest_with_many_lists(spark):
    """Clustered vectors: few lists are probed, units and query blocks are cut, and at least 0.9 of the neighbours are found."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(40, 16)).repeat(100, axis=0) + 0.3 * rng.normal(size=(4000, 16))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, list int")
    index = nearest.Index(x.astype(float), len(x), 10)
    assert len(index.lists) > 100 and index.probed < len(index.lists) / 2
    got = nearest.search(table, k=10, unit=20, query_block=50).toPandas()
    found = []
    for q, g in got.groupby("query_id"):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        found.append(len(set(g["vec_id"]) & set(np.argsort(-s)[:10])) / 10)
        assert np.allclose(g.sort_values("rank")["score"], np.sort(s[g["vec_id"]])[::-1], atol=1e-12)
    assert len(found) == 200 and np.mean(found) >= 0.9


def test_page_text(spark):
    page = "<html><body><nav>a</nav><div class='sidebar x'>b</div><article><header><h1>T &amp; U</h1></header><p>one<br>two <b>three</b><p>four<div id='comments'>c</div><form>f</form></article><footer>z"
    rows = [(1, "http://h/1", page), (2, None, None), (3, "http://h/2", ""), (4, "http://h/3", "plain <"), (5, "http://h/4", "<div>t<script>never")]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T & U\none two three\nfour", 2: "", 3: "", 4: "plain <", 5: "t"}


def test_style_tree_removes_template(spark):
    rows = [(i, f"http://site/{i}", f"<body><div class='k'><p>same on each page</p></div><div class='b'><p>text number {i}</p></div>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text number {i}" for i in range(12)}


def test_chats(spark):
    tool = {"tools": [{"name": "f", "parameters": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}}]}
    call = {"tool_calls": [{"id": "1", "name": "f", "arguments": '{"a": "x"}'}, {"id": "2", "name": "g", "arguments": {}}]}
    rows = [(1, 0, "system", json.dumps(tool)), (1, 1, "tool", '{"tool_call_id": "1", "content": "late"}'), (1, 2, "assistant", json.dumps(call)), (1, 3, "tool", '{"tool_call_id": "9"}'), (1, 4, None, None), (None, 5, "user", "{x")]
    got = {r["turn"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1]["place_turn"], got[1]["place_rank"]) == (2, 1) and got[3]["orphan"]
    assert (got[2]["n_calls"], got[2]["n_open"], got[2]["errors"]) == (2, 1, "$.a: type; unknown tool")
    assert got[4]["message"] == '{"content":"","role":"user"}' and got[5]["message"] == '{"content":"{x","role":"user"}'


def test_classifiers(spark, docs):
    labels = spark.createDataFrame([(100 + i, i % 2, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int")
    scored = quality.quality_scores(docs, quality.fit(docs, labels)).toPandas()
    assert len(scored) == docs.count() and scored["score"].between(0, 1).all()
    tox = toxicity.toxicity_scores(docs, toxicity.fit(docs, labels)).toPandas()
    assert len(tox) == docs.count() and tox["p_toxic"].between(0, 1).all()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOC)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_dedup.near_duplicates(none).count() == 0
    repair_files.write(none, str(tmp_path / "none"))
    assert repair_files.read(spark, str(tmp_path / "none")).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack_documents(none).count() == 0
    assert rules.judge(rules.statistics(none), rules.levels(rules.statistics(none), labels)).count() == 0
    assert quality.quality_scores(none, quality.fit(none, labels)).count() == 0
    assert toxicity.toxicity_scores(none, toxicity.fit(none, labels)).count() == 0
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_toxic_words_that_count_only_when_they_keep_coming(spark):
    """A word beginning that clean texts hold once marks the texts that hold it again and again."""
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(600):
        words = [f"w{k}" for k in rng.integers(0, 300, 80)]
        toxic = i % 6 == 0
        for at in rng.choice(80, 5 if toxic else i % 3, replace=False)[: 5 if toxic else 1]:
            words[at] = f"bomen{rng.integers(0, 40)}"
        rows.append((i, " ".join(words), "es", "s", 0))
        marks.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, DOC)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = toxicity.fit(docs.where("doc_id < 400"), labels.where("doc_id < 400"))
    got = {r["doc_id"]: r["toxic"] for r in toxicity.toxicity_scores(docs.where("doc_id >= 400"), chain).collect()}
    assert got == {i: i % 6 == 0 for i in range(400, 600)}


def test_style_tree_within_articles(spark):
    """Repeated blocks in an article go, with a class of their own or as lines among others; the article's own text stays."""
    page = "<body><article><h1>Title {0}</h1><p>Read our other titles too.</p><p>text number {0}</p><div class='k'><p>same on each page</p></div></article></body>"
    rows = [(i, f"http://site/{i}", page.format(i)) for i in range(12)]
    rows += [(20 + i, "http://copies/", f"<nav>{i}</nav><main><p>one text on all pages</p></main>") for i in range(6)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\ntext number {i}" for i in range(12)} | {20 + i: "one text on all pages" for i in range(6)}


def test_names_above_articles_and_on_headings():
    text = lambda page: pages.blocks(pages.parse(page))
    for name in ("site has-sidebar", "no-sidebar", "header-fixed page"):
        assert text(f"<body><div class='{name}'><nav>n</nav><div class='sidebar'>s</div><article><p>text</article></div>") == ["text"]
        assert text(f"<body><main><div class='{name}'><article><p>text</article></div></main>") == ["text"]
    assert text("<body><div class='no-sidebar'><article class='post category-social'><p>text</article></div>") == ["text"]
    heads = "<header class='entry-header'><h1>a</h1></header><div class='banner'><h1>x</h1></div><h2 class='section-header'>b <span class='header-text'>c</span></h2><div class='section-header'><h3>d</h3></div>"
    assert text(f"<body><article>{heads}<p>text</article>") == ["a", "b c", "d", "text"]
    assert text("<body><article><div class='banner'><h1>a</h1></div><p>text</article>") == ["a", "text"]
    # what names marked rightly stays marked
    comments = "<div id='comments'><article class='comment'><p>c</article></div>"
    assert text(f"<body><header>h</header><div class='header'>h</div><main><article><p>text</p>{comments}<div class='related'><h3>r</h3></div></article>{comments}</main><div class='footer'>z") == ["text"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_as_in_the_library(name):
    from tokenizers import Tokenizer

    path = packing.default_path(name)
    library, enc = Tokenizer.from_file(path), packing.encoder(path)
    texts = ["plain first", "see <|endoftext|> here", "<|startoftext|>é<|endoftext|>", "<|ENDOFTEXT|> <|endoftext"]
    assert [x.tolist() for x in enc.many(texts)] == [library.encode(x, add_special_tokens=False).ids for x in texts]


def test_chats_with_repeated_identifiers(spark):
    tool = {"tools": [{"name": "f", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}]}
    call = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": "f", "arguments": {"a": a}} for i, a in calls]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": "r"})
    texts = {0: json.dumps(tool), 1: call(("call_0", 1)), 2: result("call_0"), 3: call(("call_0", "x")), 4: result("call_0"), 5: call(("call_0", 2), (7, "y"), (None, 3)), 6: result(7), 3000: result("call_0"), 3001: result("7")}
    rows = [(1, t, "assistant", x) for t, x in texts.items()] + [(2, 5, "tool", result("a")), (2, 5000, "assistant", call(("a", 1)))]
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: (got[1, t]["n_calls"], got[1, t]["n_open"], got[1, t]["errors"]) for t in (1, 3, 5)} == {1: (1, 0, ""), 3: (1, 0, "$.a: type"), 5: (3, 1, "$.a: type")}
    assert [got[1, t]["orphan"] for t in (2, 4, 6, 3000, 3001)] == [False] * 4 + [True]
    assert all(got[1, t]["place_turn"] == t for t in texts) and (got[2, 5]["place_turn"], got[2, 5]["place_rank"], got[2, 5000]["n_open"]) == (5000, 1, 0)


def test_chats_after_white_space(spark):
    call = json.dumps({"tool_calls": [{"id": "1", "name": "f", "arguments": {}}]})
    rows = [(1, 1, "assistant", "\n\t\r " + call), (2, 1, "assistant", call.replace("tool_", "\\u0074ool_")), (3, 1, "user", "\u00a0" + call)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[i]["n_calls"], got[i]["errors"], "tool_calls" in json.loads(got[i]["message"])) for i in (1, 2, 3)] == [(1, "unknown tool", True)] * 2 + [(0, "", False)]


def test_schema_keywords():
    broken = [
        (1, {"minimum": 2}), (3, {"maximum": 2}), (2, {"exclusiveMinimum": 2}), (2, {"minimum": 2, "exclusiveMinimum": True}), (0.35, {"multipleOf": 0.1}), ("a", {"minLength": 2}),
        ("abc", {"maxLength": 2}), ("abc", {"pattern": "^b"}), (True, {"const": 1}), (1, {"enum": [True]}), ([], {"minItems": 1}), ([1, 1.0], {"uniqueItems": True}), ([1], {"contains": {"type": "string"}}),
        ({"a": 1}, {"maxProperties": 0}), ({"a": 1}, {"patternProperties": {"^a": {"type": "string"}}}), ({"a": 1}, {"additionalProperties": {"type": "string"}}), ({"a": 1}, {"propertyNames": {"minLength": 2}}),
        ({"a": 1}, {"dependentRequired": {"a": ["b"]}}), (1, {"anyOf": [{"type": "string"}, {"minimum": 2}]}), (1, {"oneOf": [{}, {"minimum": 0}]}), (1, {"allOf": [{"minimum": 2}]}), (1, {"not": {}}),
        (1, {"if": {"minimum": 0}, "then": {"minimum": 2}}), ([1, "x"], {"prefixItems": [{}, {"type": "integer"}]}), ({"a": {"a": 1}}, {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"a": {"$ref": "#/$defs/n"}}}}}),
        (1, {"$ref": "http://elsewhere"}), ({}, {"unevaluatedProperties": False}), ("x", {"pattern": "("}), (1, False),
    ]
    assert [x for x in broken if not chat.violations(*x)] == []
    kept = [(2, {"minimum": 2, "maximum": 2}), (0.3, {"multipleOf": 0.1}), (1.0, {"const": 1}), ("ab", {"pattern": "b"}), ({"a": 1}, {"patternProperties": {"^a": {}}, "additionalProperties": False}), ({"a": {}}, {"$ref": "#"}), (1, {"format": "x", "minLength": 3}), (1, {"oneOf": [{"minimum": 2}, {}]})]
    assert [x for x in kept if chat.violations(*x)] == []


def test_near_dedup_without_ids(spark):
    """Null and repeated ids with different texts are judged by their texts."""
    text = lambda k: " ".join(f"v{k}x{i}" for i in range(40))
    rows = [(1, text(1)), (2, text(2)), (None, text(3)), (None, text(3)), (None, text(4)), (None, text(1)), (5, text(5)), (5, text(6)), (5, text(6)), (7, text(5)), (None, ""), (None, None), (None, " "), (8, ""), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["text"]) for r in near_dedup.near_dedup(docs).collect())
    assert got == Counter([(1, text(1)), (2, text(2)), (None, text(3)), (None, text(4)), (5, text(5)), (5, text(6)), (None, ""), (None, None), (None, " "), (8, ""), (9, "")])
    plain = near_dedup.near_dedup(docs.where("doc_id < 5 or doc_id > 7"))
    assert sorted(r["doc_id"] for r in plain.collect()) == [1, 2, 8, 9]


def test_repair_goes_on_until_no_pair_is_frequent():
    docs = [np.zeros(60000, np.uint32), np.tile(np.arange(7, dtype=np.uint32), 700)]
    rules_, size, base, seq, symbols = repair_files.compress(np.concatenate(docs), np.array([len(x) for x in docs]))
    first = np.zeros(len(seq), bool)
    first[np.concatenate([[0], np.cumsum(symbols)[:-1]])] = True
    assert not len(repair_files._frequent(seq, first, repair_files.LEAST, 1)[0]) and len(seq) < 60
    block = repair_files.Block(repair_files.encode_block([0, 1], docs))
    assert all(np.array_equal(a, b) for a, b in zip(block.all(), docs, strict=True))
