"""The methods themselves: against brute force, on planted data, on odd tables, and stage by stage."""

from __future__ import annotations

import itertools
import json
import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from scorelake.llm import chat, mixing, near_dedup, nearest, packing, pages, quality, queries, repair_files, rules, toxicity

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def _sizes(x):
    return np.sort(np.asarray(x, np.int64))[::-1]


def _bfd(sizes, capacity):
    return packing.best_fit(sizes, np.arange(len(sizes)), capacity)


def _valid(group, sizes, capacity):
    return len(group) == len(sizes) and np.bincount(group, weights=sizes).max() <= capacity


def test_genetic_packing_improves_on_best_fit():
    """Triplets, of which three fill a sequence exactly, and middling sizes: cases that best-fit decreasing packs badly."""
    rng = np.random.default_rng(0)
    triplets = []
    for _ in range(100):
        a = int(rng.integers(380, 491))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        triplets += [a, b, 1000 - a - b]
    for sizes, capacity, share in ((_sizes(triplets), 1000, 0.5), (_sizes(rng.integers(200, 701, 2000)), 1024, 0.3)):
        bound, first = packing.lower_bound(sizes, capacity), _bfd(sizes, capacity)
        best = packing.improve(sizes, [first], capacity, 3, bound)
        assert _valid(best, sizes, capacity)
        used, gap = len(np.unique(best)), first.max() + 1 - bound
        assert bound <= used <= first.max() + 1 - share * gap


def test_evolution_reaches_every_sequence():
    """A shard of many cores: each of its sequences is in one, and improves as those of a shard of one core do."""
    rng = np.random.default_rng(5)
    triplets = []
    for _ in range(600):
        a = int(rng.integers(380, 491))
        b = int(rng.integers(250, (1000 - a) // 2 + 1))
        triplets += [a, b, 1000 - a - b]
    sizes = _sizes(triplets)
    first = _bfd(sizes, 1000)
    best = packing.improve(sizes, [first], 1000, 3, 600, core=128)
    assert _valid(best, sizes, 1000)
    assert len(np.unique(best)) <= first.max() + 1 - 0.5 * (first.max() + 1 - 600)


def test_evolution_passes_sequences_of_more_pieces_than_a_core():
    sizes = _sizes([10] * 1030)
    best = packing.improve(sizes, [_bfd(sizes, 1024)], 1024, 3, packing.lower_bound(sizes, 1024) - 1, core=32)
    assert _valid(best, sizes, 1024) and len(np.unique(best)) == 11


def test_replacing_looks_at_every_sequence_and_piece():
    # 300 sequences with room, each of which one of the displaced pieces fills
    sizes = np.array([600] * 300 + [1000] * 300)
    child, left = np.concatenate([np.arange(300), np.full(300, -1)]), np.full(300, 400)
    packing.replace(child, sizes, left, packing.Lost(list(range(300, 600)), [1000] * 300), np.random.default_rng(0))
    assert (left == 0).all() and (child[:300] < 0).all() and sorted(child[300:]) == list(range(300))
    # twenty pieces, of which only two together make way for the two displaced ones that fill the sequence
    for seed in range(10):
        sizes = np.array([*range(30, 66, 2), 7, 9, 68, 71])
        child, left = np.concatenate([np.zeros(20, np.int64), [-1, -1]]), np.array([139 - 16])
        packing.replace(child, sizes, left, packing.Lost([20, 21], [68, 71]), np.random.default_rng(seed))
        assert left[0] == 0 and (child[20:] == 0).all() and (child[18:20] < 0).all()


def _optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_genetic_packing_against_all_packings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = _sizes(rng.integers(1, 9, int(rng.integers(1, 10))))
        bound = packing.lower_bound(sizes, 10)
        best = packing.improve(sizes, [_bfd(sizes, 10)], 10, 1, bound)
        assert _valid(best, sizes, 10) and len(np.unique(best)) == _optimum(sizes.tolist(), 10) >= bound


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(6)
    sizes = _sizes(rng.integers(100, 500, 300))
    a, b = _bfd(sizes, 1000), packing.best_fit(sizes, rng.permutation(300), 1000)
    for _ in range(30):
        child = packing.crossover(a, b, sizes, 1000, rng)
        assert _valid(child, sizes, 1000) and child.min() >= 0
        a, b = child, a


def test_packed_pieces_are_the_documents(spark):
    texts = ["one two three", None, "", "word " * 700, "see <|endoftext|> here", "é " * 90] + ["the same text"] * 600
    docs = spark.createDataFrame([(i if i < 300 else 7, t, i) for i, t in enumerate(texts)], "doc_id long, text string, number long")
    got = packing.pack_documents(docs, capacity=256, shard_pieces=100).toPandas()
    enc = packing.encoder(packing.default_path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in enumerate(texts):
        ids = np.concatenate([enc.by_library([t or ""])[0], [2]]).astype("<u4")
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (x, y) in enumerate(itertools.pairwise(cuts)):
            want[i if i < 300 else 7, k, x, y - x, zlib.crc32(ids[x:y].tobytes())] += 1
    assert Counter(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g["offset"] == g["length"].cumsum() - g["length"]).all() and g["length"].sum() <= 256
    # equal rows are dealt to several shards
    short = got[(got["length"] < 256) & (got["doc_id"] == 7)]
    assert (short["sequence_id"] // 2**32).value_counts().max() < 200


def _rule_rows():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for i in range(420):
        lang = ("en", "fr", None)[0 if i < 300 else 1 if i < 330 else 2]
        text = [str(x) for x in rng.choice(words, 60)]
        if i % 7 == 0:
            text = [x + "#$" for x in text]
        if i % 11 == 0:
            text = ["a b c d e f g h i\n"] * 12 + text
        rows.append((i, " ".join(text), lang, "s", 0))
    rows += [(500 + i, "the same good text of some twenty words " * 4, "fr", "s", 0) for i in range(200)]
    rows += [(None, "no id", "en", "s", 0), (900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "x\n\nx\n x", "xx", "s", 0)]
    marks = [(i, int(i % 7 != 0 and i % 11 != 0), 0) for i in range(0, 420)] + [(500 + i, 1, 0) for i in range(200)] + [(None, 1, 0), (3, 1, 0)]
    return rows, marks


def test_risk_controlled_rules_against_sql(spark, tmp_path):
    rows, marks = _rule_rows()
    spark.createDataFrame(rows, DOC).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.queries()["op8_risk_controlled_rules"](spark, str(tmp_path))
    found = sorted((tuple(r) for r in got.collect()), key=str)
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.execute(queries.oracle_sql()["op8_risk_controlled_rules"])
    assert [d[0] for d in want.description] == got.columns and sorted(want.fetchall(), key=str) == found
    stats = rules.statistics(spark.createDataFrame(rows, DOC))
    levels = {r["stratum"]: r for r in rules.levels(stats, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    # copies of one text are one trial: French has too few, whatever its rows
    assert levels["fr"]["n"] < 60 and levels["fr"]["level"] is None and levels["fr"]["cut_symbols"] is None
    assert levels["en"]["level"] is not None
    kept = {r["doc_id"]: r["kept"] for r in got.collect()}
    good = [i for i, q, _ in marks if q and i is not None and i < 300]
    assert sum(not kept[i] for i in good) <= 0.05 * len(good) and not any(kept[i] for i in range(0, 300, 7))


def test_levels_hold_the_risk():
    """Share of draws in which a level is chosen whose true rate is above alpha: at most delta (with room for chance)."""
    rng = np.random.default_rng(1)
    alpha, delta, n, wrong, trials = 0.05, 0.05, 200, 0, 400
    true = np.linspace(0.0, 0.12, rules.LEVELS)
    for _ in range(trials):
        k = np.searchsorted(np.sort(rng.random(n)), true)
        level = -1
        for i, x in enumerate(k):
            if sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(x + 1)) > delta:
                break
            level = i
        wrong += level >= 0 and true[level] > alpha
    assert wrong <= trials * delta * 1.6


def _pu(rng, n, shift):
    x = rng.normal(size=(n, 20))
    x[:, 0] += shift
    return np.concatenate([x, np.ones((n, 1))], axis=1)


def test_non_negative_risk():
    """Few positives and many features: the plain estimate's second term falls far below zero, the non-negative one's doesn't."""
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.normal(size=(15, 60)), np.ones((15, 1))], axis=1)
    u = np.concatenate([rng.normal(size=(300, 60)), np.ones((300, 1))], axis=1)
    prior = 0.6
    w = 5 * np.linalg.lstsq(np.concatenate([p, u]), np.concatenate([np.ones(15), -np.ones(300)]), rcond=None)[0] + np.eye(61)[-1] * 3
    g, rest = quality.nn_gradient(w, p, u, prior)
    while rest >= 0:
        w[-1] -= 0.5
        w[:-1] *= 1.2
        g, rest = quality.nn_gradient(w, p, u, prior)
    assert rest < 0 and quality.nn_gradient(w - 1e-4 * g, p, u, prior)[1] > rest

    def plain(w):
        zp, zu = p @ w, u @ w
        s = quality._sigmoid
        return prior * ((s(zp) - 1) @ p) / len(p) + (s(zu) @ u) / len(u) - prior * (s(zp) @ p) / len(p)

    free = quality._adam(plain, 61, 800, 0.05)
    held = quality.fit_nnpu(p, u, prior, steps=800, rate=0.05, ridge=0.0)
    assert quality.nn_gradient(free, p, u, prior)[1] < -0.5 < quality.nn_gradient(held, p, u, prior)[1]


def test_prior_and_held_out_quality():
    rng = np.random.default_rng(2)
    p, u = _pu(rng, 1500, 4.0), np.concatenate([_pu(rng, 1400, 4.0), _pu(rng, 600, -4.0)])
    model = quality.Model(p[:, :-1], u[:, :-1])
    assert 0.6 < model.prior < 0.8
    new = np.concatenate([_pu(rng, 500, 4.0), _pu(rng, 500, -4.0)])[:, :-1]
    assert ((model.score(new) >= 0.5) == (np.arange(1000) < 500)).mean() > 0.97


def test_chain_gains_by_earlier_categories():
    """The second category is the first one's where one word is: no linear model of the words, but one of the first's probability."""
    rng = np.random.default_rng(5)
    n, k = 4000, 40
    x = rng.random((n, k)) < 0.2
    one = x[:, :6].sum(axis=1) >= 2
    two = one & x[:, 6]
    rows, cols = np.nonzero(x)
    y = np.stack([one, two], axis=1).astype(float)
    fold = np.arange(n) % toxicity.FOLDS
    train = np.arange(n) < 3000
    on = train[rows]
    vocab = np.arange(k, dtype=np.uint64)

    def loss(chain, col, y):
        p = np.clip(chain.predict(rows, cols, n)[~train, col], 1e-6, 1 - 1e-6)
        return -(y[~train] * np.log(p) + (1 - y[~train]) * np.log(1 - p)).mean()

    both = toxicity.Chain(vocab, ["one", "two"]).fit(rows[on], cols[on], y[train], fold[train])
    alone = toxicity.Chain(vocab, ["two"]).fit(rows[on], cols[on], y[train][:, 1:], fold[train])
    assert loss(both, 1, two) < 0.97 * loss(alone, 0, two)
    assert both.models[1].v.shape == (1,) and both.models[1].v[0] > 0.5


CLASH = "n long, size long, h long, rest double, source_size long, copies long, times long, copy int, id long, doc string, own long, key long, at string, _salt int, _n int, score double, lang2 string, class_id long, number long, digest string, level int, stratum string, toxic boolean, predicted int"


@pytest.fixture(scope="module")
def clashing(spark):
    rng = np.random.default_rng(3)
    names = [c.split()[0] for c in CLASH.split(", ")]
    text = lambda i: " ".join(rng.choice([f"v{j}" for j in range(300)], 60)) if i % 5 else "one text that comes again and again " * 3
    rows = [(i if i != 11 else None, text(i), "en", "s" if i % 3 else None, 0) for i in range(60)]
    return spark.createDataFrame(rows, DOC).selectExpr("*", *[f"cast(7 as {c.split()[1]}) as `{c.split()[0]}`" for c in CLASH.split(", ")]), names


def test_clashing_columns(spark, clashing, tmp_path):
    docs, names = clashing
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 6 == 0), 1, 2) for i in range(60)], "doc_id long, quality int, toxic int, n int, y int")
    model, chain = quality.fit(docs, labels), toxicity.fit(docs, labels)
    assert quality.quality_scores(docs, model).count() == 60 and toxicity.toxicity_scores(docs, chain).count() == 60
    for out in (quality.keep_quality(docs, model), toxicity.drop_toxic(docs, chain), near_dedup.near_dedup(docs), mixing.apply_mix(docs)):
        assert out.columns == docs.columns and {r["n"] for r in out.collect()} <= {7}
    assert near_dedup.near_duplicates(docs).count() == 59 and mixing.mix(docs).count() == 60
    assert packing.pack_documents(docs).select("doc_id").distinct().count() == 60
    repair_files.write(docs, str(tmp_path / "f"))
    assert repair_files.read(spark, str(tmp_path / "f")).count() == 60
    stats = rules.statistics(docs)
    assert rules.judge(stats, rules.levels(stats, labels)).count() == 60
    odd = "cast(1 as int) as list, cast(2 as int) as `group`, cast(3 as int) as v, cast(1 as int) as host, cast(1 as int) as path, cast(4 as int) as call, cast(5 as int) as place_turn, cast(6 as int) as rank".split(", ")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(60)], "vec_id long, embedding array<float>").selectExpr("*", *odd)
    assert nearest.search(vectors, k=3).count() == 9
    sites = spark.createDataFrame([(1, "http://a/", "<p>x")], "page_id long, url string, html string").selectExpr("*", *odd)
    assert [r["text"] for r in pages.main_text(sites).collect()] == ["x"]
    turns = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string").selectExpr("*", *odd)
    assert chat.format_chats(turns).count() == 1


def _brute_importance(nodes):
    held = defaultdict(list)
    for path, style, content in nodes:
        held[path].append((style, content))
    out = {}
    for path, both in held.items():
        m = len(both)

        def entropy(values, m=m):
            return -sum(c / m * math.log(c / m) for c in Counter(values).values()) / math.log(m) if m > 1 else 1.0

        kinds = len({s for s, _ in both})
        weight = pages.GAMMA**kinds
        out[path] = (1 - weight) * entropy([s for s, _ in both]) + weight * entropy([c for _, c in both])
    return out


def test_importance_against_counts(spark):
    """A site whose names say nothing: entropies by plain counts, and what they remove."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(30):
        extra = "".join(f"<i>{j}</i>" if j % 2 else f"<p>q{j}</p>" for j in range(int(rng.integers(0, 3))))
        rows.append((i, f"http://site/{i}", f"<body><div class=x1><ul><li>first<li>second</ul></div><div class=x2><h1>Title {i}</h1><p>words {rng.integers(0, 9)} of {i}</p>{extra}</div><div class=x3>made by us</div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = pages.style_tree(df)
    nodes = []
    for _, _, html in rows:
        root = pages.parse(html)
        order = list(pages._walk(root))
        text = {}
        for node in reversed(order):
            text[id(node)] = pages._hash(*(p if isinstance(p, str) else text.get(id(p), 0) for p in node.parts if p is not None))
        alike = defaultdict(list)
        for node in order:
            alike[node.path].append(node)
        for path, same in alike.items():
            content = text[id(same[0])] if len(same) == 1 else pages._hash(*(text[id(n)] for n in same))
            nodes.append((path, tuple(c.tag for c in same[0].children), content))
    got = {r["path"]: r["importance"] for r in pages.importance(tree).collect()}
    want = _brute_importance(nodes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    text = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    assert all(t.startswith(f"Title {i}\nwords") and "first" not in t and "made by" not in t for i, t in text.items())


def test_names_within_articles():
    text = lambda page: pages.blocks(pages.parse(f"<body><article>{page}</article>"))
    assert text("<header class='entry-header'><h1>Title</h1></header><div class='article-header'>head</div>") == ["Title", "head"]
    assert text("<div class='side-note'>a</div><section id='search'>b</section><div class='comment-policy'>c</div>") == ["a", "b", "c"]
    assert text("<p>a <span class='related'>x</span> b <a class='share-link'>this link</a> c") == ["a x b this link c"]
    assert text("<p>one <span class='ad'>buy <span>now</span> tail</span> two<p>b <i class='sponsored'>open") == ["one two", "b"]
    assert text("<p>t</p><div class='comments-list'>c</div><div class='ad-slot-2'>z</div><ul class='share-buttons'><li>s</ul>") == ["t"]


def test_links_against_a_plain_linker(spark):
    rng = np.random.default_rng(7)
    rows = []
    for conv in range(12):
        for turn in range(25):
            key = f"k{rng.integers(0, 4)}"
            kind = rng.integers(0, 3)
            text = json.dumps({"tool_calls": [{"id": key, "name": "f", "arguments": {}}]}) if kind == 0 else json.dumps({"tool_call_id": key, "content": "r"}) if kind == 1 else "plain"
            rows.append((conv, turn * 400, "assistant", text))
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in range(12):
        calls, results = defaultdict(list), []
        for _, turn, _, text in (r for r in rows if r[0] == conv):
            x = json.loads(text) if text[0] == "{" else {}
            if "tool_calls" in x:
                calls[x["tool_calls"][0]["id"]].append(turn)
            elif "tool_call_id" in x:
                results.append((turn, x["tool_call_id"]))
        answered = set()
        for turn, key in results:
            before, after = [c for c in calls[key] if c < turn], [c for c in calls[key] if c >= turn]
            call = max(before) if before else min(after, default=None)
            r = got[conv, turn]
            assert r["orphan"] == (call is None)
            assert (r["place_turn"], r["place_rank"]) == ((call, 1) if call is not None and call >= turn else (turn, 0))
            answered.add((key, call))
        for key, at in calls.items():
            assert all(got[conv, c]["n_open"] == ((key, c) not in answered) for c in at)


def test_order_over_several_links(spark):
    both = lambda result, call: json.dumps({"tool_call_id": result, "tool_calls": [{"id": call, "name": "f", "arguments": {}}]} if call else {"tool_call_id": result})
    rows = [(1, 1, both("c", None)), (1, 2, both("b", "c")), (1, 3, both("a", "b")), (1, 9, json.dumps({"tool_calls": [{"id": "a", "name": "f"}]})), (2, 1, both("x", "y")), (2, 2, both("y", "x"))]
    got = {(r["conv_id"], r["turn"]): (r["place_turn"], r["place_rank"]) for r in chat.format_chats(spark.createDataFrame([(a, b, "tool", c) for a, b, c in rows], "conv_id long, turn long, role string, text string")).collect()}
    assert [got[1, t] for t in (9, 3, 2, 1)] == [(9, 0), (9, 1), (9, 2), (9, 3)]
    assert got[2, 1][0] in (1, 2) and got[2, 2] == (2, 0) or got[2, 2][0] in (1, 2)


def test_odd_chats(spark):
    call = lambda **c: json.dumps({"tool_calls": [c]})
    rows = [call(id="1", name="\ud800"), '{"tool_calls":[{"id":"1","name":"f","arguments":{"a":NaN}}]}', '{"content":1e400}', '{"a":' * 3000, call(id="\udfff", name="f", arguments="\ud800"), "\x00", '{"tool_calls":{"id":1}}']
    schemas = [{"required": 5}, {"required": [["a"]]}, {"type": [["a"]]}, {"properties": 5}, 7, {"items": 3}, {"enum": 3}]
    table = [(i, 1, "assistant", t) for i, t in enumerate(rows)]
    for i, s in enumerate(schemas):
        table += [(100 + i, 0, "system", json.dumps({"tools": [{"name": "f", "parameters": s}]})), (100 + i, 1, "assistant", call(id="1", name="f", arguments={"a": [1]}))]
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_chats(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(table)
    for r in got.values():
        json.loads(r["message"], parse_constant=lambda x: pytest.fail(x))
    assert got[101, 1]["errors"] == got[102, 1]["errors"] == "$: malformed schema" and got[1, 1]["n_calls"] == 0 and got[0, 1]["n_calls"] == 1


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of two sources with copies, junk and toxic words, and labels of two thirds of them."""
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "mu") for b in ("lan", "ter", "sil") for c in ("o", "a", "en", "ik", "us")]
    rows, marks = [], []
    for i in range(900):
        kind = "junk" if i % 9 == 0 else "toxic" if i % 11 == 0 else "good"
        text = [str(x) for x in rng.choice(words, 90)]
        for at in range(9, 90, 10):
            text[at] += "."
        if kind == "junk":
            text = [f"{x}#{rng.integers(0, 99)}|$" for x in text]
        if kind == "toxic":
            text[5:80:8] = ["grumblehate"] * len(text[5:80:8])
        rows.append((i, " ".join(text), "en", f"s{i % 2}", 0))
        if i % 3:
            marks.append((i, int(kind != "junk"), int(kind == "toxic")))
    rows += [(1000 + i, rows[1][1], "en", "s0", 0) for i in range(40)] + [(1100, rows[2][1] + " more", "en", "s0", 0), (None, "", "en", None, 0), (1200, None, None, "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOC).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, {r[0]: r for r in rows}


def test_pipeline_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, folder), f"test-{name}")
        if name != "pack":
            assert out.columns == docs.columns
        kept[name] = Counter(r["doc_id"] for r in out.select("doc_id").collect())
        docs = out
    toxic = {i for i in range(900) if i % 9 and i % 11 == 0}
    junk = {i for i in range(900) if i % 9 == 0}
    clean = set(range(900)) - toxic - junk
    assert not toxic & kept["toxicity"].keys() and clean <= kept["toxicity"].keys()
    assert len(junk & kept["quality"].keys()) <= 3 and len(clean - kept["quality"].keys()) <= 3
    copies = {1, *range(1000, 1040)}
    assert copies & kept["near_dedup"].keys() == {1} and 1100 not in kept["near_dedup"] and clean & kept["quality"].keys() <= kept["near_dedup"].keys()
    assert max(kept["mix"].values()) == 2 and kept["mix"].keys() <= kept["near_dedup"].keys()
    assert kept["pack"] == kept["mix"]


def test_pipeline_run_and_empty_tables(spark, corpus, tmp_path):
    folder, _ = corpus
    packed = corpus_pipeline.run(spark, folder)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0 and packed.count() > 500
    for name, schema in (("documents", DOC), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_mix_without_words_ties_and_long_texts(spark):
    rows = [(i, "", "en", "a", 0) for i in range(5)] + [(9, "one two", "en", None, 0)] * 4 + [(20, "w " * 60_000, "en", "b", 0), (None, "x y z", "en", "b", 0)]
    got = mixing.mix(spark.createDataFrame(rows, DOC)).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all() and got["size"].max() == 60_000
    assert got[got["doc_id"] == 9]["taken"].nunique() == 1


def test_pipeline_packs_all_of_a_shard_well(spark):
    """Documents of which three fill a sequence exactly: the pack stage evolves all of them, not a part."""
    rng = np.random.default_rng(8)
    lengths = []
    for _ in range(1000):
        a = int(rng.integers(390, 501))
        b = int(rng.integers(260, (1024 - a) // 2 + 1))
        lengths += [a, b, 1024 - a - b]
    docs = spark.createDataFrame([(i, " a" * (n - 1), "en", "s", 0) for i, n in enumerate(lengths)], DOC)
    got = corpus_pipeline.pack(spark, docs, "").toPandas()
    assert sorted(got["length"]) == sorted(lengths)
    sizes = _sizes(lengths)
    first = _bfd(sizes, 1024).max() + 1
    assert got["sequence_id"].nunique() <= first - 0.7 * (first - 1000)


def test_sequences_of_different_shards_meet(spark):
    """Four pieces fill a sequence: what the shards' last ones leave free takes pieces of other shards."""
    items = spark.range(400).selectExpr("if(id % 5 = 0, null, id div 2) AS doc_id", "cast(id AS int) AS piece", "0L AS start", "if(id < 20, 1024L, 256L) AS length", "id AS ids_crc32", "id AS number")
    got = packing.pack(packing.materialise(items, "test-items"), shard_pieces=16).toPandas()
    assert list(got.columns) == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and sorted(got["piece"]) == list(range(400))
    assert all(x["doc_id"] == x["piece"] // 2 if x["piece"] % 5 else math.isnan(x["doc_id"]) for _, x in got.iterrows())
    for _, rows in got.groupby("sequence_id"):
        assert sorted(rows["offset"]) == [256 * k for k in range(len(rows))] and rows["length"].sum() <= 1024
    assert got["sequence_id"].nunique() == 20 + 95


def test_pipeline_packs_shards_together(spark):
    """50,000 documents of the end id alone are four shards, of 13 sequences each, and fit in 49."""
    docs = spark.range(50_000).selectExpr("id AS doc_id", "'' AS text", "'en' AS lang", "'s' AS source", "0L AS n_chars")
    got = corpus_pipeline.pack(spark, docs, "").groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).toPandas()
    assert len(got) == 49 and got["sum(length)"].sum() == 50_000 and (got["sum(length)"] == got["max(offset)"] + 1).all()
