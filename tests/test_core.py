"""The core queries on small fixtures and against DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from scorelake.functions import text as T
from scorelake.functions.rounding import exact_round, exact_round_sql
from scorelake.operators import analytics
from scorelake.plans import queries as plans

SF = "/root/testdata/sf0.001"
F = T.F


def _rows(columns, rows):
    fix = lambda v: "~" if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(fix(r[i]) for i in order) for r in rows], key=str)


def _sql(name, folder, tables=("documents", "conversations")):
    db = duckdb.connect()
    for t in tables:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = db.execute(plans.oracle_sql()[name])
    return _rows([d[0] for d in got.description], got.fetchall())


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_against_sql(spark, name):
    got = plans.queries()[name](spark, SF)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _sql(name, SF)


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_queries_without_sql(spark, name):
    got = plans.queries()[name](spark, SF)
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


ODD = ["a b a", None, "", "12 34", "слово", " ", "Dr. Smith left. He ran!", "Hi. Yo! ok", "...", "Dear all\n\nFirst block of text here.\n\nBest", "one line of text\nanother line of text", "x\n\n \n\nyz abc", 'He said. "No." Go? Why! l\'été don\'t']


@pytest.mark.parametrize("name", ["word_facts", "readability", "lexical_richness", "structure", "tone", "repetition", "token_stats"])
def test_odd_documents(spark, tmp_path, name):
    """Null, empty, blank and non-Latin texts keep their rows, in SQL as well."""
    rows = [(i, t, "en", "s") for i, t in enumerate(ODD)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.queries()[name](spark, str(tmp_path))
    found = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert len(found[1]) == len(ODD)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(plans.oracle_sql()[name])
    assert found == _rows([d[0] for d in want.description], want.fetchall())


def test_exact_round(spark):
    values = [0.03125, 0.09375, 2.675, 0.00005, -0.00015, 1 / 3, 12345.67895, 0.0, 1.0, -2.5, 1e-9, 123456.123450000001, 0.5, 1.5, 0.12345, 0.00025]
    values += [k / 160 for k in range(200)] + [k / 997 for k in range(100)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    db = duckdb.connect()
    db.execute("CREATE TABLE t AS SELECT unnest(?::DOUBLE[]) AS v", [values])
    for places in (0, 1, 2, 3, 4):
        got = [r[0] for r in rows.select(exact_round(F.col("v"), places)).collect()]
        assert got == [round(v, places) for v in values]
        assert [r[0] for r in db.execute(f"SELECT {exact_round_sql('v', places)} FROM t").fetchall()] == got
    assert rows.select(exact_round(F.lit(None).cast("double"), 2)).first()[0] is None


def test_tokens(spark):
    rows = spark.createDataFrame([("L'été à Rome_2",), ("",), (None,), ("don't 3 stop",)], "t string")
    got = rows.select(T.tokens(F.col("t")), T.ascii_tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [["l", "été", "à", "rome_2"], [], [], ["don", "t", "3", "stop"]]
    assert got[3][1] == ["don't", "stop"]


def test_sentences_and_paragraphs(spark):
    from scorelake.functions import prose

    texts = [t for t in ODD if t is not None] + ["Mr. A met Mrs. B. They spoke (e.g. briefly). End", "a. B! C? no", "  lead\ttabs.  Next one here. "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", T.prose_sentences(F.col("t")).alias("s"), T.paragraphs(F.col("t")).alias("p"), T.sentences(F.col("t")).alias("x"), T.clauses(F.col("t")).alias("y")).orderBy("i").collect()
    assert [r["s"] for r in got] == [prose.sentences(t) for t in texts]
    assert [r["p"] for r in got] == [prose.paragraphs(t) for t in texts]
    assert got[-3]["s"] == ["Mr. A met Mrs. B.", "They spoke (e.g. briefly). End"]
    assert got[5]["x"] == ["Dr.", "Smith left.", "He ran!"] and got[5]["y"] == ["dr", "smith left", "he ran"]
    grams = spark.createDataFrame([(" aB c ",)], "t string").select(T.char_ngrams(F.col("t"), 2, True), T.char_ngrams(F.col("t"), 2, False), T.char_ngrams(F.col("t"), 9, False)).first()
    assert list(grams) == [["ab", "b ", " c"], ["ab", "bc"], []]


def test_no_regex_within_a_lambda_of_ngrams(spark):
    """Tokens must not be computed again for each position."""
    for name in ("pair_sets", "repetition", "token_stats", "lexical_richness"):
        plan = plans.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction(concat_ws( , get(regexp" not in plan and "get(regexp_extract_all" not in plan


def test_zscore_variants(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 1.0), (None, 3.0), ("b", None)], "g string, v double")
    got = sorted((r["g"] or "", r["z"]) for r in analytics.zscores(rows, "g", "v").collect() if r["z"] is not None)
    assert got == [("", -1.0), ("", 1.0), ("a", 0.0), ("a", 0.0)]
    whole = analytics.zscores(rows, None, "v", places=4, missing=0.0).collect()
    assert sorted(r["z"] for r in whole) == [-0.5774, -0.5774, -0.5774, 0.0, 1.7321]
    three = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.5)], "v double")
    coarse = sorted(r["z"] for r in analytics.zscores(three, None, "v", places=4, rounded_stats=1).collect())
    assert coarse == [-1.3333, 0.3333, 1.1667]  # mean 1.8, deviation 0.6


def test_group_stats_and_ranks(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", "z", 4.0), ("b", "x", None), ("b", "y", 0.5)], "g string, m string, v double")
    got = {r["g"]: r for r in analytics.group_stats(rows, "g", "v", median=True, places=2).collect()}
    assert (got["a"]["mean"], got["a"]["std"], got["a"]["median"], got["a"]["spread"], got["b"]["n"]) == (2.33, 1.25, 2.0, 3.0, 1)
    ranks = {(r["g"], r["m"]): r["rank"] for r in analytics.ranked(rows, "g", "v", "m").collect()}
    assert ranks == {("a", "z"): 1, ("a", "y"): 2, ("a", "x"): 3, ("b", "y"): 1, ("b", "x"): 2}
    assert [r[0] for r in spark.createDataFrame([(80.0,), (50.0,), (3.0,), (None,)], "s double").select(analytics.band("s")).collect()] == ["high", "mid", "low", None]
    long = analytics.unpivot(rows.withColumn("w", F.col("v") * 2), ["g", "m"], ["v", "w"]).collect()
    assert len(long) == 10 and {r["metric"] for r in long} == {"v", "w"}


def test_composites(spark):
    row = {k: 0.5 for k in analytics.SUMMARY_PROFILES["balanced"]} | {"compression_ratio": 2.0, "prompt_adherence": None}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} double" for k in row))
    weights = analytics.SUMMARY_PROFILES["balanced"]
    top = sum(w * (0.0 if k == "compression_ratio" else 0.5) for k, w in weights.items() if k != "prompt_adherence")
    assert df.select(analytics.summary_composite()).first()[0] == round(top / sum(abs(w) for k, w in weights.items() if k != "prompt_adherence"), 4)
    rates = spark.createDataFrame([(1.7, 0.2, 0.9)], "wer double, cer double, bleu_4 double")
    assert rates.select(analytics.translation_composite(weights={"wer": 0.5, "cer": 0.25, "bleu_4": 0.25})).first()[0] == round(0.25 * 0.8 + 0.25 * 0.9, 4)


def test_syllables(spark):
    words = {"the": 1, "table": 3, "made": 1, "nation": 2, "beautiful": 3, "mmmm": 1, "whale": 2, "relatedly": 4}
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.syllables(F.col("w")).alias("s"), T.is_complex(F.col("w")).alias("c")).collect()
    assert {r["w"]: r["s"] for r in got if r["w"] not in ("whale", "relatedly")} == {w: n for w, n in words.items() if w not in ("whale", "relatedly")}
    assert {r["w"] for r in got if r["c"]} == {"beautiful", "relatedly", "table"}
