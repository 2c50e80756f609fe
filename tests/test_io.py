"""Sources, sinks and streams."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from scorelake.sinks import files
from scorelake.sources import requests, tables
from scorelake.streaming import scoring


def _lines(path, *rows):
    path.write_text("\n".join(json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_requests(spark, tmp_path):
    writing = _lines(tmp_path / "w.json", {"prompt": "p", "models": [{"name": "a", "response": "x"}, {"response": " "}], "weights": {"tone": 2}}, {"prompt": " ", "models": []})
    rows = requests.writing(spark, writing)
    assert sorted((r["model"], r["error"]) for r in rows.collect()) == [("Unknown", "empty response"), ("Unknown", "prompt required"), ("a", None)]
    assert [r["response"] for r in requests.valid(rows).collect()] == ["x"]
    pair = _lines(tmp_path / "t.json", {"id": 1, "original": " a ", "back_translation": "b"}, {"id": 2, "original": "a", "back_translation": "\n"})
    got = {r["id"]: r for r in requests.translations(spark, pair).collect()}
    assert (got[1]["original"], got[1]["language_pair"], got[1]["error"], got[2]["error"]) == ("a", "Unknown", None, "back_translation required")
    summary = _lines(tmp_path / "s.json", {"prompt": "p", "summary": "s"}, {"summary": "s"})
    assert sorted(str(r["error"]) for r in requests.summaries(spark, summary).collect()) == ["None", "prompt required"]
    code = _lines(tmp_path / "c.json", {"prompt": "p", "models": [{"name": "m", "code": "x = 1"}, {"name": "n", "code": ""}]})
    assert sorted((r["model"], r["error"]) for r in requests.submissions(spark, code).collect()) == [("m", None), ("n", "No code provided")]


def test_verdicts(spark):
    rows = spark.createDataFrame([('```json\n{"overall_score": 7}\n```',), ("not json",), ('{"overall_score": 3}',)], "v string")
    got = [r["v"] for r in requests.verdicts(rows, "v", "overall_score double").collect()]
    assert (got[0]["overall_score"], got[2]["overall_score"]) == (7.0, 3.0) and (got[1] is None or got[1]["overall_score"] is None)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, (0.5, (True,)), 'say "x",\nthen', [1, 2])], "id int, m struct<a:double,b:struct<c:boolean>>, t string, l array<int>")
    flat = files.flatten(rows, ".")
    assert flat.columns == ["id", "m.a", "m.b.c", "t", "l"] and files.scalars(flat).columns == ["id", "m.a", "m.b.c", "t"]
    files.write_csv(files.listed(files.flatten(rows)), str(tmp_path / "csv"))
    back = tables.csv(spark, str(tmp_path / "csv"), "id int, m_a double, m_b_c boolean, t string, l string").collect()
    assert (back[0]["t"], back[0]["m_a"], back[0]["m_b_c"], back[0]["l"]) == ('say "x",\nthen', 0.5, True, "[1,2]")
    files.write_json(rows, str(tmp_path / "json"))
    assert tables.json_lines(spark, str(tmp_path / "json"), "id int, m struct<a:double>").first()["m"]["a"] == 0.5
    zeros = files.blank_zeros(spark.createDataFrame([(0.0, False, None, 2.5, True, "0")], "a double, b boolean, c int, d double, e boolean, f string")).first()
    assert list(zeros) == [None, None, None, "2.5", "True", "0"]
    odd = files.non_finite_as_text(spark.createDataFrame([(float("inf"),), (float("nan"),), (1.5,), (None,)], "x double")).collect()
    assert [r[0] for r in odd] == ["inf", "nan", "1.5", None]
    both = files.united(spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, 3)], "b int, a int"))
    assert both.columns == ["a", "b"] and both.count() == 2
    table = files.translation_table(spark.createDataFrame([(1, "m", 0.5)], "id int, model_name string, wer double"))
    assert table.columns == files.TRANSLATION_COLUMNS and table.first()["wer"] == 0.5


def test_judge_prompts(spark):
    row = spark.createDataFrame([("p", "s" * 4000, "sum", None)], "prompt string, source string, summary string, url string").select(files.summary_judge_prompt()).first()[0]
    assert "s" * 3000 + "..." in row and "s" * 3001 not in row and '"overall":{"score":N' in row
    text = spark.createDataFrame([("o", "t", "b" * 3000, "EN", "m")], "original string, translation string, back_translation string, language_pair string, model_name string").select(files.translation_judge_prompt()).first()[0]
    assert "b" * 2500 in text and "b" * 2501 not in text and "fluency" in text


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    _lines(folder / "a.json", {"k": 1, "text": "A short text. It is easy.", "at": "2024-01-01T00:10:00", "g": "x"}, {"k": 2, "text": None, "at": "2024-01-01T00:20:00", "g": "x"})
    schema = "k long, text string, at timestamp, g string"
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for wanted in (2, 3):
        scoring.run(scoring.scored(scoring.read_texts(spark, str(folder), schema), ["k"]), out, mark).awaitTermination(120)
        assert spark.read.parquet(out).count() == wanted
        _lines(folder / f"b{wanted}.json", {"k": 3, "text": "More.", "at": "2024-01-01T09:00:00", "g": "y"})
    direct = scoring.scored(spark.read.schema(schema).json(str(folder / "a.json")), ["k"]).orderBy("k").collect()
    assert spark.read.parquet(out).where("k < 3").orderBy("k").collect() == direct
    stream = scoring.windowed(scoring.read_texts(spark, str(folder), schema).withColumn("v", F.length("text").cast("double")), "at", "g", "v")
    query = stream.writeStream.format("memory").queryName("stats").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r["g"], r["n"]) for r in spark.table("stats").collect()} == {("x", 1), ("y", 2)}
