import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefengine.sources import cache, files
from prefengine.streaming import increments


def test_json_lines(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"id": "1", "conversations": [{"from": "user", "value": "好"}]}\n\n{broken\n{"id": "2"}\n', encoding="utf-8")
    good, broken = files.read_json_lines(spark, str(p), files.CONVERSATION)
    assert sorted(r["id"] for r in good.collect()) == ["1", "2"] and [r[0] for r in broken.collect()] == ["{broken"]
    files.write_json_lines(good, str(tmp_path / "out"))
    files.write_json_lines(good, str(tmp_path / "out"), append=True)
    assert files.read_json_lines(spark, str(tmp_path / "out"), files.CONVERSATION)[0].count() == 4
    both = files.read_splits(spark, {"train": str(p), "validation": str(p)}, files.CONVERSATION)
    assert {r["split"] for r in both.collect()} == {"train", "validation"}


def test_json_array_and_trainer_state(spark, tmp_path):
    p = tmp_path / "infer.jsonl"
    p.write_text(json.dumps([{"id": "1"}, {"id": "2"}], indent=1))
    assert files.read_json_array(spark, str(p), files.CONVERSATION).count() == 2
    (tmp_path / "object.json").write_text('\n {"id": "1"}')
    with pytest.raises(ValueError, match="must hold a JSON list"):
        files.read_json_array(spark, str(tmp_path / "object.json"), files.CONVERSATION)
    s = tmp_path / "state.json"
    s.write_text(json.dumps({"log_history": [{"step": 1, "loss": 0.5}, {"step": 2, "eval/loss": 0.4}]}))
    got = files.read_trainer_state(spark, str(s)).collect()
    assert [(r["step"], r["values"].get("loss")) for r in got] == [(1.0, 0.5), (2.0, None)]


def test_csv_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    files.write_csv(df, str(tmp_path / "c"), ["b", "a"])
    assert next((tmp_path / "c").glob("part-*")).read_text() == "b,a\nx,1\n"
    files.write_report(df, str(tmp_path / "r" / "r.json"))
    assert json.loads((tmp_path / "r" / "r.json").read_text()) == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        files.write_report(df.union(df), str(tmp_path / "x.json"))


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "b.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>问题</t></si><si><t>回复</t></si><si><t>在吗</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>'
                   '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>5</v></c><c r="C2" t="inlineStr"><is><t>在的</t></is></c></row>'
                   '<row r="3"><c r="C3"><v>7</v></c></row></sheetData></worksheet>')
    spark.dataSource.register(files.WorkbookSource)
    got = spark.read.format("workbook").option("columns", "问题,回复").load(str(p)).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [(0, "在吗", "在的"), (1, None, "7")]
    with pytest.raises(Exception, match="has no column"):
        spark.read.format("workbook").option("columns", "没有").load(str(p)).collect()


def test_cache_last_write_wins(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    path = str(tmp_path / "cache")
    assert cache.load(spark, path, schema, ["v"]).count() == 0
    cache.append(spark.createDataFrame([("a", "1"), ("b", None)], schema), path, "k")
    cache.append(spark.createDataFrame([("a", "2")], schema), path, "k")
    assert [(r["k"], r["v"]) for r in cache.load(spark, path, schema, ["v"]).collect()] == [("a", "2")]


def test_resume_only_does_what_is_pending(spark):
    rows = spark.createDataFrame([("1",), ("2",)], "id string")
    done = spark.createDataFrame([("1", "old")], "id string, r string")
    work = lambda d: d.withColumn("r", F.lit("new"))
    assert {r["id"]: r["r"] for r in increments.resume(rows, done, "id", work).collect()} == {"1": "old", "2": "new"}
    assert increments.resume(rows, None, "id", work).count() == 2


def test_stream_to_batches(spark, tmp_path):
    source = tmp_path / "in"
    schema = "id string, t string, at timestamp"
    spark.createDataFrame([("1", "好 的！", "2025-01-01 00:00:00"), ("2", "好的", "2025-01-01 00:01:00"), ("3", "不好", "2025-01-01 00:02:00")], "id string, t string, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = increments.write_once(increments.deduplicated_stream(stream, "t", "at", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert q.exception() is None
    got = increments.read_latest(spark, str(tmp_path / "out"), "norm")
    assert sorted(r["norm"] for r in got.collect()) == ["不好", "好的"]


def test_windows_and_sessions_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    data = [("u", "k", 1.0, f"2025-01-01 00:{m:02d}:00") for m in (0, 5, 40)]
    spark.createDataFrame(data, "u string, k string, v double, at string").withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("u string, k string, v double, at timestamp").parquet(str(source))
    for name, out in (("w", increments.windowed_metrics(stream, "at", "k", "v", "30 minutes", "1 hour")), ("s", increments.sessions(stream, "at", "u", "10 minutes", "1 hour"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    assert sorted(r["n"] for r in spark.table("s").collect()) == [1, 2]
