import json
import os

import pytest
from pyspark.sql import functions as F

from quernel.sources import signals, sinks, tables
from quernel.streaming import incremental


def test_pairs_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('text,question\n"one, two",why\n')
    assert [tuple(r) for r in tables.read_pairs_csv(spark, str(tmp_path / "a.csv")).collect()] == [("one, two", "why", "local_csv")]
    (tmp_path / "b.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="needs columns"):
        tables.read_pairs_csv(spark, str(tmp_path / "b.csv"))


def test_first_source(spark):
    empty = lambda: spark.range(0)
    assert tables.first_source([("none", lambda: None), ("bad", lambda: 1 / 0), ("empty", empty), ("ok", lambda: spark.range(3))])[0] == "ok"
    with pytest.raises(ValueError, match="ZeroDivisionError"):
        tables.first_source([("bad", lambda: 1 / 0)])


def test_json_files(spark, tmp_path):
    p = str(tmp_path / "d" / "x.json")
    sinks.save_json({"a": 1, "b": {2}}, p)
    assert tables.load_json(p)["a"] == 1 and tables.load_json(str(tmp_path / "no"), 5) == 5 and os.listdir(tmp_path / "d") == ["x.json"]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a int").count() == 2
    assert tables.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0


def test_signal_cache(spark, tmp_path):
    p = str(tmp_path / "s")
    spark.createDataFrame([("x", 0, 3, 4, json.dumps({"0|1": [1, 2.5, 3], "2|0": [4, 5, 6]}))], "sample_id string, passage_tokens int, inj_tokens int, query_tokens int, masses_json string").write.parquet(p)
    s = signals.read_signals(spark, p)
    m = signals.masses(s)
    assert sorted(map(tuple, m.collect())) == [("x", 0, 1, 1.0, 2.5, 3.0), ("x", 2, 0, 4.0, 5.0, 6.0)]
    assert tuple(signals.widths(s).first()) == ("x", 1, 3, 4)
    assert sorted(map(tuple, signals.masses(signals.to_json(m)).collect())) == sorted(map(tuple, m.collect()))
    with pytest.raises(ValueError, match="lacks passage_tokens"):
        tables.require_columns(spark.range(1), ["passage_tokens"], "it")


def test_hidden_reads_one_layer(spark, tmp_path):
    p = str(tmp_path / "h")
    signals.write_hidden(spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [2.0])], "sample_id string, layer int, vec array<float>"), p)
    one = signals.read_hidden(spark, p, [1])
    assert [r["vec"] for r in one.collect()] == [[2.0]]
    assert "PartitionFilters: [isnotnull(layer" in one._jdf.queryExecution().toString() or "layer=1" in str(one.inputFiles())


def test_append_new_is_idempotent(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.range(5).withColumnRenamed("id", "k")
    assert [sinks.append_new(df, p, "k"), sinks.append_new(df, p, "k"), sinks.append_new(spark.range(7).withColumnRenamed("id", "k"), p, "k")] == [5, 0, 2]


def test_fingerprint(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    n, s = tables.fingerprint(df)
    assert (n, s) == tables.fingerprint(df.orderBy(F.desc("id")))
    assert not tables.is_stale(df, {"rows": n, "fingerprint": s}) and not tables.is_stale(df, {"rows": n}) and tables.is_stale(df, None) and tables.is_stale(df.limit(9), {"rows": n, "fingerprint": s})


def test_report(spark, tmp_path):
    p = str(tmp_path / "r.md")
    sinks.write_report(p, "T", [("A", spark.createDataFrame([(1, 0.5, None)], "n int, x double, y string")), ("B", "text")])
    assert "| 1 | 0.5000 | n/a |" in open(p).read()


def test_extraction_stream_goes_on_where_it_was(spark, tmp_path):
    schema = "sample_id string, passage string, query string, injection string, injection_offset struct<start:int,end:int>"
    rows = [(f"s{i}", f"passage number {i} about something", "why?", "" if i else "absent", None) for i in range(4)]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (rows[:2], rows[2:], []):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.extraction_stream(spark, src, schema, out, ck).awaitTermination()
    got = incremental.read_cache(spark, out)[0]
    assert got.count() == 3 * 8 and got.select("sample_id").distinct().count() == 3
    assert [r["sample_id"] for r in spark.read.parquet(f"{out}/rejects").collect()] == ["s0"]
    assert incremental.todo(spark.createDataFrame(rows, schema), got).count() == 1


def test_records_come_back_with_their_types(spark, tmp_path):
    df = spark.createDataFrame([("a", "topic", 1, 0.5, 0.25, "topic", "", True, -1.5), ("b", None, 0, None, 1e9, None, "x|y", False, 2.0)], "sample_id string, attack_type string, label int, s_max double, margin double, attribution string, fired string, decision boolean, s_topic double")
    sinks.write_csv(df, str(tmp_path / "r"))
    got = tables.read_records(spark, str(tmp_path / "r"))
    assert got.dtypes == df.dtypes and sorted(got.collect()) == sorted(df.collect())


def test_discard_removes_only_what_is_there(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    assert sinks.discard(spark, str(tmp_path / "t"), str(tmp_path / "u")) == [str(tmp_path / "t")]
    assert not (tmp_path / "t").exists()


def test_json_lines_are_appended(spark, tmp_path):
    p = str(tmp_path / "l")
    for k in (1, 2):
        sinks.append_jsonl(spark.createDataFrame([(k, "é"), (k, None)], "a int, b string"), p)
    assert sorted((r["a"], r["b"] or "") for r in tables.read_jsonl(spark, p, "a int, b string").collect()) == [(1, ""), (1, "é"), (2, ""), (2, "é")]
