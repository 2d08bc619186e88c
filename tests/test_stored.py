"""Each stored form against SQL over the tables that went into it, and its odd cases."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quernel.plans import stored
from quernel.sources import signals, sinks, tables

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(stored.QUERIES))
def test_stored_equals_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = stored.QUERIES[name](spark, SF)
    cur = duck.sql(stored.ORACLES[name])
    assert sorted(df.columns) == sorted(cur.columns)
    at = [cur.columns.index(c) for c in sorted(cur.columns)]
    want = sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    assert want and sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


def test_names_are_registered_once():
    from quernel.plans.queries import QUERIES

    assert not set(QUERIES) & set(stored.QUERIES) and set(stored.QUERIES) == set(stored.ORACLES)


def test_texts_of_any_kind_as_csv(spark, tmp_path):
    texts = ["", " ", 'say "no", then\ngo', "a,b", "\\", '\\"', '"', "ends in blanks  ", "\ttab", "#", "née ☃", "null", "\n\n"]
    sinks.write_text_csv(spark.createDataFrame([(t, f"q{i}", "s") for i, t in enumerate(texts)], "context string, question string, source_id string"), str(tmp_path / "t"))
    got = {r["query"]: (r["passage"], r["source_id"]) for r in tables.read_pairs_csv(spark, str(tmp_path / "t"), source=None).collect()}
    assert got == {f"q{i}": (t or None, "s") for i, t in enumerate(texts)}
    (tmp_path / "w.csv").write_bytes(b'text,question\r\n"one, two",why\r\n')  # line ends of another kind
    assert [tuple(r) for r in tables.read_pairs_csv(spark, str(tmp_path / "w.csv")).collect()] == [("one, two", "why", "local_csv")]
    with pytest.raises(ValueError, match="lacks source_id"):
        tables.read_pairs_csv(spark, str(tmp_path / "w.csv"), source=None)


def test_missing_files_are_told_by_the_store(spark, tmp_path):
    assert not sinks.exists(spark, f"file://{tmp_path}/none") and sinks.exists(spark, f"file://{tmp_path}")
    rows, rejects = tables.split_jsonl(spark, f"file://{tmp_path}/none", "a int")
    assert rows.count() == rejects.count() == 0


def test_layer_files_are_replaced_whole(spark, tmp_path):
    p = f"file://{tmp_path}/h"
    df = spark.createDataFrame([("a", 0, [1.0]), ("b", 11, [2.0]), ("c", 11, [3.0]), ("d", 1, None)], "sample_id string, layer int, vec array<float>")
    signals.write_hidden_files(df, p)
    assert sorted(n for n in os.listdir(tmp_path / "h") if not n.startswith(".")) == ["hid_l0.parquet", "hid_l1.parquet", "hid_l11.parquet"] and os.listdir(tmp_path) == ["h"]
    signals.write_hidden_files(df.where("layer = 11").withColumn("sample_id", F.upper("sample_id")), p)
    got = sorted(map(tuple, signals.read_hidden_files(spark, p).collect()))
    assert got == [("B", 11, [2.0]), ("C", 11, [3.0]), ("a", 0, [1.0]), ("d", 1, None)]
    assert [r["sample_id"] for r in signals.read_hidden_files(spark, p, [1]).collect()] == ["d"]
    signals.write_hidden_files(df.limit(0), f"file://{tmp_path}/none")
    assert signals.read_hidden_files(spark, f"file://{tmp_path}/none").count() == 0
