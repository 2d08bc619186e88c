import json
import os

import pytest
from pyspark.sql import functions as F

from quernel.sources import signals, tables, versions


def test_a_reader_keeps_its_version_while_another_is_built(spark, tmp_path):
    root = str(tmp_path)
    assert versions.current(spark, root) is None
    with pytest.raises(ValueError, match="no version"):
        versions.folder(spark, root)
    said, changed = versions.publish(spark, root, "t", lambda: spark.range(5), source="first")
    assert changed and said["rows"] == 5 and said["source"] == "first" and said == versions.current(spark, root)
    before = spark.read.parquet(f"{versions.folder(spark, root)}/t")
    assert versions.publish(spark, root, "t", lambda: spark.range(5).orderBy(F.desc("id"))) == (said, False)
    said2, changed = versions.publish(spark, root, "t", lambda: spark.range(7))
    assert changed and before.count() == 5 and spark.read.parquet(f"{versions.folder(spark, root)}/t").count() == 7
    # back to the first: its folder is found again
    assert versions.publish(spark, root, "t", lambda: spark.range(5), source="again")[0]["version"] == said["version"]
    assert versions.discard_others(spark, root) == [said2["version"]]
    assert os.listdir(f"{root}/versions") == [said["version"]]


def test_a_killed_build_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    said, _ = versions.publish(spark, root, "t", lambda: spark.range(5))

    def killed():
        spark.range(9).write.parquet(f"{root}/versions/.building-x/t")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        versions.publish(spark, root, "t", killed)
    assert versions.current(spark, root) == said and spark.read.parquet(f"{versions.folder(spark, root)}/t").count() == 5
    # killed after the folder has its name, before the pointer: the old one stays, and building again goes on
    monkeypatch.setattr(versions, "_point", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        versions.publish(spark, root, "t", lambda: spark.range(6))
    assert versions.current(spark, root) == said
    monkeypatch.undo()
    assert versions.publish(spark, root, "t", lambda: spark.range(6))[0]["rows"] == 6
    assert set(versions.discard_others(spark, root)) == {said["version"], ".building-x"}
    assert json.loads((tmp_path / versions.POINTER).read_text())["rows"] == 6


LINES = ['{"a": 1, "b": "x"}', "", '{"a": 2', "   ", "[1, 2]", "3", "null", '{"a": "no number"}', '{"b": "only"}', "{}", "nonsense", '{"a": 3, "c": 4}']


def test_json_lines_are_rows_rejects_or_blank(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text("\n".join(LINES) + "\n")
    rows, rejects = tables.split_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string")
    assert sorted(map(repr, (tuple(r) for r in rows.collect()))) == sorted(map(repr, [(1, "x"), (None, "only"), (None, None), (3, None)]))
    bad = [r["line"] for r in rejects.collect()]
    assert sorted(bad) == sorted(['{"a": 2', "[1, 2]", "3", "null", '{"a": "no number"}', "nonsense"])
    assert rows.count() + len(bad) + sum(not x.strip() for x in LINES) == len(LINES)
    assert all(r["file"].endswith("x.jsonl") for r in rejects.collect())
    with pytest.raises(Exception, match="malformed line"):
        tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()
    assert [d.count() for d in tables.split_jsonl(spark, str(tmp_path / "none"), "a int")] == [0, 0]


def test_layers_come_from_file_names(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for layer in (0, 3, 12):
        pq.write_table(pa.table({"sample_id": ["a", "b"], "vec": pa.array([[float(layer)], [1.0]], pa.list_(pa.float32()))}), tmp_path / f"hid_l{layer}.parquet")
    pq.write_table(pa.table({"sample_id": ["z"]}), tmp_path / "other.parquet")
    (tmp_path / "hid_l7.parquet.tmp").write_text("not finished")
    every = signals.read_hidden_files(spark, str(tmp_path))
    assert every.columns == ["sample_id", "layer", "vec"] and sorted((r["sample_id"], r["layer"], r["vec"][0]) for r in every.collect()) == sorted((s, x, float(x) if s == "a" else 1.0) for s in "ab" for x in (0, 3, 12))
    one = signals.read_hidden_files(spark, str(tmp_path), [3])
    assert [os.path.basename(f) for f in one.inputFiles()] == ["hid_l3.parquet"] and one.count() == 2
    assert signals.read_hidden_files(spark, str(tmp_path), []).count() == 0


def test_sources_passed_over_are_told(spark):
    said = []
    assert tables.first_source([("csv", lambda: 1 / 0), ("empty", lambda: spark.range(0)), ("made", lambda: spark.range(1))], said.append)[0] == "made"
    assert said == ["passed over csv: ZeroDivisionError: division by zero", "passed over empty: no rows"]
