"""Vectors whose ids begin with the same five digits share a sample_id: queries against SQL where samples do."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
KINDS_DIFFER = ["masses_json_roundtrip", "signal_cache_roundtrip", "attention_mass_reduce", "half_vectors", "meta_per_spec", "meta_margin", "meta_fired", "meta_global_max", "pearson_matrix", "pooled_head", "hstar_head_auroc", "quant_head_corr", "quant_best_head", "quant_summary", "alpha_grid", "alpha_best", "calibrated_specs", "tableE_recalibrated"]
#: SQL gives an id any of its samples' kinds: told only where they are of one kind.
ONE_KIND = ["eval_overall", "eval_per_type", "mean_asr", "attribution_accuracy", "attribution_confusion", "confusion_dense", "criteria", "records_csv_roundtrip", "tableE_unseen", "criteria_comparisons"]


def plain(v):
    return None if v is None else round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def folder(at, same_kind):
    """500 vectors, 120 of which share 40 sample_ids, three each: of one kind, or as they come."""
    rows = pq.read_table(f"{SF}/embeddings.parquet").sort_by("vec_id").to_pylist()
    if same_kind:
        rows.sort(key=lambda r: (r["label"] if r["label"] > 5 else 0, r["vec_id"]))
    i, out = 0, []
    while i < len(rows):
        if i % 12 == 0 and i < 480 and (not same_kind or len({r["label"] if r["label"] > 5 else 0 for r in rows[i : i + 3]}) == 1):
            out += [{**r, "vec_id": v} for r, v in zip(rows[i : i + 3], (10000 + i, 100000 + 10 * i, 100007 + 10 * i), strict=True)]
            i += 3
        else:
            out.append({**rows[i], "vec_id": i})
            i += 1
    pq.write_table(pa.Table.from_pylist(out, pq.read_schema(f"{SF}/embeddings.parquet")), at / "embeddings.parquet")
    return str(at)


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("mixed"), False)


@pytest.fixture(scope="module")
def alike(tmp_path_factory):
    return folder(tmp_path_factory.mktemp("alike"), True)


def equals_sql(spark, name, d):
    duck = duckdb.connect()
    for f in os.listdir(d):
        duck.sql(f"create view {f[:-8]} as select * from '{d}/{f}'")
    assert duck.sql("select max(n) from (select count(*) n from embeddings group by lpad(vec_id::varchar, 5, '0'))").fetchall() == [(3,)]
    df = __spark_entry__.queries()[name](spark, d)
    cur = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(df.columns) == sorted(cur.columns)
    at = [cur.columns.index(c) for c in sorted(cur.columns)]
    want = sorted(repr([plain(r[i]) for i in at]) for r in cur.fetchall())
    assert want and sorted(repr([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", KINDS_DIFFER)
def test_samples_of_several_kinds(spark, mixed, name):
    equals_sql(spark, name, mixed)


@pytest.mark.parametrize("name", ONE_KIND)
def test_samples_of_one_kind(spark, alike, name):
    equals_sql(spark, name, alike)
