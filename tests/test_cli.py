import json
import os
import zipfile
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quernel import cli
from quernel.config import Config
from quernel.functions import arrays
from quernel.operators import dataset
from quernel.sources import tables, versions
from quernel.streaming import incremental

SECTIONS = ("Criteria", "Detectors", "Overall", "By kind", "Attribution", "Baselines", "Spread by configuration", "Decision modes", "Unseen kind", "Correlation of detectors", "Cross firing", "Widths", "Precision")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    """All stages, one after the other; the extractor leaves a line a call."""
    d, cfg = str(tmp_path_factory.mktemp("run")), replace(Config().shrunk(), n_latency_runs=1)
    calls = f"{d}/calls"

    def extractor(sample_id, n_tokens, p, i, q):
        with open(calls, "a") as f:
            f.write(sample_id + "\n")
        return incremental.stub_extractor(sample_id, n_tokens, p, i, q)

    for s in ("dataset", "gate", "extract", "calibrate", "decide", "quant", "report", "latency", "bundle"):
        assert cli.run(spark, s, d, cfg, extractor=extractor) == 0
    return d, cfg, versions.folder(spark, d), calls


def test_stages_run_one_after_the_other(spark, done):
    d, cfg, out, _ = done
    data = tables.read_table(spark, f"{out}/dataset", tables.DATASET)
    assert data.count() == 120 and data.where("label = 1").count() == 100 and data.select("id").distinct().count() == 120
    assert {tuple(r) for r in data.where("label = 1").groupBy("attack_type", "goal").pivot("split", ["train", "val", "test"]).count().select("train", "val", "test").collect()} == {(3, 1, 1)}
    assert data.where(F.expr("label = 1 and substring(passage, injection_offset.start + 1, injection_offset.end - injection_offset.start) <> injection")).count() == 0
    text = open(f"{out}/RESULTS.md").read()
    assert all(f"## {s}" in text for s in SECTIONS) and text.count("MET") + text.count("n/a |") >= 7 and os.path.exists(f"{out}/test_records")
    assert cli.run(spark, "dataset", d, cfg) == 0 and versions.folder(spark, d) == out  # nothing to do
    assert dataset.length_stats(data).count() == 4 and dataset.latency(data.limit(1), 1)["runs"] == 1
    spec = tables.load_json(f"{out}/specs.json")
    assert [s["name"] for s in spec] == ["topic", "naive", "fake", "combined", "general"] and all(len(s["h_base"]) == 4 and s["auroc_cos"] is not None and s["auroc_shared"] is not None for s in spec)
    assert tables.load_json(f"{out}/latency.json")["runs"] == 1 and tables.load_json(f"{out}/quant_compare.json")["precision"] == "fp16"


def test_a_sample_is_extracted_once(spark, done):
    _, _, out, calls = done
    lines = open(calls).read().split()
    assert len(lines) == len(set(lines)) == 120
    masses, widths, hidden = incremental.read_cache(spark, out)
    assert (masses.count(), widths.count(), hidden.count()) == (120 * 8, 120, 120 * 2)


def test_the_bundle_says_what_it_ran_on(done):
    _, _, out, _ = done
    with zipfile.ZipFile(f"{out}/bundle.zip") as z:
        assert {"environment.json", "specs.json", "RESULTS.md"} <= set(z.namelist())
        about = json.loads(z.read("environment.json"))
    assert about["settings"]["seed"] == 42 and len(about["code"]["cli.py"]) == 64 and sum(r["train"] + r["val"] + r["test"] for r in about["sizes"]) == 120
    assert any(f.startswith("masses/") for f, _ in about["files"])


def test_settings_act(spark, done):
    d, cfg, out, _ = done
    before = tables.load_json(f"{out}/specs.json")
    env = {"QUERNEL_ALPHA_STEP": "0.5", "QUERNEL_TOP_K_HEADS": "2", "QUERNEL_ATTN_LAST_K": "1", "QUERNEL_PROBE_FIT_FRAC": "0.4", "QUERNEL_EPSILON": "0.5"}
    other = Config.from_env(env)
    other = replace(cfg, alpha_step=other.alpha_step, top_k_heads=other.top_k_heads, attn_last_k=other.attn_last_k, probe_fit_frac=other.probe_fit_frac, epsilon=other.epsilon)
    assert cli.run(spark, "calibrate", d, other) == 0
    after = tables.load_json(f"{out}/specs.json")
    assert {s["alpha"] for s in after} <= {0.0, 0.5, 1.0} and {len(s["top_k"]) for s in after} == {2} and {len(s["top_k"]) for s in before} == {5}
    assert {s["layer"] for s in after} == {1} and [s["r_mu"] for s in after] != [s["r_mu"] for s in before]
    assert cli.run(spark, "calibrate", d, cfg) == 0 and tables.load_json(f"{out}/specs.json") == before


def test_stream_fills_the_cache_that_later_stages_read(spark, tmp_path):
    d, cfg = str(tmp_path / "d"), Config().shrunk()
    assert [cli.run(spark, s, d, cfg) for s in ("dataset", "stream", "stream", "calibrate", "decide")] == [0] * 5
    out = versions.folder(spark, d)
    state = lambda: [sorted(map(repr, t.collect())) for t in incremental.read_cache(spark, out)]
    first = state()
    assert len(first[1]) == 120
    rows = tables.read_table(spark, f"{out}/dataset", tables.DATASET).withColumnRenamed("id", "sample_id")
    from quernel.operators import spans

    encoded = spans.encode(rows, cfg.max_seq_len, cfg.tail_len)
    for batch in (0, 0, 7):  # a batch that runs again, and samples that come again under another number
        incremental.add_batch(encoded, out, batch)
        assert state() == first
    assert cli.run(spark, "extract", d, cfg) == 0 and state() == first
    # another dataset begins without signals; the first one's stay where they are
    assert cli.run(spark, "dataset", d, replace(cfg, n_clean=30)) == 0
    assert versions.folder(spark, d) != out and incremental.read_cache(spark, versions.folder(spark, d))[1].count() == 0 and state() == first
    assert cli.run(spark, "dataset", d, cfg) == 0 and versions.folder(spark, d) == out and state() == first


def test_half_and_offsets(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([([0.1, 1.0, 70000.0], "two words é"), (None, None)], "v array<float>, t string")
    a, b = df.select(arrays.half(F.col("v")), arrays.tokenizer_offsets(P.path("byte_bpe_50k.json"))(F.col("t"))).collect()
    assert abs(a[0][0] - 0.1) < 1e-4 and a[0][1] == 1.0 and a[0][2] == float("inf") and b[0] is None
    assert [tuple(x) for x in a[1]][0] == (0, 3) and b[1] is None


def test_lowered_precisions(spark):
    import numpy as np

    x = [0.0, 1.0, -0.1, 3.14159, 1e-3, 250.7, -7.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    half, brain, eight = zip(*df.select(*(arrays.lowered(F.col("x"), p) for p in ("fp16", "bf16", "int8"))).collect(), strict=True)
    assert list(half) == [float(np.float16(v)) for v in x]
    assert all(abs(b - v) <= abs(v) / 256 for b, v in zip(brain, x, strict=True)) and eight[3] == 1.0 and abs(eight[2] + 0.1) < 1 / 254
    with pytest.raises(ValueError, match="unknown precision"):
        arrays.lowered(F.col("x"), "nf4")
