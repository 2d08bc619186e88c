import pytest
from pyspark.sql import functions as F

from quernel.operators import corpus, spans


@pytest.mark.parametrize(("n", "want"), [(5, (3, 1, 1)), (20, (12, 4, 4)), (50, (30, 10, 10)), (1000, (600, 200, 200))])
def test_split_sizes(spark, n, want):
    df = corpus.stratified_split(spark.range(n).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("s")), ["s"], "k")
    got = {r[0]: r[1] for r in df.groupBy("split").count().collect()}
    assert tuple(got.get(x, 0) for x in ("train", "val", "test")) == want


def test_synthetic_pairs_repeat(spark):
    df = corpus.synthetic_pairs(spark, 600)
    assert df.count() == 600 and df.select("passage", "query").distinct().count() == 200


def test_injection_offsets(spark):
    cells = corpus.cells(spark, 2)
    assert cells.count() == 40 and cells.select("pos").distinct().count() == 40
    df = corpus.inject(cells.withColumn("passage", F.lit("Gardens grow in quiet gardens.")))
    bad = df.where(F.expr("substring(passage, injection_offset.start + 1, injection_offset.end - injection_offset.start) <> injection")).count()
    assert bad == 0
    topic = df.where("attack_type = 'topic' and goal = 'info_leak' and k = 0").first()["injection"]
    assert topic.startswith("A note about the gardens material above: Ignore all")


def test_clean_pairs(spark):
    long = "word " * 60
    df = spark.createDataFrame([(3, long, "q", "b"), (1, long, "q", "a"), (2, "short", "q", "c")], "i int, passage string, query string, source_id string")
    got = corpus.clean_pairs(df, "i").collect()
    assert [(r["i"], r["source_id"]) for r in got] == [(1, "a")]


def test_row_ids(spark):
    df = spark.createDataFrame([(0, "clean", "b"), (0, "clean", "a"), (1, "fake", "c")], "label int, attack_type string, k string")
    assert {r["k"]: r["id"] for r in corpus.row_ids(df, ["label", "attack_type"], ["k"]).collect()} == {"a": "c00000", "b": "c00001", "c": "i00002"}


def test_span_tokens(spark):
    df = spark.createDataFrame([([(0, 3), (3, 6), (6, 9)],)], "o array<struct<s:int,e:int>>")
    got = df.select(spans.span_tokens(F.col("o"), F.lit(2), F.lit(6)).alias("a"), spans.span_tokens(F.col("o"), F.lit(9), F.lit(12)).alias("b")).first()
    assert tuple(got["a"]) == (0, 2) and got["b"] is None


def test_encode_and_gate(spark):
    rows = [("a", "The first passage is about rivers and rain.", "What is it about?", "", None), ("b", "Short one. IMPORTANT", "Why?", "IMPORTANT", (11, 20)), ("c", "gone", "q", "not there", None)]
    df = spark.createDataFrame(rows, "sample_id string, passage string, query string, injection string, injection_offset struct<start:int,end:int>")
    e = spans.encode(df, tail=3)
    got = {r["sample_id"]: r for r in e.collect()}
    assert got["a"]["valid"] and tuple(got["a"]["i_tok"]) == (got["a"]["p_tok"]["e"] - 3, got["a"]["p_tok"]["e"])
    assert got["b"]["valid"] and not got["c"]["valid"] and got["c"]["note"] == spans.NOTES["injection"]
    s = spans.gate_summary(spans.gate(e)).first()
    assert (s["n_samples"], s["n_ok"], s["passed"]) == (3, 2, False)
    assert spans.gate_summary(spans.gate(e.where("valid"))).first()["passed"]


def test_mass_reduce(spark):
    a = spark.range(5).select(F.lit("s").alias("sample_id"), F.lit(0).alias("layer"), F.lit(0).alias("head"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("kpos"), F.col("id").cast("int").alias("qpos"), F.lit(1.0).alias("a"))
    r = spark.sql("select 's' sample_id, named_struct('s', 0, 'e', 3) p_tok, named_struct('s', 1, 'e', 3) i_tok, named_struct('s', 3, 'e', 5) q_tok")
    assert tuple(spans.mass_reduce(a, r).first())[3:] == (6.0, 4.0, 4.0)


def test_spans_by_spaces_equal_those_by_offsets(spark):
    import random

    r = random.Random(4)
    rows = [("".join(r.choice("ab  c") for _ in range(r.randint(0, 30))), r.randint(0, 32), r.randint(0, 34)) for _ in range(300)]
    df = spark.createDataFrame([x for x in rows if x[1] < x[2]], "p string, a int, b int")
    p, a, b = F.col("p"), F.col("a"), F.col("b")
    by_offsets, by_spaces = spans.span_tokens(spans.word_offsets(p), a, b), spans.word_span(p, a, b)
    got = df.select(by_offsets.alias("x"), by_spaces.alias("y"), spans.decoded(p, spans.word_offsets(p), by_offsets).alias("t"), spans.word_text(p, by_spaces).alias("u")).collect()
    assert all(tuple(g["x"] or ()) == tuple(g["y"] or ()) and g["t"] == g["u"] for g in got) and any(g["x"] for g in got)


def test_positions_by_hash_and_by_range(spark):
    from quernel.operators import ranks

    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"), F.when(F.col("id") % 7 > 0, F.lit("x")).alias("n"))
    rows = ranks.by_hash(df, ["g", "n"], F.md5("k"), "k", "pos", "size").withColumn("h", F.md5("k")).collect()
    for key in {(x["g"], x["n"]) for x in rows}:
        own = sorted((x for x in rows if (x["g"], x["n"]) == key), key=lambda x: x["h"])
        assert [x["pos"] for x in own] == list(range(1, len(own) + 1)) and {x["size"] for x in own} == {len(own)}
    ordered = sorted(ranks.by_range(df, ["g", "k"], "pos").collect(), key=lambda x: x["pos"])
    assert [(x["g"], x["k"]) for x in ordered] == sorted((x["g"], x["k"]) for x in rows) and [x["pos"] for x in ordered] == list(range(1, 501))
