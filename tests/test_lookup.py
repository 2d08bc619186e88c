import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import lookup, metrics, spans


def test_rows_come_in_the_order_asked_for(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "id string, v int")
    want = lookup.numbered(spark, ["c", "b", "c"], "id")
    assert [tuple(r) for r in lookup.in_order(want, t, "id").orderBy("ord", "v").collect()] == [(0, "c", 4), (1, "b", 2), (1, "b", 3), (2, "c", 4)]
    with pytest.raises(ValueError, match="both sides have v"):
        lookup.in_order(want.withColumn("v", F.lit(1)), t, "id")


@pytest.mark.parametrize("key", ["nowhere", None])
def test_a_missing_key_fails_the_job(spark, key):
    t = spark.createDataFrame([("a", 1)], "id string, v int")
    want = lookup.numbered(spark, ["a", key], "id")
    with pytest.raises(Exception, match=f"no row for {key or 'null'}"):
        lookup.in_order(want, t, "id").collect()
    with pytest.raises(Exception, match="no row for"):
        lookup.in_order(want, t, "id").agg(F.count("id")).collect()
    assert [(r["ord"], r["v"], r["found"]) for r in lookup.in_order(want, t, "id", strict=False).orderBy("ord").collect()] == [(0, 1, True), (1, None, False)]


def test_overlaps_equal_those_within_the_row(spark):
    r = random.Random(4)
    texts = [(i, " ".join("x" * r.randrange(0, 30) for _ in range(r.randrange(1, 80))), r.randrange(0, 300), r.randrange(0, 500)) for i in range(60)] + [(60, "y" * 5000, 10, 4000), (61, "", 0, 5)]
    df = spark.createDataFrame(texts, "id int, t string, a int, b int").withColumn("o", spans.word_offsets(F.col("t")))
    within = {r["id"]: (r["x"]["s"], r["x"]["e"]) for r in df.select("id", spans.span_tokens(F.col("o"), F.col("a"), F.col("b")).alias("x")).collect() if r["x"]}
    within = {k: v for k, v in within.items() if texts[k][2] < texts[k][3]}
    tokens = df.select("id", F.posexplode("o").alias("pos", "x")).select("id", "pos", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    found = lookup.overlapping(tokens, df.select("id", F.lit("only").alias("span"), F.col("a").alias("start"), F.col("b").alias("end")), "id", 16)
    assert {r["id"]: (r["s"], r["e"]) for r in found.collect()} == within and len(within) > 20
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_median_equals_sorting(spark, few):
    r = random.Random(few)
    groups = {"odd": [r.gauss(0, 1) for _ in range(501)], "even": [r.choice([1.0, 2.0, 3.0]) for _ in range(400)], "far": [-1e308, 1e308, 1e-300, 5e-324, 0.0, 2.0], "one": [7.5], "same": [3.25] * 50, "steep": [10.0**i for i in range(-150, 150)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("odd", None), ("odd", float("nan")), ("none", None)]
    got = {x["g"]: x["median"] for x in metrics.median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", bins=16, few=few).collect()}
    mid = lambda s: s[(len(s) - 1) // 2] / 2 + s[len(s) // 2] / 2
    assert got == {g: mid(sorted(v)) for g, v in groups.items()}
    one = metrics.median(spark.createDataFrame([(3.0,), (1.0,)], "v double"), [], "v").collect()
    assert [x["median"] for x in one] == [2.0]
