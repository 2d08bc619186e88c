import random

import pytest
from pyspark.sql import functions as F

from quernel.operators import metrics


def brute_auroc(rows):
    p, n = [s for s, y in rows if y], [s for s, y in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n)) if p and n else 0.5


def groups(seed, size=60):
    r = random.Random(seed)
    return {g: [(round(r.choice([r.random(), r.randint(0, 3) / 4]), 3), int(r.random() < 0.4)) for _ in range(size)] for g in range(4)} | {9: [(0.1, 1), (0.2, 1)], 10: [(1.0, 0), (2.0, 0), (2.0, 1), (3.0, 1)]}


@pytest.fixture(scope="module")
def frame(spark):
    data = groups(5)
    return data, spark.createDataFrame([(g, s, y) for g, rows in data.items() for s, y in rows], "g int, score double, label int")


@pytest.mark.parametrize("parts", [1, 4, 32])
def test_auroc(frame, parts):
    data, df = frame
    got = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], parts=parts).collect()}
    assert got == pytest.approx({g: brute_auroc(rows) for g, rows in data.items()})
    assert got[10] == 0.875 and got[9] == 0.5


def test_auroc_without_groups(frame):
    data, df = frame
    assert metrics.auroc(df, []).first()["auroc"] == pytest.approx(brute_auroc([x for rows in data.values() for x in rows]))


def test_choose_theta(frame):
    data, df = frame
    got = {r["g"]: r for r in metrics.choose_theta(df, ["g"], F.lit(0.2)).collect()}
    for g, rows in data.items():
        pos, neg = sum(y for _, y in rows), sum(1 - y for _, y in rows)
        best = None
        for theta in sorted({s for s, _ in rows}, reverse=True):
            tp, fp = sum(y for s, y in rows if s > theta), sum(1 - y for s, y in rows if s > theta)
            if fp / max(1, neg) > 0.2 + 1e-12:
                continue
            prec, tpr = tp / max(1, tp + fp), tp / max(1, pos)
            f1 = 2 * prec * tpr / max(1e-12, prec + tpr)
            if best is None or round(f1, 12) > best[0]:
                best = (round(f1, 12), theta)
        assert (got[g]["f1"], got[g]["theta"]) == pytest.approx(best)
        assert got[g]["fpr"] <= 0.2 + 1e-12


def test_roc_points_end_at_one(frame):
    _, df = frame
    last = metrics.roc_points(df, ["g"]).groupBy("g").agg(F.max("tpr").alias("t"), F.max("fpr").alias("f")).where("g < 4").collect()
    assert all(r["t"] == 1 and r["f"] == 1 for r in last)


def test_pearson_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert df.agg(metrics.pearson(F.col("a"), F.col("b"))).first()[0] == 0
    assert df.agg(metrics.pearson(F.col("b"), -F.col("b"))).first()[0] == pytest.approx(-1)


def test_histogram_holds_all_rows(spark):
    df = spark.range(100).select((F.col("id") / 10).alias("x"))
    got = {r["bin"]: r["n"] for r in metrics.histogram(df, [], "x").collect()}
    assert sum(got.values()) == 100 and max(got) <= 38


def test_confusion_is_dense(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", None)], "t string, p string")
    assert {(r[0], r[1]): r[2] for r in metrics.confusion(df, "t", "p").collect()} == {(x, y): int((x, y) in {("a", "a"), ("a", "b")}) for x in "abc" for y in "abc"}
