import random

import pytest
from pyspark.sql import functions as F

from quernel.llm import queries

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, SF)
        docs = docs.persist()
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == columns
        if i == 1:
            assert docs.select("doc_id").distinct().count() == docs.count()
        if i == 2:
            assert all(r["n_chars"] == len(r["text"]) <= len(texts[r["doc_id"]]) for r in docs.collect())
    assert counts[0] > counts[1] > counts[2] >= counts[3] and {"sequence_id", "offset"} <= set(docs.columns)


def test_run_again_gives_the_same(spark):
    a, b = (sorted(map(tuple, pipeline.run(spark, SF).collect())) for _ in range(2))
    assert a == b and len(a) > 50


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_every_distinct_text_stays(spark):
    r = random.Random(5)
    made = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    a, b, c, d, e = (made(90) for _ in range(5))
    near, shares = a + " more", made(30) + " " + " ".join(a.split()[10:80]) + " " + made(30)
    # id 2: a near copy of an earlier document and a text of its own; id 5: one text shares a passage, the other doesn't
    rows = [(1, a), (2, near), (2, b), (None, c), (None, d), (None, c), (None, near), (3, e), (3, e), (5, shares), (5, b + " " + e)]
    df = spark.createDataFrame([(k, t, "en", "web", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.near_duplicate_stage(spark, df, SF).persist()
    assert sorted((x["text"], x["doc_id"] or 0) for x in kept.collect()) == sorted([(a, 1), (b, 2), (c, 0), (d, 0), (e, 3), (shares, 5), (b + " " + e, 5)])
    one = df.where(F.col("text").isin(a, c, d, shares) | ((F.col("doc_id") == 5) & (F.col("text") != shares))).distinct()
    cut = {x["text"] for x in pipeline.substring_stage(spark, one, SF).collect()}
    assert {a, c, d, b + " " + e} <= cut and shares not in cut and len(cut) == 5
    assert {x["text"] for x in pipeline.mixing_stage(spark, one, SF).collect()} == {a, c, d, shares, b + " " + e}
