"""Defined cases that the other tests leave out: empty tables, very long texts, repeated ids, clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quernel.llm import html_extract, minhash, quality, substring, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("key", "doc", "h", "kept", "times", "id", "n", "first", "last", "start", "length", "ids_crc32", "_row", "size")


def made(r, n):
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def odd_rows(r):
    long_ = made(r, 30_000)
    return [(1, long_), (2, long_), (3, long_ + " end"), (4, None), (5, ""), (6, " \t "), (None, made(r, 80)), (7, "x" * 200_000), (8, made(r, 60)), (8, made(r, 60))]


def frame(spark, rows):
    df = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in rows], SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES})


@pytest.fixture(scope="module")
def labelled(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(k, k % 2, 0) for k in (1, 2, 3, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_each_stage_takes_an_empty_table(spark, labelled, name):
    out = dict(pipeline.STAGES)[name](spark, frame(spark, []), labelled)
    assert out.count() == 0
    if name != "packing":
        assert set(out.columns) == set(frame(spark, []).columns)


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_each_stage_takes_odd_rows_and_clashing_columns(spark, labelled, name):
    rows = odd_rows(random.Random(3))
    df = frame(spark, rows)
    out = dict(pipeline.STAGES)[name](spark, df, labelled)
    if name == "packing":
        got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
        assert {r["doc_id"] for r in got} == {k for k, _ in rows} and all(r["n"] >= r["t"] for r in got)
        return
    assert set(out.columns) == set(df.columns)
    texts = [(r["doc_id"], r["text"]) for r in out.collect()]
    if name == "near-duplicates":  # the three long copies are one document; all others stay
        assert sorted(map(repr, texts)) == sorted(map(repr, [x for x in rows if x[0] not in (2, 3)]))
    elif name == "substring dedup":
        assert {k for k, _ in texts} >= {1, 4, 5, 7, 8} and (1, rows[0][1]) in texts and not any(k in (2, 3) and t and len(t) > 1000 for k, t in texts)
    else:
        assert all(t in rows for t in texts)


def test_near_duplicates_of_very_long_texts(spark):
    rows = odd_rows(random.Random(3))[:8]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got[1]["component_id"] == got[2]["component_id"] == got[3]["component_id"] == 1 and got[1]["n_shingles"] == 30_000 - 4
    assert got[7]["n_shingles"] == 1 and got[4]["n_shingles"] == got[6]["n_shingles"] == 0


def test_passages_of_very_long_texts_and_none(spark):
    r = random.Random(5)
    long_ = made(r, 20_000)
    inside = " ".join(long_.split()[9000:9100])
    found = substring.shared_passages(frame(spark, [(1, long_), (2, made(r, 40) + " " + inside + " " + made(r, 40)), (3, None), (4, made(r, 100))]))
    assert {x["doc_id"] for x in found.collect()} == {2}
    assert substring.shared_passages(frame(spark, [])).count() == 0


def test_token_counts_of_a_text_of_many_chunks(spark):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(6)
    texts = {1: made(r, 60_000), 2: "ab" * 40_000, 3: None, 4: "é" * 3000 + " " * 500 + "日本語" * 2000}
    got = {x["doc_id"]: x["n_tokens"] for x in token_counts.count_tokens(frame(spark, list(texts.items()))).collect()}
    assert got == {k: len(sp.encode(t or "")) for k, t in texts.items()}


def test_repeated_labels_and_long_labelled_texts(spark):
    rows = odd_rows(random.Random(3))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 1, 0), (8, 1, 0), (7, 0, 1), (2, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)


def test_pages_of_a_dealt_host_in_odd_rows(spark):
    """Copies by the thousand, repeated rows and ids, null ids, urls and pages, clashing columns, hosts with and without groups."""
    line = "every page of this host ends in these same ten words"
    page = lambda i: f"<p>own words of page w{i} x{i}</p><footer>{line}</footer><p>{line}</p>"
    rows = [(str(i), "HTTP://Dealt.example/a?b", page(i)) for i in range(40)]
    rows += [("7", "http://dealt.example/again", page(7))] * 1500 + [(None, "http://dealt.example", page(8)), ("none", "http://dealt.example", None), ("other", None, page(9)), ("other", "http://small.example", "")]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    for c in ("host", "digest", "text", "around", "dropped", "n", "salt", "run", "wanted"):
        df = df.withColumn(c, F.lit(c))
    got = html_extract.extract_text(df, group=4)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and dict(got.dtypes)["page_id"] == "string"
    got = [tuple(r) for r in got.collect()]
    own = lambda i: f"own words of page w{i} x{i}"
    want = [(k, u, (own(int(k)) if k is not None and k.isdigit() else own(8) if k is None else f"{own(9)} {line}" if u is None else "")) for k, u, _ in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted((r[:3] for r in got), key=key) == sorted(want, key=key) and all(r[3] == len(r[2]) for r in got)
