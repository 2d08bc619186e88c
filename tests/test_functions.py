import re

import pytest
from pyspark.sql import functions as F

from quernel.config import Config
from quernel.functions import signals as S
from quernel.functions import text


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in df.select("i", f(F.col("x"))).orderBy("i").collect()]


def truncated(s, n):
    s = re.sub(r"\s+", " ", s).strip()
    return s if len(s) <= n else s[:n].rsplit(" ", 1)[0].rstrip(" ,;:.") + "."


def test_truncate_words(spark):
    values = ["", " a  b\n c ", "one two, three", "x" * 30, "one two;:. three four", "été là-bas encore"]
    assert column(spark, values, lambda c: text.truncate_words(c, 12)) == [truncated(v, 12) for v in values]


@pytest.mark.parametrize(("passage", "topic"), [("beta alpha beta alpha", "beta"), ("a of the", "subject"), ("", "subject"), ("zeta Alpha alpha zeta ALPHA", "alpha"), ("from this with that were", "subject"), ("abc abcd", "abcd")])
def test_topic_keyword(spark, passage, topic):
    assert column(spark, [passage], text.topic_keyword) == [topic]


def test_find_and_slice(spark):
    assert column(spark, ["abcabc", "xyz", ""], lambda c: text.find(c, F.lit("bc"), 2)) == [4, -1, -1]
    assert column(spark, ["abcdef"], lambda c: text.between(c, F.lit(1), F.lit(3))) == ["bc"]


def test_containment(spark):
    assert column(spark, ["the cat sat", "", "dog"], lambda c: text.containment(c, F.lit("a cat sat there"))) == [1.0, 1.0, 0.0]


def test_seed_is_md5(spark):
    import hashlib

    assert column(spark, ["abc"], text.seed_of) == [int(hashlib.md5(b"abc").hexdigest()[:8], 16)]


@pytest.mark.parametrize(("m", "w", "eps", "want"), [((10, 4), (10, 4), 0.0, 1.0), ((20, 8), (10, 4), 0.0, 1.0), ((3, 3), (3, 3), 1e-6, 1e6)])
def test_head_ratio(spark, m, w, eps, want):
    df = spark.createDataFrame([(float(m[0]), float(m[1]), *w)], "a double, b double, p int, i int")
    assert df.select(S.head_ratio(F.col("a"), F.col("b"), F.col("p"), F.col("i"), eps)).first()[0] == pytest.approx(want)


def test_probe_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, -1.0])], "a array<double>, b array<double>")
    got = df.select(S.dot(F.col("a"), F.col("b")), S.cosine(F.col("a"), F.col("a")), S.probe_score(F.col("a"), F.col("b"), F.lit(1.5))).first()
    assert got[0] == pytest.approx(-1.5) and got[1] == pytest.approx(1) and got[2] == pytest.approx(0.5)


def test_config():
    assert Config().candidate_layers(12) == list(range(3, 10)) and Config().candidate_layers(32) == list(range(8, 25))
    c = Config.from_env({"QUERNEL_TEST_MODE": "yes", "QUERNEL_SEED": "7", "QUERNEL_SPLIT_FRAC": "[0.5, 0.25, 0.25]", "QUERNEL_TARGET_FPR": "0.1"})
    assert (c.seed, c.split_frac, c.target_fpr, c.n_clean, c.calib_h_samples) == (7, (0.5, 0.25, 0.25), 0.1, 20, 24)
    assert Config().reference_precisions() == ["fp16", "bf16", "int8", "nf4"]
