"""The analytics tables as views of the driver's tables: samples, masses, widths, hidden vectors, pairs, detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import corpus

LAYERS, HEADS, WIDTH = 4, 4, 16
KINDS = {6: "topic", 7: "naive", 8: "fake", 9: "combined"}
#: Detectors with fixed numbers: name, order, kind, layer, head, layer of the probe, alpha, r_mu, r_sd, p_mu, p_sd, theta.
SPECS = (
    ("topic", 0, "topic", 0, 1, 0, 0.5, 0.4, 0.5, 0.5, 0.05, 1.1),
    ("naive", 1, "naive", 1, 2, 1, 0.4, 0.5, 0.6, 0.5, 0.04, 1.0),
    ("fake", 2, "fake", 2, 3, 2, 0.6, 0.6, 0.7, 0.5, 0.05, 1.2),
    ("combined", 3, "combined", 3, 0, 3, 0.3, 0.4, 0.5, 0.5, 0.06, 0.9),
    ("general", 4, None, 0, 0, 1, 0.5, 0.5, 0.5, 0.5, 0.05, 1.3),
)
COEF = [[((d * 7 + o * 3) % 5 - 2) / 4.0 for d in range(WIDTH)] for o in range(len(SPECS))]
BIAS = [0.01 * o for o in range(len(SPECS))]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("v"), F.lpad(F.col("vec_id").cast("string"), 5, "0")).alias("sample_id"), "vec_id", F.col("label").alias("lab"), F.col("embedding").cast("array<double>").alias("e"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, vec_id, attack_type, label, split."""
    kind = F.coalesce(*(F.when(F.col("lab") == k, F.lit(v)) for k, v in KINDS.items()), F.lit("clean"))
    base = _vectors(spark, sf_dir).select("sample_id", "vec_id", kind.alias("attack_type"), (F.col("lab") > 5).cast("int").alias("label"))
    return corpus.stratified_split(base, ["attack_type"], "sample_id")


def masses(spark: SparkSession, sf_dir: str, quantized: bool = False) -> DataFrame:
    """sample_id, layer, head, m_qp, m_qi, m_qq: head g over elements 4g to 4g + 3."""
    e = F.transform("e", lambda x: F.round(x * 8) / 8) if quantized else F.col("e")
    v = _vectors(spark, sf_dir).select("sample_id", F.transform(e, F.abs).alias("e"))
    rows = F.array(*(F.struct(F.lit(i // HEADS).alias("layer"), F.lit(i % HEADS).alias("head"), (F.col("e")[4 * i] + F.col("e")[4 * i + 1] + F.col("e")[4 * i + 2] + F.col("e")[4 * i + 3]).alias("m_qp"), F.col("e")[4 * i].alias("m_qi"), F.col("e")[4 * i + 3].alias("m_qq")) for i in range(LAYERS * HEADS)))
    return v.select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")


def widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return v.select("sample_id", (F.lit(8) + F.col("vec_id") % 5).cast("int").alias("w_p"), (F.lit(2) + F.col("vec_id") % 3).cast("int").alias("w_i"), F.lit(4).alias("w_q"))


def hidden(spark: SparkSession, sf_dir: str, quantized: bool = False) -> DataFrame:
    """sample_id, layer, vec: slices of 16 elements."""
    e = F.transform("e", lambda x: F.round(x * 8) / 8) if quantized else F.col("e")
    v = _vectors(spark, sf_dir).select("sample_id", e.alias("e"))
    rows = F.array(*(F.struct(F.lit(i).alias("layer"), F.slice("e", WIDTH * i + 1, WIDTH).alias("vec")) for i in range(LAYERS)))
    return v.select("sample_id", F.explode(rows).alias("r")).select("sample_id", "r.*")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, passage, query, source_id: each document with a benchmark text as its question."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    n = bench.agg(F.count("*").alias("n"))
    return docs.join(F.broadcast(n)).withColumn("item_id", F.col("doc_id") % F.col("n")).join(bench.select("item_id", F.col("text").alias("query")), "item_id").select("doc_id", F.col("text").alias("passage"), "query", F.col("source").alias("source_id"))


def specs(spark: SparkSession) -> DataFrame:
    rows = [(n, o, k, l, h, s, COEF[o], BIAS[o], a, rm, rs, pm, ps, t) for n, o, k, l, h, s, a, rm, rs, pm, ps, t in SPECS]
    from quernel.operators.calibrate import SPEC_SCHEMA

    return spark.createDataFrame(rows, SPEC_SCHEMA)
