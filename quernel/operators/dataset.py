"""The labelled dataset: clean rows and templated insertions over base pairs, with ids and splits."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.config import Config
from quernel.functions import text
from quernel.operators import corpus

COLUMNS = ("id", "split", "attack_type", "goal", "passage", "query", "injection", "injection_offset", "label")


def build_dataset(pairs: DataFrame, cfg: Config, key: str = "source_id") -> DataFrame:
    """cfg.n_clean clean rows, then every kind x goal x cfg.n_inj_per_cell; base pairs in a hashed order, starting over
    when they run out. Base rows are at most as many as the dataset has rows, a size that the settings bound."""
    spark = pairs.sparkSession
    cells = corpus.cells(spark, cfg.n_inj_per_cell)
    total = cfg.n_clean + cfg.n_inj_per_cell * len(corpus.ATTACK_TYPES) * len(corpus.GOALS)
    order = [text.shuffled_by(F.col(key), cfg.seed), F.col(key), F.col("passage"), F.col("query")]
    base = pairs.select(key, "passage", "query").orderBy(*order).limit(total)
    base = base.withColumn("at", F.row_number().over(Window.orderBy(*order)) - 1)
    n = base.agg(F.count("*").alias("n"))
    clean = spark.range(cfg.n_clean).select(F.lit(-1).alias("type_ord"), F.lit("clean").alias("attack_type"), F.lit(-1).alias("goal_ord"), F.lit("-").alias("goal"), F.lit("").alias("goal_text"), F.col("id").alias("k"), F.col("id").alias("pos"))
    wanted = clean.unionByName(cells.withColumn("pos", F.col("pos") + cfg.n_clean))
    rows = wanted.join(F.broadcast(n)).withColumn("at", F.col("pos") % F.col("n")).join(base, "at")
    made = corpus.inject(rows.where("attack_type <> 'clean'")).withColumn("label", F.lit(1))
    none = F.lit(None).cast("struct<start:int,end:int>")
    plain = rows.where("attack_type = 'clean'").withColumns({"injection": F.lit(""), "injection_offset": none, "label": F.lit(0)})
    both = plain.unionByName(made)
    numbered = both.withColumn("id", F.format_string("%s%05d", F.when(F.col("label") == 0, "c").otherwise("i"), F.col("pos")))
    return corpus.stratified_split(numbered, ["attack_type", "goal"], "id", cfg.seed, cfg.split_frac).select(*COLUMNS)


def length_stats(dataset: DataFrame) -> DataFrame:
    """Lengths of insertions by kind."""
    n = F.length("injection")
    return dataset.where("label = 1").groupBy("attack_type").agg(F.min(n).alias("min"), F.avg(n).alias("mean"), F.max(n).alias("max"))


def latency(df: DataFrame, runs: int = 3) -> dict[str, float]:
    """Mean and least seconds of computing df whole, after one run to warm up."""
    took = []
    for i in range(runs + 1):
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        if i:
            took.append(time.perf_counter() - began)
    return {"mean_s": sum(took) / len(took), "min_s": min(took), "runs": runs}


def few_rows(df: DataFrame, key: str = "id", n: int = 5, seed: int = 42) -> DataFrame:
    """n rows in a hashed order, the same in every run: what latency is measured on."""
    return df.orderBy(text.shuffled_by(F.col(key), seed), key).limit(n)


def capped_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows, evenly over the kinds (clean ones are a kind): what precisions are compared on."""
    kinds = len(corpus.ATTACK_TYPES) + 1
    return corpus.sample_per_stratum(df, ["attack_type"], key, max(1, n // kinds), seed).drop("pick")
