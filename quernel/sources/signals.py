"""Signal caches: masses stored as JSON become long rows; hidden vectors come from one folder per layer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.sources import tables

WIDTHS = ("passage_tokens", "inj_tokens", "query_tokens")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    return tables.require_columns(spark.read.parquet(path), WIDTHS, f"the signal cache {path}")


def masses(signals: DataFrame) -> DataFrame:
    """sample_id, layer, head, m_qp, m_qi, m_qq from objects by "layer|head"."""
    rows = signals.select("sample_id", F.explode(F.from_json("masses_json", "map<string,array<double>>")).alias("k", "v"))
    at = F.split("k", "[|]")
    return rows.select("sample_id", at[0].cast("int").alias("layer"), at[1].cast("int").alias("head"), *(F.col("v")[i].alias(c) for i, c in enumerate(("m_qp", "m_qi", "m_qq"))))


def to_json(masses: DataFrame, value: Column | None = None) -> DataFrame:
    """The stored form of long masses: one JSON object per sample. Where rows share a sample_id, a head's first masses go to
    its first object, its second to the second and so on: no object holds a head twice."""
    row = F.struct(F.concat_ws("|", "layer", "head").alias("k"), (F.array("m_qp", "m_qi", "m_qq") if value is None else value).alias("v"))
    x = masses.groupBy("sample_id").agg(F.array_sort(F.collect_list(row)).alias("x")).withColumn("k", F.transform("x", lambda e: e["k"]))
    number = lambda e, j: j - F.array_position("k", e["k"]) + 1  # noqa: E731  of a head's masses, from 0
    most = F.array_max(F.transform("x", number))
    each = F.transform(F.sequence(F.lit(0).cast("long"), most), lambda i: F.to_json(F.map_from_entries(F.filter("x", lambda e, j: number(e, j) == i))))
    once = F.size(F.array_distinct("k")) == F.size("k")
    return x.select("sample_id", F.explode(F.when(once, F.array(F.to_json(F.map_from_entries("x")))).otherwise(each)).alias("masses_json"))


def long(signals: DataFrame) -> DataFrame:
    """Each cached row's widths and masses, long: taken from the row itself, as rows may share a sample_id."""
    at = F.split("k", "[|]")
    rows = signals.select("sample_id", *(F.greatest(F.lit(1), F.col(c).cast("int")).alias(w) for c, w in zip(WIDTHS, ("w_p", "w_i", "w_q"), strict=True)), F.explode(F.from_json("masses_json", "map<string,array<double>>")).alias("k", "v"))
    return rows.select("sample_id", "w_p", "w_i", "w_q", at[0].cast("int").alias("layer"), at[1].cast("int").alias("head"), *(F.col("v")[i].alias(c) for i, c in enumerate(("m_qp", "m_qi", "m_qq"))))


def widths(signals: DataFrame) -> DataFrame:
    """Span widths of at least 1."""
    return signals.select("sample_id", *(F.greatest(F.lit(1), F.col(c).cast("int")).alias(w) for c, w in zip(WIDTHS, ("w_p", "w_i", "w_q"), strict=True)))


def read_hidden(spark: SparkSession, path: str, layers: list[int] | None = None) -> DataFrame:
    """sample_id, layer, vec from folders layer=N; only the named layers are read."""
    df = spark.read.parquet(path).select("sample_id", F.col("layer").cast("int").alias("layer"), F.col("vec").cast("array<float>").alias("vec"))
    return df.where(F.col("layer").isin(*layers)) if layers else df


def read_hidden_files(spark: SparkSession, folder: str, layers: list[int] | None = None, pattern: str = "hid_l") -> DataFrame:
    """sample_id, layer, vec from one file a layer, hid_l<layer>.parquet: the layer comes from the file's name.

    Files of other layers and other names are not opened."""
    numbers = "[0-9]*" if layers is None else "{" + ",".join(map(str, sorted(set(layers)))) + "}"
    if layers == []:
        return spark.createDataFrame([], "sample_id string, layer int, vec array<float>")
    raw = spark.read.option("pathGlobFilter", f"{pattern}{numbers}.parquet").schema("sample_id string, vec array<float>").parquet(folder)
    layer = F.regexp_extract("_metadata.file_name", rf"^{pattern}(\d+)\.parquet$", 1)
    return raw.select("sample_id", F.try_to_number(layer, F.lit("999999")).cast("int").alias("layer"), "vec").where("layer is not null")


def write_hidden_files(df: DataFrame, folder: str, prefix: str = "hid_l") -> None:
    """One file a layer, as read_hidden_files reads them: written beside the folder and moved in under their names.

    A layer is one task's file: for caches whose layers fit one. write_hidden has no such bound."""
    spark = df.sparkSession
    beside = f"{folder.rstrip('/')}-{uuid.uuid4().hex}"
    rows = df.select("sample_id", F.col("vec").cast("array<float>").alias("vec"), "layer")
    rows.repartition("layer").write.option("maxRecordsPerFile", 0).partitionBy("layer").parquet(beside)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for layer in fs.globStatus(path(f"{beside}/layer=*")):  # a few
        (part,) = fs.globStatus(path(f"{layer.getPath().toString()}/part-*"))
        name = path(f"{folder}/{prefix}{layer.getPath().getName().split('=')[1]}.parquet")
        fs.delete(name, False)
        if not fs.rename(part.getPath(), name):
            raise OSError(f"could not move {part.getPath().toString()} to {name.toString()}")
    fs.delete(path(beside), True)


def write_hidden(df: DataFrame, path: str) -> None:
    """One folder per layer, so that a reader of one layer reads no other."""
    df.repartition("layer").write.mode("append").partitionBy("layer").parquet(path)
