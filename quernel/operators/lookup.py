"""Rows by key in the order they are asked for, and intervals that overlap, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(spark, keys: list, key: str, kind: str = "string") -> DataFrame:
    """A requested list as rows: ord (from 0) and the key; the same key may be asked for again."""
    return spark.createDataFrame(list(enumerate(keys)), f"ord long, {key} {kind}")


def in_order(wanted: DataFrame, table: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """The table's rows for each wanted row (key, ord and whatever else it carries).

    strict: a key that the table lacks fails the job that needs the rows, within the plan; else it gives a row of nulls
    and found is false. Sort by ord to have the order on the driver; a key with several rows gives as many."""
    own = [c for c in table.columns if c != key]
    clash = sorted(set(own) & set(wanted.columns))
    if clash:
        raise ValueError(f"both sides have {', '.join(clash)}")
    joined = wanted.join(table.withColumn("_there", F.lit(True)), key, "left")
    found = F.coalesce("_there", F.lit(False))
    if not strict:
        return joined.select(*wanted.columns, *own, found.alias("found"))
    missing = F.raise_error(F.concat(F.lit("no row for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    # the key itself carries the assertion, so no reader of the rows can skip it
    checked = F.when(found, F.col(key)).otherwise(missing.cast(wanted.schema[key].dataType))
    return joined.withColumn(key, checked).select(*wanted.columns, *own)


def overlapping(tokens: DataFrame, spans: DataFrame, key: str, width: int = 64) -> DataFrame:
    """(key, span, s, e): the first and last + 1 of the tokens that each span overlaps; spans without tokens are left out.

    tokens: key, pos, start, end; spans: key, span, start, end; a row each, however many a key has. Both are cut into
    bins of `width` characters and joined by key and bin, so a row meets those near it only, and a long key is spread
    over its bins."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(a), F.col(b) - 1) / width)))
    t = tokens.select(key, "pos", F.col("start").alias("_ts"), F.col("end").alias("_te"), bins("start", "end").alias("_bin"))
    s = spans.where(F.col("end") > F.col("start")).select(key, "span", F.col("start").alias("_ss"), F.col("end").alias("_se"), bins("start", "end").alias("_bin"))
    hit = t.join(s, [key, "_bin"]).where((F.col("_te") > F.col("_ss")) & (F.col("_ts") < F.col("_se")))
    return hit.groupBy(key, "span").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
