"""Positions within groups in two levels: cells are counted, whole cells are summed, a window runs within one cell.

A group, however large, is so spread over its cells; no window holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import written


def _placed(df: DataFrame, groups: list[str], order: list[Column | str], position: str, size: str | None) -> DataFrame:
    """df has _cell, which rises with order within a group."""
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = df.groupBy(*groups, "_cell").agg(F.count("*").alias("_n"))
    # a fixed number of cells a group
    cells = cells.select(*(F.col(g).alias(f"_{i}") for i, g in enumerate(groups)), F.col("_cell").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"), F.sum("_n").over(Window.partitionBy(*groups)).alias("_all"))
    same = F.col("_cell") == F.col("_c")
    for i, g in enumerate(groups):
        same &= F.col(g).eqNullSafe(F.col(f"_{i}"))
    within = F.row_number().over(Window.partitionBy(*groups, "_cell").orderBy(*order))
    out = df.join(cells, same)
    return out.select(*(c for c in df.columns if c != "_cell"), (F.col("_s") + within).alias(position), *([F.col("_all").alias(size)] if size else []))


def by_hash(df: DataFrame, groups: list[str], hashed: Column, key: str, position: str, size: str | None = None) -> DataFrame:
    """Add each row's position from 1 in the order of a hexadecimal hash, then key; and its group's size. 4096 cells a group."""
    return _placed(df.withColumns({"_h": hashed, "_cell": F.substring(hashed, 1, 3)}), groups, ["_h", key], position, size).drop("_h")


def by_range(df: DataFrame, order: list[str], position: str) -> DataFrame:
    """Add each row's position from 1 in the order of the columns over the whole table, which is dealt out by range and written."""
    dealt = written(df.repartitionByRange(*order).withColumn("_cell", F.spark_partition_id()), "ranges")
    return _placed(dealt, [], order, position, None)
