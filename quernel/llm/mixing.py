"""Mixing sources to target weights by hash-threshold histograms, without sorting documents.

Sizes are summed by source and bucket of a hash of the key. Each source's budget falls into one bucket; only
that bucket is divided again by the next hash bits, until it holds one document. Documents whose hash lies
below the threshold are taken (once more). Thresholds of growing budgets are nested: a larger budget takes
all that a smaller one takes.

Defined cases: a null text has size 0; null sources form one source, ordered last; equal rows share a hash and
are taken together; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import written

WORD = r"[^\x20\x09-\x0D]+"
LEVEL_BITS, LEVELS = 12, 5  # 60 bits of hash


def hash60(key: str, seed: int):
    """The first 60 bits of md5 of key and seed, as a long from 0."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Add target to (source, source_size): shares of share x all sizes by weight, dealt in turn by source order,
    each at most `most` times its size; what exceeds that goes to the others by weight. sources has one row a source."""
    all_rows = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(all_rows) - 1, F.lit(len(weights))) + 1).cast("int"))).withColumn("_cap", F.col("source_size") * most)
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy()) * share
    before = F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (total - before) / F.sum("_w").over(by_fill.rowsBetween(0, Window.unboundedFollowing))
    levelled = weighed.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_w") <= F.col("_cap"))
    fill = F.max(F.when(F.col("_open"), F.struct(-F.col("_cap") / F.col("_w"), F.col("_level")))).over(Window.partitionBy())["_level"]
    return levelled.withColumn("_fill", fill).select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_w") * F.col("_fill"), F.col("_cap").cast("double"))).alias("target"))


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 0) -> DataFrame:
    """doc_id, source, size, source_size, target, times and taken (= size x times) for each row."""
    rows = written(docs.select(F.col(key).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), hash60(key, seed).alias("h")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    budget = source_targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = budget.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = written(budget.withColumn("prefix", F.lit(0).cast("long")).withColumn("before", F.lit(0).cast("long")), "budget")
    inside = rows.select("source", "size", "h")
    for level in range(1, LEVELS + 1):
        left = LEVEL_BITS * (LEVELS - level)
        own = state.select(F.col("source").alias("_source"), "prefix", "before", "rest")
        at = inside.withColumn("part", F.shiftright("h", left))
        if level > 1:
            at = at.join(own, at["source"].eqNullSafe(own["_source"])).where(F.shiftright("part", LEVEL_BITS) == F.col("prefix")).select("source", "size", "h", "part")
            if level == 2:
                at = written(at, "boundary")
            inside = at.drop("part")
        sums = at.groupBy("source", "part").agg(F.sum("size").alias("own"), F.count("*").alias("n"))
        sums = sums.join(own, sums["source"].eqNullSafe(own["_source"]))
        upto = Window.partitionBy("source").orderBy("part")
        sums = sums.withColumn("upto", F.col("before") + F.sum("own").over(upto))
        first = sums.where(F.col("upto") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("part", (F.col("upto") - F.col("own")).alias("before"), "own", "n")).alias("b"))
        first = first.select(F.col("source").alias("_source"), F.col("b.part").alias("prefix"), F.col("b.before").alias("before"), F.col("b.own").alias("own"), F.col("b.n").alias("n"))
        state = state.drop("prefix", "before", "own", "n")
        state = state.join(first, state["source"].eqNullSafe(first["_source"]), "left").drop("_source").withColumn("bits", F.lit(left))
        state = written(state, "budget")
        if not state.where("n > 1 and rest > 0").limit(1).count():
            break
    nearer = (F.col("before") + F.col("own") - F.col("rest") <= F.col("rest") - F.col("before")).cast("long")
    below = F.when(F.col("rest") <= 0, F.lit(0)).when(F.col("prefix").isNull(), F.lit(1 << 60)).otherwise((F.col("prefix") + nearer) * F.lit(1 << left)).cast("long")
    plan = state.select(F.col("source").alias("_source"), "source_size", "target", "whole", below.alias("below"))
    times = (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).alias("times")
    mixed = rows.join(plan, rows["source"].eqNullSafe(plan["_source"])).select("doc_id", "source", "size", "source_size", "target", times)
    return mixed.withColumn("taken", F.col("size") * F.col("times"))


#: The same by sorting, for DuckDB.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|0'), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w, source_size * 2 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS fill FROM l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(CAST(w * fill AS DOUBLE), cap)) AS target FROM l, f),
b AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (SELECT source, h, sum(size) AS own FROM d GROUP BY source, h),
c AS (SELECT g.source, g.h, g.own, b.target - b.whole * b.source_size AS rest, sum(g.own) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
      FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
x AS (SELECT source, h, CASE WHEN rest <= 0 THEN 0 WHEN upto < rest THEN 1 WHEN upto - own >= rest THEN 0
                             WHEN upto - rest <= rest - (upto - own) THEN 1 ELSE 0 END AS extra FROM c)
SELECT d.doc_id, d.size, b.source_size, b.target, CAST(d.size * (b.whole + x.extra) AS BIGINT) AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""
