"""Exact top-k search by no-random-access aggregation over sorted lists.

For a query, every dimension is a list of the candidates sorted by how much that dimension adds to the inner
product. Lists are read from the top, to the same depth each. What has been read of a candidate, with the last
value read (or the list's end) for the rest, bounds its score from above (or below). Candidates that can no longer
reach the k-th best lower bound are out; reading stops when few are left or the lists nearly end, and the final scores
of those left, and of no others, are resolved. The bounds of a block of queries and a block of candidates are matrix
products.

Queries and candidates are dealt into blocks by hash of their id, so that every task holds a bounded number of
both. The first block of candidates is searched before the others: its k-th best score of a query is a bound below
which no other block need look. Each block gives its best k, and the best k of those are kept.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count
as padded with zeros; ties go to the smaller id; rows with a query's own id are no candidates of it; repeated rows
are candidates each, but a query id asks once (with the least of its vectors), so it has k rows at most; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import ship, written

#: Rows in a block of queries and of candidates, about.
QUERY_ROWS, CANDIDATE_ROWS = 1024, 8192
#: Shares of the lists read before bounds are compared, and the share of candidates left with which reading stops.
DEPTHS, FEW = (0.3, 0.6, 0.8, 0.9, 0.95), 0.02
#: Pairs of a query and a candidate left that are resolved at once.
RESOLVED = 1 << 16


def exact_type(q: np.ndarray, x: np.ndarray) -> np.dtype:
    """The fastest type in which all inner products of these integers are exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.dtype("f4" if most < 2**24 else "f8" if most < 2**53 else "i8")


def nra_topk(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS, floor: np.ndarray | None = None, left: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores) of the k best for each query; x_ids ascending, ties to the smaller id.

    floor: for each query a score below which none is wanted, or NaN. left, if given, gets (depth, share of candidates
    that can still qualify) for each depth read."""
    kind = exact_type(q, x)
    q, x = q.astype(kind), x.astype(kind)
    n = len(x)
    k1, least = min(n, k), np.iinfo("i8").min if kind.kind == "i" else -np.inf
    order = np.argsort(x, axis=0, kind="stable")
    lists = np.take_along_axis(x, order, axis=0)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None], axis=0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for s in range(0, len(q), 256):
        some = q[s : s + 256]
        up, down = np.maximum(some, 0), np.minimum(some, 0)
        own = q_ids[s : s + 256, None] == x_ids[None, :]
        alive = ~own
        for share in depths if n > 4 * k else ():
            depth = max(1, int(n * share))
            top, low = rank >= n - depth, rank < depth
            upper = up @ np.where(top, x, lists[n - depth]).T + down @ np.where(low, x, lists[depth - 1]).T
            lower = up @ np.where(top, x, lists[0]).T + down @ np.where(low, x, lists[-1]).T
            lower[own] = least
            kth = np.partition(lower, n - k1, axis=1)[:, n - k1]
            if floor is not None:
                kth = np.fmax(kth, floor[s : s + 256]).astype(kind)
            alive &= upper >= kth[:, None]
            if left is not None:
                left.append((share, float(alive.mean())))
            if alive.mean() < FEW:
                break
        r, c = np.nonzero(alive)
        v = np.concatenate([np.einsum("ij,ij->i", some[r[i : i + RESOLVED]], x[c[i : i + RESOLVED]]) for i in range(0, len(r), RESOLVED)] or [np.zeros(0, kind)])
        o = np.lexsort((c, -v, r))
        r, c, v = r[o], c[o], v[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        best = place < k
        out.append((q_ids[s + r[best]], x_ids[c[best]], v[best].astype(np.int64)))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (q_ids[:0], x_ids[:0], np.zeros(0, np.int64))


def _matrix(vectors: pd.Series, scale: float, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return np.floor(out * scale)


def top_k(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, query_every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best inner products of floor(scale x component)."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = written(rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))), "vectors")
    asked = rows.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min("v").alias("v"))
    n, nq = rows.count(), asked.count()
    parts, groups = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-nq // QUERY_ROWS))
    seq = lambda start, m: F.explode(F.sequence(F.lit(start), F.lit(m - 1)).cast("array<long>"))
    dealt = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("p"))
    queries = asked.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).alias("g"))

    def block(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        q, x = q.sort_values("id", kind="stable"), x.sort_values("id", kind="stable")
        width = max(q["v"].map(len).max(), x["v"].map(len).max())
        got = nra_topk(_matrix(q["v"], scale, width), q["id"].to_numpy(), _matrix(x["v"], scale, width), x["id"].to_numpy(), k, floor=q["floor"].to_numpy(float))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), got, strict=True)))

    def searched(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        candidates = candidates.toDF(*candidates.columns)  # names of its own: both sides come from one table
        return queries.groupBy("g", "p").cogroup(candidates.groupBy("g", "p")).applyInPandas(block, "query_id long, vec_id long, score long")

    none = F.lit(float("nan")).alias("floor")
    best = searched(queries.select("id", "v", "g", F.lit(0).cast("long").alias("p"), none), dealt.where("p = 0").select("id", "v", "p", seq(0, groups).alias("g")))
    if parts > 1:
        best = written(best, "first")
        # a query with fewer than k candidates in the first block has no bound
        floors = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
        bounded = queries.join(floors, F.col("id") == F.col("query_id"), "left").select("id", "v", "g", F.coalesce("floor", none).alias("floor"), seq(1, parts).alias("p"))
        best = best.union(searched(bounded, dealt.where("p > 0").select("id", "v", "p", seq(0, groups).alias("g"))))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
