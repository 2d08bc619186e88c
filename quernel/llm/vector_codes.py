"""Vectors as short codes: product quantization by integer k-means, the same to the last bit wherever it runs.

Vectors become whole numbers, floor(scale x component), and are laid in blocks: a block is one Parquet row that holds
up to BLOCK vectors of a task, column by column (all first components, then all second ones), beside their ids and
labels. A round broadcasts the codebooks (parts x entries x width numbers, whatever the table's size). Within a task
distances accumulate dimension by dimension, np.add.at sums the components and counts of each entry in int64, and
treeAggregate merges these tensors; the driver gets one of them. A last pass writes each vector's code and error.

Defined cases: vectors that are null or hold null or non-finite components (also after scaling) take no part; shorter
ones count as padded with zeros to the longest, and that to a multiple of the parts; with fewer vectors than entries,
codebooks have as many entries as there are vectors; repeated rows are vectors each; the first vectors go by id (null
last), then by components; ties in distance go to the lower entry; an empty table gives an empty result; a null label
is a label; other columns are ignored, whatever their names. Numbers of 2**26 and more are computed without a bound on
their size; an error beyond a long is then null, and so is a sum that holds one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import ship, written

#: Vectors in a block at most; labels up to which their sums are broadcast; ways in which a label's rows are dealt beyond.
BLOCK, FEW_LABELS, SALTS = 4096, 10_000, 64
#: Below this, squares and their sums are exact in int64.
SMALL = 1 << 26


def split_parts(x: np.ndarray, parts: int) -> np.ndarray:
    """(components, vectors) as (parts, width, vectors)."""
    return x.reshape(parts, -1, x.shape[1])


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part and vector the nearest entry, the lower on ties, and the squared distance to it.

    x: (parts, width, vectors); books: (parts, entries, width)."""
    parts, width, n = x.shape
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), x.dtype)
    for p in range(parts):
        far = np.zeros((books.shape[1], n), x.dtype)
        for d in range(width):
            step = x[p, d][None, :] - books[p, :, d][:, None]
            far += step * step
        codes[p] = far.argmin(axis=0)
        errors[p] = np.take_along_axis(far, codes[p][None, :], axis=0)[0]
    return codes, errors


def gathered(x: np.ndarray, codes: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, counts) of the vectors of each entry: (parts, entries, width) and (parts, entries)."""
    parts, width, _ = x.shape
    sums, counts = np.zeros((parts, width, entries), x.dtype), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        np.add.at(counts[p], codes[p], 1)
        for d in range(width):
            np.add.at(sums[p, d], codes[p], x[p, d])
    return sums.transpose(0, 2, 1), counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each entry at the floor of its vectors' mean; unused ones stay."""
    used = counts > 0
    out = books.copy()
    out[used] = sums[used] // counts[used][:, None].astype(sums.dtype)
    return out


def digest(books: np.ndarray) -> str:
    """SHA-256 of all numbers by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def _numbers(data: bytes, components: int, exact: bool) -> np.ndarray:
    """A block's (components, vectors)."""
    if exact:
        return np.frombuffer(data, np.int32).reshape(components, -1).astype(np.int64)
    x = np.frombuffer(data, np.float64).reshape(components, -1)
    return np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def _blocks(rows: DataFrame, components: int, scale: float, exact: bool) -> DataFrame:
    """rows (id, label, v) laid in blocks: ids, labels, data."""
    kind = rows.schema["label"].dataType.simpleString()

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                v = some.column("v")
                lengths = np.asarray(v.value_lengths())
                x = np.zeros((some.num_rows, components))
                x[np.arange(components)[None, :] < lengths[:, None]] = np.asarray(v.flatten())
                data = np.ascontiguousarray(np.floor(x * scale).T.astype(np.int32 if exact else np.float64)).tobytes()
                one = np.array([0, some.num_rows], np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, some.column("id")), pa.ListArray.from_arrays(one, some.column("label")), pa.array([data], pa.binary())], names=["ids", "labels", "data"])

    return rows.mapInArrow(lay, f"ids array<bigint>, labels array<{kind}>, data binary")


def _with_label_sums(rows: DataFrame) -> DataFrame:
    """Add label_error, the sum of error over equal labels.

    Sums are broadcast if there are few labels; else each label's rows are dealt in SALTS ways and its sum goes to each."""
    sums = written(rows.groupBy("label").agg(F.expr("case when count(error) = count(*) then try_cast(sum(cast(error as decimal(38,0))) as bigint) end").alias("label_error")), "label-sums")
    sums = sums.toDF("same", "label_error")
    if sums.count() <= FEW_LABELS:
        return rows.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("same")), "left").drop("same")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    each = sums.withColumn("its", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(each, (F.col("salt") == F.col("its")) & F.col("label").eqNullSafe(F.col("same")), "left").drop("same", "its", "salt")


def quantize(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, parts: int = 8, entries: int = 16, rounds: int = 6, scale: float = 4096.0) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks): vec_id, label, code (two hex digits a part), error and label_error of every vector that takes
    part; and the numbers of each part's entries, (parts, entries, width)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hexadecimal digits a part: 1 to 256 entries")
    spark = vectors.sparkSession
    ship(spark)
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < F.lit(float("inf")))))
    largest = F.max(F.aggregate("v", F.lit(0.0), lambda a, c: F.greatest(a, F.abs(c * scale))))
    longest, most, n = rows.agg(F.max(F.size("v")), largest, F.count("*")).first()
    components, exact = -(-(longest or 0) // parts) * parts, (most or 0.0) < SMALL - 1
    schema = f"vec_id bigint, label {rows.schema['label'].dataType.simpleString()}, code string, error bigint, label_error bigint"
    if not n:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    start = np.zeros((len(first), components))
    for i, r in enumerate(first):
        start[i, : len(r["v"])] = r["v"]
    start = np.floor(start * scale)
    start = start.astype(np.int64) if exact else np.array([[int(c) for c in r] for r in start], object).reshape(start.shape)
    books = np.ascontiguousarray(start.reshape(len(first), parts, -1).transpose(1, 0, 2))
    blocks = written(_blocks(rows, components, scale, exact), "vector-blocks")

    def learn(total, block):
        x = split_parts(_numbers(block[0], components, exact), parts)
        now = shared.value
        s, c = gathered(x, assign(x, now)[0], now.shape[1])
        return (s, c) if total is None else (total[0] + s, total[1] + c)

    def merge(a, b):
        return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

    columns = blocks.select("data").rdd
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)
        books = moved(books, *columns.treeAggregate(None, learn, merge, depth=2))
        shared.unpersist()
    final = spark.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                codes, errors = assign(split_parts(_numbers(b.column("data")[i].as_py(), components, exact), parts), final.value)
                total = [e if e < 1 << 63 else None for e in errors.sum(axis=0).tolist()]
                text = np.ascontiguousarray(codes.T.astype(np.uint8))
                names = [t.tobytes().hex() for t in text]
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(names, pa.string()), pa.array(total, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = written(blocks.mapInArrow(encode, schema.rsplit(",", 1)[0]), "vector-codes")
    return _with_label_sums(coded), books


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector, by 8 codebooks of 16 entries."""
    rows, books = quantize(vectors)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in SQL, for tables whose vectors are equally long."""
    nearest = lambda b: f"""SELECT vec_id, part, first(entry ORDER BY far, entry) AS entry, min(far) AS far FROM (
  SELECT x.vec_id, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) AS far FROM x JOIN {b} b USING (part, pos) GROUP BY x.vec_id, x.part, b.entry) GROUP BY vec_id, part"""  # noqa: E731
    out = f"""WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor({scale} * CAST(c AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
x AS MATERIALIZED (SELECT vec_id, i // (len(e) // {parts}) AS part, i % (len(e) // {parts}) AS pos, e[i + 1] AS x FROM k, LATERAL (SELECT unnest(range(len(e))) AS i)),
b0 AS MATERIALIZED (SELECT part, pos, entry, x FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {entries}) USING (vec_id))"""
    for i in range(rounds):
        out += f""",
a{i} AS MATERIALIZED ({nearest(f"b{i}")}),
b{i + 1} AS MATERIALIZED (SELECT b.part, b.pos, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
  SELECT part, pos, entry, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM x JOIN a{i} USING (vec_id, part) GROUP BY part, pos, entry) m USING (part, pos, entry))"""
    return out + f""",
f AS MATERIALIZED ({nearest(f"b{rounds}")}),
c AS (SELECT vec_id, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM f GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (vec_id)"""


ORACLE = oracle()
