"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, full shingle sets decide.

Documents with equal sets of word shingles form a class, and only classes are compared. A class's MinHash values
are hashed in bands into buckets, and folded into an odd sketch: a bitmap in which each value toggles one bit, so
that the bits in which two sketches differ tell how many values differ. In a bucket each class is compared with
the bucket's smallest class first; what then still lies in different components of one bucket is compared with
each other (in blocks, if the bucket is large), unless the sketches or the sets' sizes rule a link out. Every link is confirmed on full sets.

With 32 bands of 4, a pair at similarity 0.75 shares no bucket in 5 of a million cases, more similar pairs less
often. The estimate passes pairs some six deviations below the threshold, so it drops next to none; the bound on
sizes is exact.

Defined cases: a text with fewer words than a shingle has is one shingle; null, empty and wordless texts have none
and link with nothing; equal rows are one class; several texts under one id are compared each for itself; rows
with a null id link only with equal sets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm import words as W
from quernel.llm.components import components
from quernel.session import ship, written

U = np.uint64
BANDS, ROWS, SKETCH_BITS = 32, 4, 1024
#: Buckets up to this size are compared pair by pair; larger ones in blocks of so many bytes of sets.
SMALL, BYTES_REST, BYTES_ALL = 32, 1 << 20, 4 << 20
#: Samples in a sketch: the bands' values and as many again.
SAMPLES = 256


def text_sets(column: pa.Array, shingle: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, hashes): the distinct shingles of each text, ascending, slice by slice."""
    for i, j, buffer, offsets in W.slices(column):
        first, h = W.shingle_hashes(W.words_of(buffer, offsets, lower=True), shingle)
        text = np.repeat(np.arange(j - i), np.diff(first))
        order = np.lexsort((h, text))
        h, text = h[order], text[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
        yield np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=j - i))]).astype(np.int64), h[new]


def fingerprints(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Two sums of hashes for each set: equal sets have equal ones."""
    out = np.zeros((len(first) - 1, 2), U)
    for k, x in enumerate((W.mix(h), W.mix(h ^ U(0x5851F42D4C957F2D)))):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(x, dtype=U)])
        out[:, k] = sums[first[1:]] - sums[first[:-1]]
    return out


def _parameters(seed: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return (r.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32) | np.uint32(1), r.integers(0, 1 << 32, SAMPLES, np.uint64).astype(np.uint32))


def minhash(first: np.ndarray, h: np.ndarray, seed: int = 1) -> np.ndarray:
    """uint32, (sets, SAMPLES); no set may be empty."""
    a, b = _parameters(seed)
    low, high = (h & U(0xFFFFFFFF)).astype(np.uint32), (h >> U(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, SAMPLES), np.uint32)
    for j in range(SAMPLES):
        out[:, j] = np.minimum.reduceat((low ^ b[j]) * a[j] + high, first[:-1])
    return out


def signature(column: pa.Array, shingle: int) -> pa.RecordBatch:
    """n_shingles, f1, f2, bands and sketch of each text."""
    n_all, f_all, bands_all, sketch_all = [], [], [], []
    for first, h in text_sets(column, shingle):
        n = np.diff(first)
        full = np.flatnonzero(n)
        bands, sketch = np.zeros((len(n), BANDS), U), np.zeros((len(n), SKETCH_BITS // 64), U)
        if len(full):
            m = minhash(np.append(first[:-1][full], first[-1]), h)
            key = np.arange(BANDS, dtype=U) * W.BASE + np.zeros((len(full), 1), U)
            for r in range(ROWS):
                key = W.mix(key + m[:, r : BANDS * ROWS : ROWS].astype(U))
            bands[full] = key
            bit = (W.mix(m.astype(U) + (np.arange(SAMPLES, dtype=U) << U(32))) % U(SKETCH_BITS)).astype(np.int64)
            odd = np.bincount((np.arange(len(full))[:, None] * SKETCH_BITS + bit).ravel(), minlength=len(full) * SKETCH_BITS).reshape(-1, SKETCH_BITS) & 1
            sketch[full] = np.packbits(odd.astype(np.uint8), axis=1).view(">u8").astype(U)
        n_all.append(n)
        f_all.append(fingerprints(first, h))
        bands_all.append(bands)
        sketch_all.append(sketch)
    n, f = np.concatenate(n_all or [np.zeros(0, np.int64)]), np.concatenate(f_all or [np.zeros((0, 2), U)])
    lists = lambda x, width: pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(x or [np.zeros((0, width), U)]).ravel().view(np.int64)), width).cast(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(n), pa.array(f[:, 0].copy().view(np.int64)), pa.array(f[:, 1].copy().view(np.int64)), lists(bands_all, BANDS), lists(sketch_all, SKETCH_BITS // 64)], names=["n_shingles", "f1", "f2", "bands", "sketch"])


def differing(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))


def most_differing(threshold: float, deviations: float = 6.0) -> int:
    """Differing bits beyond which two sketches cannot well come from sets at the threshold.

    At similarity s, 2 k (1 - s) toggles fall on n bits, of which n (1 - exp(-2 x toggles / n)) / 2 end up odd."""
    spread = (threshold * (1 - threshold) / SAMPLES) ** 0.5
    toggles = 2 * SAMPLES * (1 - max(0.0, threshold - deviations * spread))
    return int(SKETCH_BITS * (1 - np.exp(-2 * toggles / SKETCH_BITS)) / 2 + deviations * (SKETCH_BITS / 4 * np.exp(-2 * toggles / SKETCH_BITS)) ** 0.5)


def pressed(texts: DataFrame) -> DataFrame:
    """id, f1 (a hash of the text), raw (compressed) and size of each id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            raw = [x.as_buffer() for x in b.column(2).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([codec.compress(x, asbytes=True) for x in raw], pa.binary()), pa.array([x.size for x in raw], pa.int64())], names=["id", "f1", "raw", "size"])

    return texts.select("id", F.xxhash64("text").alias("f1"), "text").where("text is not null").mapInArrow(run, "id long, f1 long, raw binary, size long")


def unpressed(raw: pa.Array, sizes: np.ndarray) -> pa.Array:
    codec = pa.Codec("zstd")
    data = b"".join(codec.decompress(x.as_buffer(), int(n), asbytes=True) for x, n in zip(raw, sizes, strict=True))
    return pa.LargeStringArray.from_buffers(len(raw), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)), pa.py_buffer(data))


def by_bytes(sizes: np.ndarray, most: int = W.SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of `most` bytes together, or of one row."""
    total, s = np.cumsum(sizes), 0
    while s < len(total):
        to = max(s + 1, int(np.searchsorted(total, (total[s - 1] if s else 0) + most, side="right")))
        yield s, to
        s = to


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: see pressed()."""
    joined = pairs
    for side in ("a", "b"):
        joined = joined.join(texts.select(F.col("id").alias(side), F.col("raw").alias(f"raw_{side}"), F.col("size").alias(f"size_{side}")), side)
    joined = joined.select("a", "b", "raw_a", "raw_b", "size_a", "size_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, to in by_bytes(batch.column(4).to_numpy() + batch.column(5).to_numpy()):
                some = batch.slice(s, to - s)
                # equal texts of a slice (a bucket's first class above all) are hashed once
                both = pa.concat_arrays([some.column(2), some.column(3)]).dictionary_encode()
                code = both.indices.to_numpy()
                size = np.zeros(len(both.dictionary), np.int64)
                size[code] = np.concatenate([some.column(4).to_numpy(), some.column(5).to_numpy()])
                sets = [h[x:y] for first, h in text_sets(unpressed(both.dictionary, size), shingle) for x, y in zip(first, first[1:], strict=False)]
                keep = []
                for i in range(some.num_rows):
                    a, b = sets[code[i]], sets[code[some.num_rows + i]]
                    same = len(np.intersect1d(a, b, assume_unique=True))
                    keep.append(100 * same >= percent * (len(a) + len(b) - same))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", *, shingle: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType.fromDDL("doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, sketch array<long>")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = signature(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), *got.columns], names=schema.names)

    signed = written(src.mapInArrow(sign, schema), "signatures")
    # a class is named by the smallest id that holds its set; f1 tells apart the texts under one id
    classes = signed.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = written(classes, "classes")
    bands = classes.where("id is not null").select("id", F.explode("bands").alias("bucket"))
    # sides with a row a key are written before they are joined, so that the other side's hot keys can be split
    shared = written(bands.groupBy("bucket").agg(F.min("id").alias("hub"), F.max("id").alias("other")).where("hub <> other").drop("other"), "shared")
    members = written(bands.join(shared, "bucket"), "buckets")
    sketches = classes.select("id", "n_shingles", "sketch")
    stars = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    limit = most_differing(percent / 100)
    stars = stars.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id")).where(differing("x", "y") <= limit).select("a", "b")
    stars = written(stars, "stars")
    held = members.select("id").distinct()
    texts = written(pressed(src.withColumnRenamed("doc_id", "id")).join(held, "id", "left_semi").dropDuplicates(["id", "f1"]), "texts")
    links = written(_confirm(stars, texts, shingle, percent), "links")
    found = components(links)
    more = _residual(members, found, sketches, texts, stars, limit, shingle, percent)
    if more is not None:
        found = components(links.union(more))
    named = classes.select("f1", "f2", "n_shingles", "id").join(found, F.col("id") == F.col("node"), "left").select("f1", "f2", "n_shingles", F.coalesce("component", "id").alias("component"))
    rows = signed.select("doc_id", "n_shingles", "f1", "f2")
    out = rows.where("n_shingles > 0").join(written(named, "named"), ["f1", "f2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", "doc_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _residual(members: DataFrame, found: DataFrame, sketches: DataFrame, texts: DataFrame, tested: DataFrame, limit: int, shingle: int, percent: int) -> DataFrame | None:
    """Links between classes of one bucket that the comparisons with its smallest class left in different components."""
    labelled = members.join(found, F.col("id") == F.col("node"), "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
    parted = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi and m > 2").select("bucket")
    open_ = written(labelled.join(written(parted, "parted"), "bucket", "left_semi"), "open")
    if not open_.limit(1).count():
        return None
    ids = open_.select("id").distinct()

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column(2).to_numpy()
            for s, to in by_bytes(sizes):
                at = s
                for first, h in text_sets(unpressed(b.column(1).slice(s, to - s), sizes[s:to]), shingle):
                    n = np.diff(first)
                    rows = np.repeat(np.arange(at, at + len(n)), n)
                    at += len(n)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(h.view(np.int64))], names=["id", "h"])

    tokens = written(texts.join(ids, "id", "left_semi").select("id", "raw", "size").mapInArrow(explode, "id long, h long").distinct(), "tokens")
    # only shingles that another open class has can be common: with c of them, a set of n links with no set larger than bounds allow
    shared = written(tokens.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h"), "shared")
    sets = written(tokens.join(shared, "h", "left_semi").groupBy("id").agg(F.collect_list("h").alias("h"), F.count("*").alias("c")), "sets")
    c = sets.select("id", "c")
    about = sketches.join(c, "id").withColumnRenamed("id", "_id")
    sizes = open_.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.sum("k").alias("m"), F.max("k").alias("most"), F.max_by("component", F.struct("k", "component")).alias("main"))
    rows = written(open_.join(written(sizes, "sizes"), "bucket").join(about, F.col("id") == F.col("_id")).drop("_id"), "open")
    # buckets of a bounded size: pair by pair, confirmed as before
    x, y = rows.where(F.col("m") <= SMALL).alias("x"), rows.where(F.col("m") <= SMALL).alias("y")
    total = F.col("x.n_shingles") + F.col("y.n_shingles")
    # 100 i >= p (total - i), i at most the smaller c
    fits = (100 + percent) * F.least("x.c", "y.c") >= percent * total
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.component") < F.col("y.component")) & fits & (differing("x", "y") <= limit))
    pairs = pairs.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    links = _confirm(written(pairs, "residual"), texts, shingle, percent)
    return written(links.union(_large_buckets(rows.where(F.col("m") > SMALL), sets, limit, percent)), "links")


def _large_buckets(rows: DataFrame, sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links of large buckets: what lies outside the bucket's largest component against all of it, block by block.

    Blocks hold a bounded number of bytes of sets, or one class. In a block the sketches are compared at once, the sets
    of what they pass one by one, and a class gives one link to each component that it links with: no pairs leave
    the block but those. sets: id, h (the shingles that other classes have) and c, their number."""
    keys = ["bucket", "i", "j"]
    size = F.col("c") * 8 + SKETCH_BITS // 8
    sums = rows.groupBy("bucket").agg(F.sum(F.when(F.col("component") != F.col("main"), size)).alias("rest"), F.sum(size).alias("every"))
    pieces = sums.select("bucket", F.ceil(F.col("rest") / BYTES_REST).alias("ni"), F.ceil(F.col("every") / BYTES_ALL).alias("nj"))
    full = written(rows.join(written(pieces, "pieces"), "bucket").join(sets.select("id", "h"), "id"), "large")
    piece = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n)
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    columns = ["bucket", "id", "component", "n_shingles", "sketch", "h"]
    rest = full.where("component <> main").select(*columns, piece(F.col("ni"), 1).alias("i"), spread(F.col("nj")).alias("j"))
    every = full.select(*columns, spread(F.col("ni")).alias("i"), piece(F.col("nj"), 2).alias("j"))

    def read(t: pa.Table) -> tuple[np.ndarray, ...]:
        sketch, h = (t.column(c).combine_chunks() for c in ("sketch", "h"))
        flat = h.flatten().to_numpy()
        cuts = np.cumsum(pa.compute.list_value_length(h).to_numpy())[:-1]
        return *(t.column(c).to_numpy() for c in ("id", "component", "n_shingles")), sketch.flatten().to_numpy().view(U).reshape(t.num_rows, -1), [np.sort(x) for x in np.split(flat, cuts)]

    def block(x: pa.Table, y: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        if x.num_rows and y.num_rows:
            ids, comps, sizes, sketches, hs = read(y)
            shared = np.array([len(h) for h in hs])
            for a, comp, n, sketch, h in zip(*read(x), strict=True):
                far = np.bitwise_count(sketch ^ sketches).sum(axis=1)
                # as many shingles are common at most as the smaller has that others have
                most = np.minimum(shared, len(h))
                near = np.flatnonzero((far <= limit) & (comps != comp) & (100 * most >= percent * (n + sizes - most)))
                linked = set()
                for k in near[np.argsort(far[near], kind="stable")]:
                    if comps[k] in linked:
                        continue
                    both = len(np.intersect1d(h, hs[k], assume_unique=True))
                    if 100 * both >= percent * (n + sizes[k] - both):
                        linked.add(comps[k])
                        out.append((min(a, ids[k]), max(a, ids[k])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())})

    every = every.toDF(*every.columns)  # names of its own: both sides come from one table
    return rest.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(block, "a long, b long").distinct()


#: The same from all pairs that share a shingle, for DuckDB.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT w.doc_id, count(s.s) AS n FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id, n.doc_id = c.component_id AS kept FROM n JOIN c ON n.doc_id = c.a
"""
