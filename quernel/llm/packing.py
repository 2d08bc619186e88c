"""Sequence packing: shortest-pack-first over the length histogram.

Texts become token pieces of at most `capacity` ids; the histogram of piece lengths (at most `capacity`
entries, whatever the corpus size) is packed on the driver into patterns, and the patterns are joined back
to the pieces by each piece's rank among those of its length. Only the histogram reaches the driver.

Defined cases: a null text counts as empty (its document holds just the end id); equal rows are packed
separately; rows are ranked by (key, start), so reruns give the same sequences; an empty table gives an
empty result; other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.session import ship, written

#: Rows of one (length, bucket) cell that one window partition ranks, about.
RANK_ROWS = 20_000
_encoders: dict[str, object] = {}


def _fast(path: str):
    if path not in _encoders:
        import base64
        import json

        import tiktoken

        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def _encode(path: str, text: str) -> list[int]:
    """Ids as the tokenizers library gives them. tiktoken runs the same ranks about six times as fast; what it
    refuses (its regex engine can overflow on extreme white space) goes to tokenizers itself."""
    try:
        return _fast(path).encode(text, allowed_special="all")
    except BaseException as e:  # a Rust panic is no Exception
        if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
            raise
        from tokenizers import Tokenizer

        if f"slow {path}" not in _encoders:
            _encoders[f"slow {path}"] = Tokenizer.from_file(path)
        return _encoders[f"slow {path}"].encode(text, add_special_tokens=False).ids


def tokenize_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: key, start, length, doc_tokens and ids (binary, little-endian unsigned 32-bit).

    A document's ids, with end_id last, are cut into full pieces of `capacity` and one remainder."""
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
        for b in batches:
            row, start, length, total, ids = [], [], [], [], []
            held = 0
            for i, t in enumerate(b.column(1)):
                a = np.array([*_encode(path, t.as_py() or ""), end_id], "<u4")
                for s in range(0, len(a), capacity):
                    piece = a[s : s + capacity]
                    row.append(i)
                    start.append(s)
                    length.append(len(piece))
                    total.append(len(a))
                    ids.append(piece.tobytes())
                held += a.nbytes
                if held > 16 << 20 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)
                    row, start, length, total, ids = [], [], [], [], []
                    held = 0
            _encoders.pop(f"slow {path}", None)  # it is large and seldom needed

    return src.mapInArrow(run, schema)


def spf_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Shortest-pack-first: (number of packs, [(length, copies in each pack), ...]) with all of counts placed.

    Lengths go longest first into the open pack that is shortest so far, many packs of one pattern at a time."""
    heap: list[tuple[int, int, int, list[tuple[int, int]]]] = []  # (-free, tie, packs, runs)
    done: list[tuple[int, list[tuple[int, int]]]] = []
    tie = 0

    def put(free: int, packs: int, runs: list[tuple[int, int]]) -> None:
        nonlocal tie
        if not packs:
            return
        if free:
            tie += 1
            heapq.heappush(heap, (-free, tie, packs, runs))
        else:
            done.append((packs, runs))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        n = counts[length]
        while n:
            if heap and -heap[0][0] >= length:
                neg, _, packs, runs = heapq.heappop(heap)
                free, second = -neg, -heap[0][0] if heap else 0
                each = max(1, min(free // length, (free - second) // length))  # until another pattern is the shortest
                if packs > n:
                    put(free, packs - n, runs)
                    put(free - length, n, [*runs, (length, 1)])
                    n = 0
                else:
                    each = min(each, n // packs)
                    put(free - each * length, packs, [*runs, (length, each)])
                    n -= each * packs
            else:
                each = capacity // length
                full, rest = divmod(n, each)
                put(capacity - each * length, full, [(length, each)])
                put(capacity - rest * length, bool(rest) * 1, [(length, rest)])
                n = 0
    return done + [(packs, runs) for _, _, packs, runs in sorted(heap)]


def _slots(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, copies in each pack, offset), sorted: who of a length goes where."""
    rows, base, used = [], 0, {}
    for packs, runs in patterns:
        at = 0
        for length, each in runs:
            r = used.get(length, 0)
            rows.append((length, r, base, each, at))
            used[length] = r + packs * each
            at += length * each
        base += packs
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "start")) -> DataFrame:
    """Add sequence_id and offset to pieces with a length column in 1..capacity; all other columns stay.

    `pieces` is read twice, so it should be a written table. Pieces of one length are ranked in buckets by a hash of
    `order`, which grow in number with the table, so that no length, however common, falls to one task; a column of
    `order` that tells equal rows apart, as pack_documents has it, does the same for repeated rows."""
    spark = pieces.sparkSession
    ship(spark)
    n = pieces.count()
    buckets = max(64, 1 << max(0, (n // RANK_ROWS)).bit_length())
    p = pieces.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    cells = written(p.groupBy("length", "_b").agg(F.count("*").alias("_n")), "lengths")
    hist = {r[0]: r[1] for r in cells.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    slots = _slots(spf_patterns(hist, capacity))
    keys = (slots[:, 0] << 44) | slots[:, 1]
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_b").orderBy(*order)
    ranked = p.join(cells.hint("shuffle_hash"), ["length", "_b"]).withColumn("_rank", F.col("_before") + F.row_number().over(within) - 1)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        s = slots[np.searchsorted(keys, (at << 44) | r, side="right") - 1] if len(at) else slots[:0]
        i = r - s[:, 1]
        return pd.DataFrame({"sequence_id": s[:, 2] + i // np.maximum(s[:, 3], 1), "offset": s[:, 4] + i % np.maximum(s[:, 3], 1) * at})

    return ranked.withColumn("_at", place("length", "_rank")).select(*pieces.columns, "_at.sequence_id", "_at.offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", *, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack: pieces with ids (or only their crc32) and their sequence_id and offset."""
    pieces = tokenize_pieces(docs, key, text, tokenizer=tokenizer, capacity=capacity, end_id=end_id).withColumn("ids_crc32", F.crc32("ids"))
    pieces = (pieces if keep_ids else pieces.drop("ids")).withColumn("_row", F.monotonically_increasing_id())
    return pack(written(pieces, "pieces"), capacity, ("doc_id", "start", "ids_crc32", "_row")).drop("_row")
