"""Scores of documents by a gated recurrent language model that is trained on the corpus, beside a unigram base.

Counts cover every document: tasks count the words of their part, Spark sums them. Words said most often (DICTIONARY of
them at most, of all documents) go to the tasks by broadcast; a scoring task lists the others, which no word's share can
make hot, by document, and a join with the counts completes the sums.

The model's tokens are the words said most often in training, the end, and KINDS of other words by their last two bytes,
so a word outside is its kind by the model, times its share of the kind, (c + 1) / (N + V + 1) of the kind as in the base.
Training goes over all training documents, whole and once, in ROUNDS parts dealt by hash: each round every task takes its
own documents of one part through truncated backpropagation, from the same parameters, and a reduction tree averages
what they came to by the tokens they saw. Parameters have one size, whatever the corpus.

Defined cases: null texts are empty; texts without words have their end alone; null ids are trained on (as an empty
text's crc32); repeated rows are rows each; very long texts carry their state on, over as many windows as they need;
with no training documents every token's base is 1 / 1; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.llm import gru, words
from quernel.session import ship, written

HIDDEN, TOKENS, KINDS, CLASSES = 24, 2048, 128, 40
#: Words whose counts are broadcast at most; words a task counts before it hands on; tokens scored and trained on together.
DICTIONARY, COUNTED, GROUP, LEARNED = 1 << 18, 1 << 20, 1 << 21, 1 << 19
#: Parts that the training documents are dealt into, one a round; and the first round's step, which falls from round to round.
ROUNDS, RATE, FALL = 4, 0.1, 0.7
END = np.int64(0)
STEPS = 16  # buckets of counts a doubling
BITS = 18  # of hashes, by which the dictionary is looked up


def held_out(key: Column) -> Column:
    """Whether a document is not learned from."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def kinds_of(w: words.Words, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each word's kind, a hash of its last two bytes in lower case."""
    base = np.repeat(offsets[:-1], np.diff(w.first))
    last = buffer[base + w.end - 1].astype(np.int64)
    before = np.where(w.end - w.start > 1, buffer[base + np.maximum(w.end - 2, 0)], 0).astype(np.int64)
    last, before = (np.where((b >= 65) & (b <= 90), b + 32, b) for b in (last, before))
    return (((last * 257 + before) * 2654435761) % (1 << 32) >> 12) % KINDS


def _summed(hashes: np.ndarray, kinds: np.ndarray, train: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, ...]:
    """One entry a word: hash, kind, and the sums of both counts."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    add = lambda c: np.add.reduceat(c[order], first) if len(first) else c[:0]
    return h[first], kinds[order][first], add(train), add(every)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of (text, train): hash, kind, c (in training documents) and every (in all)."""
    none = (np.zeros(0, np.int64),) * 4
    have, waiting, size = none, [], 0
    out = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1].astype(np.int32)), pa.array(x[2]), pa.array(x[3])], names=["hash", "kind", "c", "every"])

    def merge() -> tuple[np.ndarray, ...]:
        return _summed(*(np.concatenate(c) for c in zip(have, *waiting, strict=True)))

    for b in batches:
        train = np.asarray(b.column("train").to_numpy(zero_copy_only=False), np.int64)
        waiting.append((np.array([END]), np.zeros(1, np.int64), np.array([train.sum()]), np.array([len(train)])))
        for i, j, buffer, offsets in words.slices(b.column("text")):
            w = words.words_of(buffer, offsets, lower=True)
            own = np.repeat(train[i:j], np.diff(w.first))
            waiting.append(_summed(w.hash.view(np.int64), kinds_of(w, buffer, offsets), own, np.ones_like(own)))
            size += len(waiting[-1][0])
        if size > COUNTED:
            have, waiting, size = merge(), [], 0
            if len(have[0]) > COUNTED:
                yield out(have)
                have = none
    have = merge() if waiting else have
    if len(have[0]):
        yield out(have)


class Counts(NamedTuple):
    """What the corpus gives: N, V, the dictionary (hashes in order, count, token), each kind's token and denominator, the
    tokens' mass and the end's token, and where in the dictionary the hashes of each beginning start."""

    n: int
    v: int
    hash: np.ndarray
    c: np.ndarray
    token: np.ndarray
    kind_token: np.ndarray
    of_kind: np.ndarray
    mass: np.ndarray
    end: int
    start: np.ndarray


def count_words(docs: DataFrame) -> DataFrame:
    """hash, kind, c and every of each distinct word of (text, train), the end included; written."""
    rows = docs.select("text", "train").mapInArrow(_counted, "hash long, kind int, c long, every long")
    return written(rows.groupBy("hash").agg(F.max("kind").alias("kind"), F.sum("c").alias("c"), F.sum("every").alias("every")), "lm-words")


def dictionary(counted: DataFrame, most: int | None = None) -> Counts:
    """The words said most often, at most `most`, by buckets of counts: no sort, and equal counts are in or out together."""
    bucket = F.floor(F.log2("every") * STEPS).cast("int")
    sizes = sorted(((r["b"], r["n"]) for r in counted.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), reverse=True)
    cut, total = 1 << 30, 0
    for b, n in sizes:
        total += n
        if total > (DICTIONARY if most is None else most):
            break
        cut = b
    top = counted.where((bucket >= cut) | (F.col("hash") == int(END))).toArrow()
    h, kind, c = (top.column(x).to_numpy().astype(np.int64) for x in ("hash", "kind", "c"))
    order = np.argsort(h)
    h, kind, c = h[order], kind[order], c[order]
    sums = np.zeros((KINDS, 2), np.int64)
    for r in counted.groupBy("kind").agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).collect():
        sums[r["kind"]] = r["c"], r["v"]
    n, v = map(int, sums.sum(axis=0))
    known = np.flatnonzero((c > 0) & (h != END))
    known = known[np.lexsort((h[known], -c[known]))][: TOKENS - KINDS - 1]
    known = np.append(known, np.flatnonzero(h == END))
    np.subtract.at(sums, kind[known], np.stack([c[known], c[known] > 0], axis=1))
    of_kind = sums.sum(axis=1) + 1
    mass = np.concatenate([c[known] + 1, of_kind]).astype(float)
    order = np.argsort(-mass, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    token = number[len(known) + kind]
    token[known] = number[: len(known)]
    return Counts(n, v, h, c, token, number[len(known) :], of_kind, mass[order], int(number[len(known) - 1]), starts(h))


def _beginning(hashes: np.ndarray) -> np.ndarray:
    """The first BITS bits of each hash, in the order of signed hashes."""
    return (hashes >> (64 - BITS)) + (1 << (BITS - 1))


def starts(hashes: np.ndarray) -> np.ndarray:
    """Of hashes in order, the place of the first that has each beginning or a greater one."""
    n = np.bincount(_beginning(hashes), minlength=1 << BITS)
    return (np.cumsum(n) - n).astype(np.int32)


def _found(counts: Counts, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the dictionary, whether it is there) of each hash."""
    last = len(counts.hash) - 1
    at = np.minimum(counts.start[_beginning(hashes)].astype(np.int64), last)
    open_ = np.flatnonzero(counts.hash[at] < hashes)
    while len(open_):  # few hashes have one beginning
        open_ = open_[at[open_] < last]
        at[open_] += 1
        open_ = open_[counts.hash[at[open_]] < hashes[open_]]
    return at, counts.hash[at] == hashes


def _texts(counts: Counts, column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts: the first row, each text's tokens with the end, words' counts (-1 outside the dictionary),
    kinds, hashes, whether each is one of its kind by the model, and each text's first word."""
    for i, _, buffer, offsets in words.slices(column):
        w = words.words_of(buffer, offsets, lower=True)
        h = w.hash.view(np.int64)
        kind = kinds_of(w, buffer, offsets)
        at, there = _found(counts, h)
        by_kind = counts.kind_token[kind]
        token = np.where(there, counts.token[at], by_kind).astype(np.int32)
        c = np.where(there, counts.c[at], -1)
        docs = [np.append(token[a:b], np.int32(counts.end)) for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        yield i, docs, c, kind, h, token == by_kind, w.first


def _packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(bytes(data))) as z:
        return {k: z[k] for k in z.files}


def learn(docs: DataFrame, counts: Counts) -> tuple[dict[str, np.ndarray], gru.Shape]:
    """The model's parameters after a round over each part: docs has text and part."""
    spark = docs.sparkSession
    shape = gru.Shape(HIDDEN, gru.class_cuts(counts.mass, CLASSES))
    p = gru.start(counts.mass, shape)
    state = p | {f"seen_{k}": v for k, v in gru.unseen(p).items()}
    given = spark.sparkContext.broadcast(counts)
    for i in range(ROUNDS):
        now, rate = spark.sparkContext.broadcast(state), RATE * FALL**i

        def trained(batches: Iterator[pa.RecordBatch], now=now, rate=rate) -> Iterator[pa.RecordBatch]:
            own = {k: v.copy() for k, v in now.value.items()}
            seen = {k[5:]: v for k, v in own.items() if k.startswith("seen_")}
            some: list[np.ndarray] = []
            n = total = 0
            for b in batches:
                for _, docs, *_ in _texts(given.value, b.column("text")):
                    some += docs
                    n += sum(map(len, docs))
                    if n >= LEARNED:
                        gru.train(own, seen, shape, some, rate)
                        some, n, total = [], 0, total + n
            gru.train(own, seen, shape, some, rate)
            if total + n:
                yield pa.RecordBatch.from_pydict({"state": [_packed(own)], "n": [total + n]}, pa.schema([("state", pa.binary()), ("n", pa.int64())]))

        def add(a, row):
            got = {k: v.astype(np.float64) * row[1] for k, v in _unpacked(row[0]).items()}
            return (got, row[1]) if a is None else both(a, (got, row[1]))

        def both(a, b):
            if a is None or b is None:
                return b if a is None else a
            for k, v in b[0].items():
                a[0][k] += v
            return a[0], a[1] + b[1]

        mean = docs.where(F.col("part") == i).select("text").mapInArrow(trained, "state binary, n long").rdd.treeAggregate(None, add, both, depth=2)
        if mean is not None:
            state = {k: (v / mean[1]).astype(np.float32) for k, v in mean[0].items()}
        now.unpersist()
    return {k: state[k] for k in p}, shape


def _scored(docs: DataFrame, counts: Counts, p: dict[str, np.ndarray], shape: gru.Shape) -> DataFrame:
    """row (a number of its own), doc_id, held_out and each text's sums over the end and the words of the dictionary: n_tokens,
    n_known, base_score and score; rare has its other words, once each."""
    given = docs.sparkSession.sparkContext.broadcast((counts, p))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rare = pa.struct([("hash", pa.int64()), ("kind", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, p = given.value
        number = TaskContext.get().partitionId() << 33
        all_, of_kind = np.log10(counts.n + counts.v + 1), np.log10(counts.of_kind)
        end = int(counts.c[counts.hash == END][0]) if (counts.hash == END).any() else 0
        docs: list[np.ndarray] = []
        rows: list[tuple] = []
        heads: list[pa.RecordBatch] = []
        n = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            known, base, more, others = zip(*rows, strict=True)
            got = gru.score(p, shape, docs) / np.log(10) + np.array(more)
            ids = pa.concat_arrays([h.column("doc_id") for h in heads])
            held = pa.concat_arrays([h.column("held_out") for h in heads])
            first = np.concatenate([[0], np.cumsum([len(o[0]) for o in others])]).astype(np.int32)
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate([o[i] for o in others]).astype(t)) for i, t in enumerate((np.int64, np.int32, np.int64))], fields=list(rare))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(docs))), ids, held, pa.array([len(d) for d in docs], pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(got), pa.ListArray.from_arrays(pa.array(first), flat)], names=["row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])
            number += len(docs)

        for b in batches:
            for i, some, c, kind, h, by_kind, first in _texts(counts, b.column("text")):
                there = c >= 0
                value = np.where(there, np.log10(np.maximum(c, 0) + 1.0), 0)
                base = np.where(there, value - all_, 0)
                more = np.where(there & by_kind, value - of_kind[kind], 0)
                sums = [np.concatenate([[0], np.cumsum(x)])[first] for x in (base, more, c > 0)]
                base, more, known = (np.diff(x) for x in sums)
                for d in range(len(some)):
                    out = np.flatnonzero(~there[first[d] : first[d + 1]]) + first[d]
                    u, at, k = np.unique(h[out], return_index=True, return_counts=True)
                    rows.append((int(known[d]) + (end > 0), float(base[d]) + np.log10(end + 1.0) - all_, float(more[d]), (u, kind[out][at], k)))
                docs += some
                heads.append(b.slice(i, len(some)).select(["doc_id", "held_out"]))
                n += sum(map(len, some))
                if n >= GROUP:
                    yield from flush()
                    docs, rows, heads, n = [], [], [], 0
        if docs:
            yield from flush()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<hash:bigint,kind:int,n:bigint>>")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document's whole text."""
    spark = docs.sparkSession
    ship(spark)
    held = held_out(F.col(key))
    part = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(ROUNDS))
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), held.alias("held_out"), (~held).alias("train"), part.alias("part"))
    counted = count_words(rows)
    counts = dictionary(counted)
    p, shape = learn(rows.where("train"), counts)
    found = written(_scored(rows, counts, p, shape), "lm-scores")
    rare = found.select("row", F.explode("rare").alias("x")).select("row", "x.*")
    c = F.coalesce("c", F.lit(0))
    of_kind = F.element_at(F.lit([float(x) for x in counts.of_kind]), F.col("kind") + 1)
    joined = rare.join(counted.select(F.col("hash"), "c"), "hash", "left")
    sums = joined.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n"))).alias("_known"), F.sum(F.col("n") * (F.log10(c + 1.0) - F.lit(float(np.log10(counts.n + counts.v + 1))))).alias("_base"), F.sum(F.col("n") * (F.log10(c + 1.0) - F.log10(of_kind))).alias("_score"))
    out = found.drop("rare").join(sums, "row", "left")
    plus = lambda a, b, zero: (F.col(a) + F.coalesce(b, F.lit(zero))).alias(a)
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "_known", 0), F.lit(counts.n).cast("long").alias("train_tokens"), plus("base_score", "_base", 0.0), plus("score", "_score", 0.0))
