"""Quality classifier by co-training of two views.

The text view sees what a text is made of (kinds of characters, words that tell good from bad); the metadata view
sees language, source and length. Both start from the labelled rows. Over some rounds each view scores every unlabelled
document and gives those it is surest of, with their pseudo-labels, to the other's training set: the scores of the whole
pool are counted in bins, and the bins tell from which score on a document is given. At the end both views are calibrated
on labelled rows kept apart, their log odds are added (less the common prior), and all documents are scored.

Fitting uses at most max_labelled labelled rows, chosen by a hash of the id; they reach the driver, packed to some hundred
bytes each. Everything else covers all documents: these are packed once into a written table, rounds read that, and
Newton's steps sum the gradients and curvatures of pseudo-labelled rows where they lie.

A document is good if its quality is 1 and it isn't toxic. Defined cases: null, empty and wordless texts score 0
and are not kept; labels without a document and null labels are left out; without labels of both kinds every other
document gets the share of good labels (or 1) as its score; equal rows score alike; missing metadata columns count as
null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm import words as W
from quernel.session import ship, written

U = np.uint64
BINS, META = 1 << 18, 128
#: Beside whole words, their beginnings of so many bytes are features: inflected and compound words share them.
STEMS = (4, 5, 6, 7, 8)
#: Kinds of bytes whose shares are features.
KINDS = ("letters", "upper", "digits", "breaks", "marks", "symbols", "high")
_byte = np.zeros(256, np.uint8)
_byte[128:] = 6
_byte[33:127] = 5
for _c in b".,;:'\"-?!()":
    _byte[_c] = 4
_byte[10] = _byte[13] = 3
_byte[48:58] = 2
_byte[65:91] = 1
_byte[97:123] = 0
_byte[[32, 9, 11, 12]] = 7
_byte[[i for i in range(32) if i not in (9, 10, 11, 12, 13)]] = 5
_plain = np.full(256, 32, np.uint8)
for _i in range(256):
    if _byte[_i] in (0, 2, 6):
        _plain[_i] = _i
    elif _byte[_i] == 1:
        _plain[_i] = _i + 32


def text_features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(statistics, first, bins): numbers for each text, and the hashed bins of its words stripped of marks and case."""
    for i, j, buffer, offsets in W.slices(column):
        n = j - i
        part = buffer[offsets[0] : offsets[-1]]
        at = offsets - offsets[0]
        size = np.maximum(1, np.diff(at))
        kinds = _byte[part]
        stats = np.zeros((n, len(KINDS) + 5))
        for k in range(len(KINDS)):
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(kinds == k, out=sums[1:])
            stats[:, k] = (sums[at[1:]] - sums[at[:-1]]) / size
        w = W.words_of(buffer, offsets)
        count = np.diff(w.first)
        same = np.concatenate([[0], np.cumsum(np.append(w.hash[1:] == w.hash[:-1], False))]) if len(w.hash) else np.zeros(1)
        stats[:, -5] = (same[np.maximum(w.first[1:] - 1, w.first[:-1])] - same[w.first[:-1]]) / np.maximum(1, count)
        stats[:, -4] = np.log1p(count)
        stats[:, -3] = np.log1p(size / np.maximum(1, count))
        plain = W.words_of(_plain[part], at)
        stats[:, -2] = np.log1p(np.diff(plain.first)) - np.log1p(count)
        stats[:, -1] = count == 0
        yield stats, *_word_bins(_plain[part], at, plain)


def _word_bins(buffer: np.ndarray, at: np.ndarray, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first, bins): of each text the bins of its words and of their beginnings, word after word."""
    n, width = len(w.hash), 1 + len(STEMS)
    bins = np.zeros((n, width), np.int32)
    bins[:, 0] = w.hash % U(BINS)
    start = w.start + np.repeat(at[:-1], np.diff(w.first))
    padded = np.append(buffer, np.zeros(8, np.uint8))
    head = np.zeros(n, U)
    for k in range(max(STEMS)):
        head = head << U(8) | padded[start + k].astype(U)
        if k + 1 in STEMS:
            whole = w.end - w.start >= k + 1  # a shorter word has no such beginning; its own bin stands in
            bins[:, 1 + STEMS.index(k + 1)] = np.where(whole, W.mix(head + U(k)) % U(BINS), bins[:, 0])
    return w.first * width, bins.ravel()


def meta_features(lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> np.ndarray:
    """One-hot hashed language and source, and the length's order of magnitude."""
    out = np.zeros((len(lang), META))
    for name, s in (("l", lang), ("s", source)):
        code, values = pd.factorize(s, use_na_sentinel=False)
        bins = np.array([zlib.crc32(f"{name}|{v}".encode()) % (META - 2) for v in values], np.int64)
        if len(code):
            out[np.arange(len(code)), bins[code]] += 1
    out[:, -2] = np.log1p(np.nan_to_num(pd.to_numeric(n_chars, errors="coerce").to_numpy(float), nan=0).clip(0)) / 10
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def curvature(x: np.ndarray, y: np.ndarray, w: np.ndarray, mean: np.ndarray | float, scale: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """(curvature, gradient) of the log-likelihood over the rows standardized; they are taken a block at a time."""
    d = len(w)
    h, g = np.zeros((d, d)), np.zeros(d)
    for s in range(0, len(x), 1024):
        z = np.ones((len(x[s : s + 1024]), d))
        z[:, :-1] = (x[s : s + 1024] - mean) / scale
        p = _sigmoid(z @ w)
        h += z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None])
        g += z.T @ (y[s : s + 1024] - p)
    return h, g


def fit_logistic(x: np.ndarray, y: np.ndarray, mean: np.ndarray | float = 0.0, scale: np.ndarray | float = 1.0, l2: float = 1.0, steps: int = 12, w: np.ndarray | None = None, more=None) -> np.ndarray:
    """Newton's method on ridge logistic regression of standardized rows; the intercept, last, is free.

    more(w) gives the curvature and gradient of further rows, which lie elsewhere."""
    d = x.shape[1] + 1
    w, ridge = np.zeros(d) if w is None else w, np.full(d, l2)
    ridge[-1] = 1e-6
    for _ in range(steps):
        h, g = curvature(x, y, w, mean, scale)
        if more is not None:
            h2, g2 = more(w)
            h, g = h + h2, g + g2
        step = np.linalg.solve(h + np.diag(ridge), g - ridge * w)
        w = w + step
        if np.abs(step).max() < (1e-6 if more is None else 1e-3):
            break
    return w


@dataclass
class View:
    """Standardized logistic regression with a Platt calibration (slope, shift) of its log odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    platt: tuple[float, float] = (1.0, 0.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        w = self.weights[:-1] / self.scale
        z = x @ w + (self.weights[-1] - self.mean @ w)
        return np.clip(self.platt[0] * z + self.platt[1], -15, 15)


def fit_view(x: np.ndarray, y: np.ndarray, l2: float, start: View | None = None, more=None) -> View:
    """A view fitted to rows (and more; see fit_logistic), standardized as start is or else by these rows."""
    if start is None:
        mean, scale = x.mean(axis=0, dtype=np.float64), x.std(axis=0, dtype=np.float64)
        scale[scale < 1e-6] = 1
        return View(mean, scale, fit_logistic(x, y, mean, scale, l2))
    return View(start.mean, start.scale, fit_logistic(x, y, start.mean, start.scale, l2, w=start.weights, more=lambda w: more(w, start.mean, start.scale)))


def calibrate(view: View, x: np.ndarray, y: np.ndarray) -> None:
    """Platt scaling on rows that the view wasn't fitted to; a view that tells nothing there ends near the prior."""
    if len(np.unique(y)) == 2:
        z = view.odds(x)
        slope, shift = fit_logistic(z[:, None], y, l2=0.1)
        view.platt = (max(0.0, float(slope)), float(shift)) if slope > 0 else (0.0, float(np.log(y.mean() / (1 - y.mean()))))


@dataclass
class Model:
    prior: float
    column: np.ndarray = field(default_factory=lambda: np.full(BINS, -1, np.int32))  # of each bin, its place among the text view's words
    words: int = 0
    text: View | None = None
    meta: View | None = None

    def text_matrix(self, stats: np.ndarray, first: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Statistics, and for each chosen word whether the text has it."""
        out = np.zeros((len(stats), stats.shape[1] + self.words), np.float64)
        out[:, : stats.shape[1]] = stats
        c = self.column[bins]
        rows = np.repeat(np.arange(len(stats)), np.diff(first))[c >= 0]
        out[rows, stats.shape[1] + c[c >= 0]] = 1
        return out

    def score(self, text_odds: np.ndarray, meta_odds: np.ndarray) -> np.ndarray:
        return _sigmoid(text_odds + meta_odds - np.log(self.prior / (1 - self.prior)))


def telling_words(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int, most: int) -> np.ndarray:
    """The bins whose presence depends on the label most surely (log-likelihood ratio), if beyond chance among all bins.

    k1, k0: in how many of the n1 good and n0 other texts each bin is."""
    g, rate = np.zeros(len(k1)), (k1 + k0) / (n1 + n0)
    for k, n, r in ((k1, n1, rate), (n1 - k1, n1, 1 - rate), (k0, n0, rate), (n0 - k0, n0, 1 - rate)):
        with np.errstate(divide="ignore", invalid="ignore"):
            g += np.where(k > 0, 2 * k * np.log(k / (n * r)), 0)
    seen = max(1, np.count_nonzero(k1 + k0))
    order = np.argsort(-g, kind="stable")[:most]
    return order[g[order] > 2 * np.log(seen / 0.5)]


class Packed:
    """Rows of a batch with columns stats, hits and meta, as matrices of the two views; and a number in [0, 1) from each row's content."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, words: int) -> None:
        get = lambda name, kind, width: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, width)
        self.n = batch.num_rows
        stats, hits, meta = (get(c, k, w) for c, k, w in (("stats", "f4", len(KINDS) + 5), ("hits", "u1", -(-words // 8) + 1), ("meta", "f4", 3)))
        self.text = np.concatenate([stats, np.unpackbits(hits[:, :-1], axis=1)[:, :words].astype("f4")], axis=1)
        self.meta = np.zeros((self.n, META), "f4")
        for k in range(2):
            self.meta[np.arange(self.n), meta[:, k].astype(int)] += 1
        self.meta[:, -2] = meta[:, 2]
        self.wordless = stats[:, -1] > 0
        self.place = np.array([zlib.crc32(a + b) for a, b in zip(batch.column("stats").to_pylist(), batch.column("hits").to_pylist(), strict=True)], float) / 2**32


def _pack(stats: np.ndarray, hits: np.ndarray, meta: np.ndarray) -> list[pa.Array]:
    """Columns stats, hits and meta: single precision, a bit a word, and the metadata's two places and length."""
    places = np.argsort(-meta[:, : META - 2], axis=1, kind="stable")[:, :2].astype("f4")
    places[:, 1] = np.where(meta[:, : META - 2].max(axis=1) > 1, places[:, 0], places[:, 1])
    rows = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    bits = np.concatenate([np.packbits(hits, axis=1), np.zeros((len(stats), 1), np.uint8)], axis=1)
    return [rows(stats.astype("f4")), rows(bits), rows(np.concatenate([places, meta[:, -2:-1].astype("f4")], axis=1))]


#: Log odds are counted in bins of this width.
STEP, EDGE = 0.01, 15.0


def _bins(odds: np.ndarray) -> np.ndarray:
    return np.floor((odds + EDGE) / STEP).astype(np.int64)


@dataclass
class Round:
    """The views of a round, and of each view and label the bin from which on rows are given, with the share given of that bin itself."""

    views: dict[str, View]
    least: dict[tuple[str, int], tuple[int, float]] = field(default_factory=dict)


def given(rows: Packed, past: list[Round]) -> dict[str, np.ndarray]:
    """For each view the pseudo-labels (-1: none) that the other has given it in past rounds."""
    out = {v: np.full(rows.n, -1) for v in ("text", "meta")}
    for r in past:
        new = {}
        for v, other in (("text", "meta"), ("meta", "text")):
            odds = r.views[v].odds(getattr(rows, v))
            new[other] = out[other].copy()
            for label, z in ((1, odds), (0, -odds)):
                least, share = r.least[v, label]
                bins = _bins(z)
                new[other][(out[other] < 0) & ((bins > least) | (bins == least) & (rows.place < share)) & ~rows.wordless] = label
        out = new
    return out


def thresholds(counts: dict[tuple[str, int], np.ndarray], pool: int, prior: float, give: float, sure: float) -> dict[tuple[str, int], tuple[int, float]]:
    """From counts of free rows by bin: the surest rows up to give x pool x the label's share, of those at least `sure`."""
    out, floor = {}, int(_bins(np.array(np.log(sure / (1 - sure)))))
    for (v, label), n in counts.items():
        most = max(1.0, give * pool * (prior if label else 1 - prior))
        above = np.cumsum(n[::-1])[::-1]
        fits = np.flatnonzero(above <= most)
        first = max(int(fits[0]) if len(fits) else len(n), floor + 1)  # whole bins from here on
        left = most - (above[first] if first < len(n) else 0)
        edge = first - 1
        out[v, label] = (edge, min(1.0, left / n[edge]) if edge > floor and n[edge] else 0.0)
    return out


def co_train(labelled: Packed, y: np.ndarray, aside: np.ndarray, model: Model, pool, *, rounds: int = 3, give: float = 0.05, sure: float = 0.95, l2: float = 1.0) -> Model:
    """labelled: rows with labels y, of which those aside are kept for calibration. pool: the unlabelled rows (see Pool)."""
    if len(np.unique(y[aside])) < 2 or len(np.unique(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    base, check = ~aside, aside if aside.any() else ~aside
    x = {v: getattr(labelled, v) for v in ("text", "meta")}
    views: dict[str, View | None] = {v: None for v in x}
    past: list[Round] = []
    for turn in range(rounds + 1):
        views = {v: fit_view(x[v][base], y[base].astype(float), l2, views[v], (lambda w, m, s, v=v: pool.sums(v, w, m, s))) for v in x}
        for v in x:
            calibrate(views[v], x[v][check], y[check].astype(float))
        if turn == rounds or not pool.n:
            break
        now = Round(views)
        now.least = thresholds(pool.counts(past, now), pool.n, model.prior, give, sure)
        pool.label(past, now)
        past.append(now)
    model.text, model.meta = views["text"], views["meta"]
    return model


class Pool:
    """Unlabelled rows in a written table; those with pseudo-labels are written too, a table a round."""

    def __init__(self, rows: DataFrame, words: int) -> None:
        self.rows, self.words, self.labelled = rows, words, []
        self.n = rows.count()

    def counts(self, past: list[Round], now: Round) -> dict[tuple[str, int], np.ndarray]:
        """Of each view and label, the rows by bin that the other view has no label for."""
        words, size = self.words, int(2 * EDGE / STEP) + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros((2, 2, size), np.int64)
            for b in batches:
                rows = Packed(b, words)
                have = given(rows, past)
                for k, (v, other) in enumerate((("text", "meta"), ("meta", "text"))):
                    odds = now.views[v].odds(getattr(rows, v))[(have[other] < 0) & ~rows.wordless]
                    for label in (0, 1):
                        n[k, label] += np.bincount(_bins(odds if label else -odds), minlength=size)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.ravel()[at])], names=["at", "n"])

        found = self.rows.select("stats", "hits", "meta").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros(4 * size, np.int64)
        n[found["at"].to_numpy()] = found["n"].to_numpy()
        return {(v, label): n.reshape(2, 2, size)[k, label] for k, v in enumerate(("text", "meta")) for label in (0, 1)}

    def label(self, past: list[Round], now: Round) -> None:
        """Write the rows that this round gives labels."""
        words = self.words

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = Packed(b, words)
                before, after = given(rows, past), given(rows, [*past, now])
                for v in ("text", "meta"):
                    at = np.flatnonzero((before[v] < 0) & (after[v] >= 0))
                    some = b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array([v] * len(at), pa.string()), pa.array(after[v][at].astype(np.int32)), *(some.column(c) for c in ("stats", "hits", "meta"))], names=["view", "y", "stats", "hits", "meta"])

        out = self.rows.select("stats", "hits", "meta").mapInArrow(run, "view string, y int, stats binary, hits binary, meta binary")
        self.labelled.append(written(out, "pseudo"))

    def sums(self, view: str, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient of the pseudo-labelled rows, summed where they lie, then in a fixed number of parts."""
        words, d = self.words, len(w)
        schema = "part int, sums binary"

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((d + 1, d))
            for b in batches:
                h, g = curvature(getattr(Packed(b, words), view), b.column(b.schema.get_field_index("y")).to_numpy().astype(float), w, mean, scale)
                total[:-1] += h
                total[-1] += g
            if total.any():
                part = (TaskContext.get().partitionId() if TaskContext.get() else 0) % 16
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], names=["part", "sums"])

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((d + 1, d))
            for b in batches:
                for x in b.column(1):
                    out += np.frombuffer(x.as_buffer(), np.float64).reshape(d + 1, d)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([out.tobytes()])], names=["part", "sums"])

        rows = self.labelled[0]
        for more in self.labelled[1:]:
            rows = rows.union(more)
        parts = rows.where(F.col("view") == view).mapInArrow(partial, schema).repartition(16, "part").mapInArrow(total, schema)
        out = np.zeros((d + 1, d))
        for x in parts.toArrow()["sums"].to_pylist():  # one row a part at most
            out += np.frombuffer(x, np.float64).reshape(d + 1, d)
        return out[:-1], out[-1]


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    get = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), get("lang", "string"), get("source", "string"), get("n_chars", "double"))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", *, max_labelled: int = 12_000, words: int = 256, **how) -> Model:
    """Fit on a sample of the labelled rows, at most max_labelled, and on all rows of other ids as the pool.

    labels has one row an id (of several, the worst counts). Of an id's texts, that of least hash is fitted to."""
    spark = docs.sparkSession
    ship(spark)
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int")
    marked = labels.where("quality is not null").groupBy(F.col(key).alias("_id")).agg(F.min(good).alias("y"))
    place = lambda seed: F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1 << 30))
    n = marked.count()
    some = marked.where(place(0) < int((1 << 30) * min(1.0, 0.9 * max_labelled / max(1, n)))).limit(max_labelled)
    some = written(some.withColumn("aside", place(3) % 4 == 0), "labels")
    d = _columns(docs, key, text).withColumn("_id", F.col("doc_id"))
    # an id may have any number of rows: the one of least hash stands for it, so rows are bounded as ids are
    first = F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang", "source", "n_chars")).alias("r")
    labelled = d.join(F.broadcast(some), "_id").groupBy("_id", "y", "aside").agg(first)
    labelled = written(labelled.select("y", "aside", "r.text", "r.lang", "r.source", "r.n_chars"), "sample")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y, at, k = b.column(1).to_numpy(), 0, np.zeros((2, BINS), np.int64)
            for stats, first, bins in text_features(b.column(0)):
                for i in range(len(stats)):
                    k[y[at + i], np.unique(bins[first[i] : first[i + 1]])] += 1
                at += len(stats)
            some = np.flatnonzero(k.sum(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(k[1, some]), pa.array(k[0, some])], names=["bin", "k1", "k0"])

    size = {(r["y"], r["aside"]): r["n"] for r in labelled.groupBy("y", "aside").agg(F.count("*").alias("n")).collect()}
    good, bad = (sum(k for (v, _), k in size.items() if v == y) for y in (1, 0))
    if not good or not bad:
        return Model(1.0 if good or not bad else 0.0)
    fitted = labelled.where("not aside") if all((y, False) in size for y in (0, 1)) else labelled
    n1, n0 = (sum(k for (v, aside), k in size.items() if v == y and (fitted is labelled or not aside)) for y in (1, 0))
    # one row a bin: a fixed number
    found = fitted.select("text", "y").mapInArrow(counts, "bin long, k1 long, k0 long").groupBy("bin").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).toArrow()
    k1, k0 = np.zeros(BINS), np.zeros(BINS)
    k1[found["bin"].to_numpy()], k0[found["bin"].to_numpy()] = found["k1"].to_numpy(), found["k0"].to_numpy()
    chosen = telling_words(k1, k0, n1, n0, words)
    model = Model(float(np.clip(good / (good + bad), 0.01, 0.99)))
    model.column[chosen] = np.arange(len(chosen))
    model.words = len(chosen)
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, kept = 0, [c for c in ("y", "aside") if c in b.schema.names]
            about = b.select(["lang", "source", "n_chars"]).to_pandas()
            for stats, first, bins in text_features(b.column(b.schema.get_field_index("text"))):
                n = len(stats)
                p = about.iloc[at : at + n]
                hits = sent.value.text_matrix(stats, first, bins)[:, stats.shape[1] :].astype(np.uint8)
                columns = _pack(stats, hits, meta_features(p["lang"], p["source"], p["n_chars"]))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).slice(at, n) for c in kept), *columns], names=[*kept, "stats", "hits", "meta"])
                at += n

    packed = labelled.select("y", "aside", "text", "lang", "source", "n_chars").mapInArrow(features, "y int, aside boolean, stats binary, hits binary, meta binary").toArrow()
    packed = packed.sort_by([(c, "ascending") for c in ("stats", "hits", "meta", "y")])
    others = d.join(F.broadcast(some.select("_id")), "_id", "left_anti").select("text", "lang", "source", "n_chars")
    pool = Pool(written(others.mapInArrow(features, "stats binary, hits binary, meta binary"), "pool"), model.words)
    return co_train(Packed(packed, model.words), packed["y"].to_numpy(), packed["aside"].to_numpy(), model, pool, **how)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", *, keep_from: float = 0.5) -> DataFrame:
    """doc_id, p_text, p_meta, score (that the document is good) and kept for each row."""
    spark = docs.sparkSession
    ship(spark)
    src = _columns(docs, key, text)
    schema = T.StructType([src.schema["doc_id"], *T.StructType.fromDDL("p_text double, p_meta double, score double, kept boolean").fields])
    sent = spark.sparkContext.broadcast(model)  # a fixed number of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for scores in _scored(sent.value, b.column(1), b.select(["lang", "source", "n_chars"])):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(scores[0])), *map(pa.array, scores), pa.array(scores[2] >= keep_from)], names=schema.names)
                at += len(scores[0])

    return src.mapInArrow(run, schema)


def _scored(m: Model, text: pa.Array, about: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p_text, p_meta, score) of a batch's rows, slice by slice."""
    p, at = about.to_pandas(), 0
    for stats, first, bins in text_features(text):
        n = len(stats)
        rows = p.iloc[at : at + n]
        at += n
        if m.text is None:
            text_p = meta_p = total = np.full(n, m.prior)
        else:
            meta_odds = m.meta.odds(meta_features(rows["lang"], rows["source"], rows["n_chars"]))
            text_odds = np.concatenate([m.text.odds(m.text_matrix(stats[s : s + 512], first[s : s + 513] - first[s], bins[first[s] : first[min(n, s + 512)]])) for s in range(0, n, 512)])
            text_p, meta_p, total = _sigmoid(text_odds), _sigmoid(meta_odds), m.score(text_odds, meta_odds)
        yield text_p, meta_p, np.where(stats[:, -1] > 0, 0.0, total)


def keep_good(docs: DataFrame, model: Model, text: str = "text", *, keep_from: float = 0.5) -> DataFrame:
    """The rows of docs that the model keeps, as they are: scored where they lie, without a shuffle."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        about = pa.RecordBatch.from_arrays([lang, source, n_chars], names=["lang", "source", "n_chars"])
        return pa.array(np.concatenate([np.zeros(0), *(s[2] for s in _scored(sent.value, text, about))]))

    read = _columns(docs, text, text)
    about = [F.col(c).cast(read.schema[c].dataType) if c in docs.columns else F.lit(None).cast(read.schema[c].dataType) for c in ("lang", "source", "n_chars")]
    return docs.where(scored(F.col(text).cast("string"), *about) >= keep_from)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Train on labels and score all docs."""
    return score(docs, train(docs, labels, key, text, **how), key, text)
