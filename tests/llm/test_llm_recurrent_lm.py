import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.llm import gru
from quernel.llm import recurrent_lm as L

SF = "/root/testdata/sf0.001"


def model(seed=1, hidden=5, tokens=17, classes=4, noise=0.5):
    r = np.random.default_rng(seed)
    mass = np.sort(r.integers(1, 100, tokens))[::-1].astype(float)
    shape = gru.Shape(hidden, gru.class_cuts(mass, classes))
    p = gru.start(mass, shape)
    return {k: (v + r.normal(0, noise, v.shape)).astype(np.float64) for k, v in p.items()}, shape, mass


def plain(p, shape, doc, end):
    """Log-likelihood of one document, token by token."""
    h, out, last = np.zeros(shape.hidden), 0.0, end
    n = shape.hidden
    sig = lambda a: 1 / (1 + np.exp(-a))
    for t in doc:
        g = sig(p["xg"][last] + p["bg"] + h @ p["ug"])
        z, r = g[:n], g[n:]
        c = np.tanh(p["xn"][last] + p["bn"] + r * (h @ p["un"]))
        h = z * h + (1 - z) * c
        lc = h @ p["wc"] + p["bc"]
        k = int(np.searchsorted(shape.first, t, side="right")) - 1
        lo, hi = shape.first[k], shape.first[k + 1]
        lw = p["wo"][lo:hi] @ h + p["bo"][lo:hi]
        out += lc[k] - np.log(np.exp(lc).sum()) + (lw[t - lo] - np.log(np.exp(lw).sum()) if hi - lo > 1 else 0)
        last = t
    return out


def some_docs(r, n, tokens, longest=200):
    return [np.append(r.integers(0, tokens - 1, r.integers(0, longest)), tokens - 1).astype(np.int32) for _ in range(n)]


def test_scores_equal_a_step_by_step_model(monkeypatch):
    monkeypatch.setattr(gru, "F4", np.float64)
    p, shape, _ = model()
    docs = some_docs(np.random.default_rng(2), 30, 17)
    for lanes in (1, 4, 64):
        monkeypatch.setattr(gru.lanes_of, "__defaults__", (None, lanes))
        assert np.allclose(gru.score(p, shape, docs), [plain(p, shape, d, 16) for d in docs], atol=1e-9)
    assert len(gru.score(p, shape, [])) == 0


def test_probabilities_sum_to_one():
    p, shape, mass = model()
    state = np.random.default_rng(3).normal(size=(1, shape.hidden))
    each = [gru.outputs(p, shape, state, np.array([t]))[0][0] for t in range(17)]
    assert abs(np.exp(each).sum() - 1) < 1e-9
    untrained = gru.start(mass, shape)
    each = [gru.outputs(untrained, shape, state.astype(np.float32), np.array([t]))[0][0] for t in range(17)]
    assert np.allclose(np.exp(each), mass / mass.sum(), rtol=1e-5)


def test_pieces_follow_their_documents():
    run = gru.lanes_of([np.array([1, 2]), np.array([3, 4, 5])], [9, 2], 1)
    assert run.target[:, 0].tolist() == [3, 4, 5, 1, 2] and run.input[:, 0].tolist() == [2, 3, 4, 9, 1] and run.begins[:, 0].tolist() == [True, False, False, True, False]


def test_gradients_equal_differences(monkeypatch):
    """Within one window truncated gradients are whole ones."""
    monkeypatch.setattr(gru, "F4", np.float64)
    p, shape, _ = model()
    docs = some_docs(np.random.default_rng(5), 6, 17, 9)
    n = sum(map(len, docs))
    got = {}

    def keep(p, seen, name, g, rate, rows=slice(None)):
        full = np.zeros_like(p[name])
        full[rows] = g
        got[name] = full

    monkeypatch.setattr(gru, "_descend", keep)
    gru.train(p, gru.unseen(p), shape, docs)
    r = np.random.default_rng(6)
    for name, v in p.items():
        for _ in range(12):
            at = tuple(r.integers(0, s) for s in v.shape)
            old, e = v[at], 1e-5
            v[at] = old + e
            up = gru.score(p, shape, docs).sum()
            v[at] = old - e
            down = gru.score(p, shape, docs).sum()
            v[at] = old
            assert abs((down - up) / (2 * e) / n - got[name][at]) < 1e-7, name


def test_training_learns_what_comes_next():
    mass = np.array([4.0, 3, 3, 2, 2, 1])
    shape = gru.Shape(8, gru.class_cuts(mass, 2))
    p = gru.start(mass, shape)
    docs = [np.array([0, 1, 2, 3, 4] * 30 + [5], np.int32)] * 40
    before = gru.score(p, shape, docs[:1])[0]
    seen = gru.unseen(p)
    for _ in range(4):
        gru.train(p, seen, shape, docs, 0.1)
    assert gru.score(p, shape, docs[:1])[0] > before * 0.3


def brute(rows):
    """All but the score, by dictionaries."""
    toks = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = {}
    for i, t in rows:
        if not held(i):
            for w in toks(t):
                c[w] = c.get(w, 0) + 1
    n, v = sum(c.values()), len(c)
    return sorted((repr(i), held(i), len(toks(t)), sum(w in c for w in toks(t)), n, round(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in toks(t)), 6)) for i, t in rows)


def got(df):
    rows = df.collect()
    assert all(r["score"] <= 1e-6 and math.isfinite(r["score"]) for r in rows)
    return sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)


ODD = ["", None, " \t", "A a Ab aB É é", "x" * 70000, "end.", "\x0b\x1c  nbsp", "word " * 30000, "日本語 🎉"]


@pytest.mark.parametrize("most", [1 << 18, 20, 0])
def test_base_equals_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(L, "DICTIONARY", most)
    monkeypatch.setattr(L, "COUNTED", 50)
    monkeypatch.setattr(L, "GROUP", 3000)
    monkeypatch.setattr(L, "LEARNED", 2000)
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(None, "no id"), (3, "twice"), (3, "twice")]
    rows += [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(i))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("row", "hash", "kind", "c", "n", "train", "part", "rare", "every")}).repartition(4)
    out = L.score_documents(df)
    assert out.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got(out) == brute(rows)


def test_no_documents_or_none_to_learn_from(spark):
    assert got(L.score_documents(spark.createDataFrame([], "doc_id long, text string"))) == []
    out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(out, "nothing is known here")]
    assert got(L.score_documents(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows) == [(str(out), True, 5, 0, 0, 0.0)]


def test_held_out_documents_are_better_than_the_base(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = L.score_documents(docs).collect()
    assert len(rows) == 200 and got(spark.createDataFrame(rows)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > 0.99 * sum(r["base_score"] for r in out)
    again = {r["doc_id"]: r["score"] for r in L.score_documents(docs).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-3 * abs(r["score"]) for r in rows)


def test_every_part_of_the_training_documents_is_learned_from(spark):
    """Documents of one hashed part alone, whichever it is of 16, move the model off the unigram that it begins as."""
    ids = spark.range(400).select("id", F.lit(" ".join(["one two three"] * 300)).alias("text")).where(~L.held_out(F.col("id")))
    parts = {r["part"]: r for r in ids.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(16))).collect()}
    assert len(parts) == 16
    for part in (3, 4, 9, 15):
        df = spark.createDataFrame([(parts[part]["id"], parts[part]["text"])] * 8, "doc_id long, text string")
        r = L.score_documents(df).first()
        assert r["score"] > 0.9 * r["base_score"], part


def test_words_are_found_as_by_bisection_but_faster():
    r = np.random.default_rng(8)
    for n in (1, 2, 50, 1 << 18):
        h = np.unique(np.append(r.integers(-(1 << 63), (1 << 63) - 1, n), L.END))
        h = np.unique(np.concatenate([h, h[: n // 3] + 1, [-(1 << 63), (1 << 63) - 1]]))
        counts = L.Counts(0, 0, h, h, h, h, h, h, 0, L.starts(h))
        some = np.concatenate([r.choice(h, 5000), r.integers(-(1 << 63), (1 << 63) - 1, 5000), h[-3:], [-(1 << 63), (1 << 63) - 1, 0]])
        at, there = L._found(counts, some)
        want = np.minimum(np.searchsorted(h, some), len(h) - 1)
        assert (at == want).all() and (there == (h[want] == some)).all() and there.sum() >= 5000
    none, no = L._found(L.Counts(0, 0, h[:0], h[:0], h[:0], h, h, h, 0, L.starts(h[:0])), h[:0])
    assert len(none) == len(no) == 0


def test_rows_are_only_searched_for_their_greatest_where_it_may_overflow(monkeypatch):
    seen = []
    exponents = gru._exponents
    monkeypatch.setattr(gru, "_exponents", lambda a, bound: seen.append((float(a.max()), bound)) or exponents(a, bound))
    for noise in (0.5, 40.0):
        p, shape, _ = model(noise=noise)
        state = np.random.default_rng(3).uniform(-1, 1, (40, shape.hidden))
        got, _ = gru.outputs(p, shape, state, np.arange(40) % 17)
        assert np.isfinite(got).all() and (got < 1e-9).all()
        assert all(most <= bound for most, bound in seen) and (max(b for _, b in seen) > 60) == (noise > 1)
        seen.clear()
