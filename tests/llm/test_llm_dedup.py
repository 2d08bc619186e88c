import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernel.llm import components, minhash, substring, words

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = tokens((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {}
    for k, t in rows:
        sets.setdefault(k, set()).add(shingles(t))
    find = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if find[a] != find[b] and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                    low = min(find[a], find[b])
                    for k in find:
                        if find[k] in (find[a], find[b]) and k != low:
                            find[k] = low if find[k] != low else find[k]
                    find[a] = find[b] = low
                    changed = True
    return find


def made(seed, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [[r.choice(vocab) for _ in range(r.choice([6, 40, 120]))] for _ in range(6)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(vocab)
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        out.append((i, " ".join(x.upper() if r.random() < 0.1 else x for x in w)))
    return [*out, (100, None), (101, ""), (102, " \n "), (103, "one two"), (104, "One\ttwo"), (105, "é é é"), (105, "é é é")]


@pytest.mark.parametrize(("seed", "small"), [(1, 32), (2, 2)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(minhash, "SMALL", small)
    rows = made(seed)
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, f1 string, id int")
    got = minhash.near_duplicates(df).collect()
    want = brute_components(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    n = dict(rows)
    assert all(r["n_shingles"] == len(shingles(n[r["doc_id"]])) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    limit = minhash.most_differing(0.75)
    for same in (600, 700, 900):
        a = r.integers(0, 1 << 63, 1000, dtype=np.int64).astype(np.uint64)
        b = np.concatenate([a[:same], r.integers(0, 1 << 63, 1000 - same, dtype=np.int64).astype(np.uint64)])
        m = minhash.minhash(np.array([0, 1000, 2000]), np.concatenate([np.sort(a), np.sort(b)]))
        assert (m[0] == m[1]).mean() == pytest.approx(same / (2000 - same), abs=0.12)
    assert 0 < limit < minhash.SKETCH_BITS / 2


def test_components(spark):
    r = random.Random(3)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(200, i) for i in range(201, 240)] + [(i, i + 1) for i in range(300, 330)]
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    find = {k: k for x in links for k in x}
    for _ in range(len(find)):
        for a, b in links:
            find[a] = find[b] = min(find[a], find[b])
    assert got == {k: v for k, v in find.items() if any(a != b and k in (a, b) for a, b in links)}


def passage(r, n):
    return [f"p{r.randrange(10**6)}" for _ in range(n)]


def test_shared_passages(spark):
    r = random.Random(7)
    shared, fuzzy, short = passage(r, 60), passage(r, 120), passage(r, 30)
    worn = list(fuzzy)
    for i in range(7, 120, 15):
        worn[i] = f"x{i}"
    docs = {i: passage(r, 150) for i in range(8)}
    for i in (1, 4, 6):
        docs[i][40:40] = shared
    docs[2][10:10] = fuzzy
    docs[5] = [*worn, *docs[5]]
    for i in (3, 7):
        docs[i][5:5] = short
    docs[9] = docs[10] = passage(r, 80)
    docs[11] = passage(r, 55) * 2  # within one document
    rows = [(k, " ".join(v), 1) for k, v in docs.items()] + [(20, None, 1), (21, "", 1), (22, "few words", 1), (None, " ".join(shared), 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = substring.shared_passages(df).collect()
    pairs = {(x["doc_id"], x["other_doc_id"]) for x in got}
    assert pairs == {(4, 1), (6, 1), (5, 2), (10, 9)}
    text = {k: v.encode() for k, v, _ in rows if v}
    for x in got:
        a, b = (text[x[d]][x[s] : x[e]].decode().split() for d, s, e in (("doc_id", "start", "end"), ("other_doc_id", "other_start", "other_end")))
        want = fuzzy if (x["doc_id"], x["other_doc_id"]) == (5, 2) else None
        assert max(len(a), len(b)) == x["n_words"] >= 50
        assert (a == b == shared) if x["doc_id"] in (4, 6) else (b == fuzzy and a == worn) if want else a == b
    cut = {x["doc_id"]: x["text"] for x in substring.cut_passages(df.where("doc_id is not null"), substring.shared_passages(df)).collect()}
    assert 10 not in cut and "".join(shared) not in cut[4].replace(" ", "") and cut[1] == rows[1][1] and cut[22] == "few words"
    assert len(cut[4].split()) == 150


def test_chains_rise_in_both():
    r = random.Random(1)
    for _ in range(50):
        pts = sorted({(r.randrange(60), r.randrange(60)) for _ in range(25)})
        a, b = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        got = substring.chains(a, b)
        assert sorted(i for c in got for i in c) == list(range(len(pts)))
        assert all(a[i] < a[j] and b[i] < b[j] for c in got for i, j in zip(c, c[1:], strict=False))
        # the best chain's score equals the quadratic program's
        f = []
        for i in range(len(pts)):
            f.append(8 + max([0.0] + [f[j] - 0.05 * (a[i] - a[j] + b[i] - b[j]) for j in range(i) if a[j] < a[i] and b[j] < b[i]]))
        c = got[0]
        assert 8 * len(c) - 0.05 * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]]) == pytest.approx(max(f))


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_words(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    r = random.Random(block)
    texts = ["".join(r.choice("ab \n\té") for _ in range(r.randint(0, 30))) for _ in range(2000)] + [None, "", "x" * 500, "y" * 100 + " z"]
    seen = {}
    for i, j, buffer, offsets in words.slices(pa.array(texts, pa.string())):
        w = words.words_of(buffer, offsets)
        for t, lo, hi in zip(texts[i:j], w.first, w.first[1:], strict=False):
            raw = (t or "").encode()
            want = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0d]+", raw)]
            assert list(zip(w.start[lo:hi], w.end[lo:hi], strict=True)) == want
            for (s, e), h in zip(want, w.hash[lo:hi], strict=True):
                assert seen.setdefault(raw[s:e], h) == h
    assert len(set(seen.values())) == len(seen)


def spans_of(got):
    return sorted((x["doc_id"], x["other_doc_id"], x["n_words"]) for x in got)


def test_all_passages_of_a_pair_are_found(spark):
    r = random.Random(11)
    one, two, three = passage(r, 60), passage(r, 70), passage(r, 80)
    apart = lambda *n: sum(([*passage(r, k), *p] for k, p in zip(n, (one, two, three), strict=True)), [])
    docs = {1: apart(40, 100, 150), 2: apart(90, 110, 0), 3: [*three, *passage(r, 30), *one, *passage(r, 400), *two]}
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = spans_of(substring.shared_passages(df).collect())
    assert got == sorted([*((2, 1, n) for n in (60, 70, 80)), *((3, 1, n) for n in (60, 70, 80))])


def test_fuzzy_passages_are_proposed_and_accepted(spark):
    r = random.Random(13)
    cases = [(n, part) for n in (60, 80, 100) for part in (0.1, 0.15, 0.2, 0.23) for _ in range(12)]
    rows, want = [], {}
    for c, (n, part) in enumerate(cases):
        here = passage(r, n)
        worn = list(here)
        for i in r.sample(range(1, n - 1), int(n * part)):
            worn[i] = f"x{c}.{i}"
        # of words compared place by place, n - int(n * part) agree: 77% or more
        for k, words_ in ((c, here), (1000 + c, worn)):
            rows.append((k, " ".join([*passage(r, 80), *words_, *passage(r, 90)])))
        want[1000 + c] = part
    got = {x["doc_id"] for x in substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["other_doc_id"] == x["doc_id"] - 1000}
    found = {p: sum(k in got for k, q in want.items() if q == p) / 36 for p in set(want.values())}
    assert got <= set(want) and all(found[p] >= least for p, least in ((0.1, 1.0), (0.15, 1.0), (0.2, 0.95), (0.23, 0.9))), found


def test_what_may_share_refutes_has_no_passage():
    r = random.Random(17)
    table = np.zeros(1 << 16, bool)
    kept = 0
    for _ in range(300):
        n, part = r.randint(40, 90), r.uniform(0.05, 0.5)
        x = np.array([r.getrandbits(62) for _ in range(n)], np.uint64)
        y = x.copy()
        for i in r.sample(range(n), int(n * part)):
            y[i] = r.getrandbits(62)
        if substring.compare(x, y, 50, 0.75):
            kept += 1
            assert substring.may_share(x, y, table, 50, 0.75)
    assert kept > 30 and not table.any()


def test_repeats_within_a_passage_and_lines_of_other_documents(spark):
    r = random.Random(19)
    docs = {}
    for c, (n, period) in enumerate([(60, 10), (100, 10), (60, 15), (200, 1)] * 5):
        slogan = (passage(r, period) * n)[:n]
        for k in (c, 100 + c):
            docs[k] = [*passage(r, 70), *slogan, *passage(r, 60)]
    for c in range(20):  # two lines of 30 words, each also alone in earlier documents
        lines = [passage(r, 30) for _ in range(2)]
        for k, some in ((200, lines[:1]), (300, lines[1:]), (400, lines), (500, lines)):
            docs[k + c] = [*passage(r, 60), *sum(some, []), *passage(r, 60)]
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    got = {(x["doc_id"], x["other_doc_id"]): x for x in substring.shared_passages(df).collect()}
    assert set(got) == {(100 + c, c) for c in range(20)} | {(500 + c, 400 + c) for c in range(20)}
    assert all(x["n_words"] == (60 if d >= 500 else (60, 100, 60, 200)[(d - 100) % 4]) for (d, _), x in got.items())


def test_passages_that_earlier_documents_quote_in_part(spark):
    r = random.Random(12)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, want, at = [], set(), 0
    for _ in range(15):
        p = new(52)
        for s in (0, 16, 32):  # earlier documents that quote 20 of its words
            rows.append((at, " ".join(new(30) + p[s : s + 20] + new(30))))
            at += 1
        rows += [(at, " ".join(new(40) + p + new(40))), (at + 1, " ".join(new(25) + p + new(60)))]
        want.add((at + 1, at))
        at += 2
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["other_doc_id"]) for x in found} == want


def test_passages_whose_seeds_all_stand_in_lesser_earlier_ones(spark):
    """Every seed of a passage of 60 words stands, in like surroundings, in earlier documents that share 40 of its words."""
    r = random.Random(17)
    new = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    rows, want, at = [], set(), 0
    for _ in range(20):
        p = new(60)
        for part in (p[:40], p[20:], p[10:50]):
            rows.append((at, " ".join(new(30) + part + new(30))))
            at += 1
        rows += [(at, " ".join(new(40) + p + new(40))), (at + 1, " ".join(new(25) + p + new(60)))]
        want.add((at + 1, at))
        at += 2
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(x["doc_id"], x["other_doc_id"]) for x in found} == want and all(x["n_words"] == 60 for x in found)


def test_linked_equals_brute_force():
    r = np.random.default_rng(4)
    h = np.sort(r.integers(0, 40, 900))
    doc = np.concatenate([np.sort(r.integers(0, 300, n)) for n in np.bincount(h)])
    about = r.integers(0, 1 << 63, (900, 2)).astype(np.uint64) & r.integers(0, 1 << 63, (900, 2)).astype(np.uint64)
    want = set()
    for i in range(900):
        like = [(-int(substring.alike(about[i : i + 1], about[j : j + 1])[0]), j) for j in range(i) if h[j] == h[i] and doc[j] != doc[i]]
        like = [x for x in like if x[0] <= 0]
        want |= {(doc[i], doc[min(j for _, j in like)]), (doc[i], doc[min(like)[1]])} if like else set()
    assert len(want) > 50 and set(zip(*(x.tolist() for x in substring.linked(h, doc, about)), strict=True)) == want


def test_hot_seeds_give_the_same_links(spark, monkeypatch):
    r = random.Random(13)
    line = " ".join(f"l{i}" for i in range(60))
    rows = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(40)) + " " + line) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    links = lambda: sorted((x["doc_id"], x["other_doc_id"], x["n_words"]) for x in substring.shared_passages(df).collect())
    usual = links()
    assert usual == [(i, 0, 60) for i in range(1, 400)]
    monkeypatch.setattr(substring, "SAMPLE", 4)
    monkeypatch.setattr(substring, "HOT", 1 / 4096)
    assert links() == usual


def test_surroundings_keep_both_sides():
    text = " ".join(f"a{i}" for i in range(60)).encode()
    w = words.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    got = substring.contexts(w, np.array([0, 21, 22, 33, 34]), 5)
    low, high = got & np.uint64(0xFFFFFFFF), got >> np.uint64(32)
    assert (low > 0).tolist() == [False, False, True, True, True] and (high > 0).tolist() == [True, True, True, True, False]


def agreements(x, y, k):
    """All (word of x, word of y, words) of k agreeing words or more that go on in neither direction."""
    out = set()
    for i in range(len(x)):
        for j in range(len(y)):
            if x[i] == y[j] and (not i or not j or x[i - 1] != y[j - 1]):
                n = 0
                while i + n < len(x) and j + n < len(y) and x[i + n] == y[j + n]:
                    n += 1
                if n >= k:
                    out.add((i, j, n))
    return out


def test_anchors_are_all_places_that_agree():
    r = random.Random(23)
    for words_, n in ((2, 40), (3, 90), (40, 200), (1, 30)):
        for _ in range(20):
            x, y = (words._block(np.frombuffer(" ".join(f"v{r.randrange(words_)}" for _ in range(n + r.randrange(9))).encode(), np.uint8))[2] for _ in "xy")
            want = agreements(x.tolist(), y.tolist(), 5)
            got = {tuple(a) for a in substring.anchors(x, y, step=10**6, often=0, alone=10**6).tolist() if a[2] >= 5}
            assert {(i, j, m) for i, j, m in got if (i, j, m) in want} == want
            assert all((i, j, m) in want or any(a <= i and i - a == j - b and i + m == a + c for a, b, c in want) for i, j, m in got)


def test_lines_that_stand_often_are_compared_at_all_places():
    """Twenty lines of six words, each twenty times in both texts: the passage holds them in an order of its own."""
    r = random.Random(29)
    for _ in range(10):
        lines = [[r.getrandbits(62) for _ in range(6)] for _ in range(20)]
        fill = lambda: [r.getrandbits(62) for _ in range(40)]
        here = lambda some: [w for line in some for w in [*line, r.getrandbits(62)]]
        loose = lambda: [w for line in r.sample(lines * 20, 400) for w in [*line, *fill()]]
        some = r.sample(lines, 10)
        a, b = loose(), loose()
        x = np.array([*a, *fill(), *here(some), *fill()], np.uint64)
        y = np.array([*b[:4600], *fill(), *here(some), *fill(), *b[4600:]], np.uint64)
        at = len(a) + 40
        assert any(i0 <= at and i1 >= at + 69 and j0 <= 4640 and j1 >= 4709 for i0, i1, j0, j1, _ in substring.compare(x, y, 50, 0.75))


def test_passages_without_five_agreeing_words_in_a_row():
    r = random.Random(31)
    new = lambda n: [r.getrandbits(62) for _ in range(n)]
    for every in (4, 5):
        for n in (60, 100, 200):
            p = new(n)
            worn = [w if (i + 1) % every else new(1)[0] for i, w in enumerate(p)]
            x, y = (np.array([*new(70), *some, *new(90)], np.uint64) for some in (p, worn))
            got = substring.compare(x, y, 50, 0.75)
            assert len(got) == 1 and got[0][0] == 70 and got[0][1] == 70 + n - (n % every == 0), (every, n, got)


def test_repeats_at_every_shift_are_told_once(spark):
    """A line that a text repeats is told by few rows, which hold all its words in both texts."""
    r = random.Random(37)
    line = passage(r, 3)
    rows = [(0, " ".join([*passage(r, 40), *line * 30, *passage(r, 40)])), (1, " ".join([*passage(r, 70), *line * 400, *passage(r, 20)]))]
    found = substring.shared_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert 14 <= len(found) <= 40 and all(x["n_words"] >= 50 for x in found)
    for k, start, end, first, n in ((1, "start", "end", 70, 1200), (0, "other_start", "other_end", 40, 90)):
        at = {i for x in found for i in range(x[start], x[end])}
        words_ = rows[k][1].split()
        lo = len(" ".join(words_[:first])) + 1
        line_bytes = set(range(lo, lo + len(" ".join(words_[first : first + n]))))
        spaces = {i for i in line_bytes if rows[k][1][i] == " "}
        assert line_bytes - spaces <= at <= line_bytes


def test_covering_holds_all_words_of_both():
    r = random.Random(41)
    for _ in range(200):
        rows = [(i, i + r.randint(1, 20), j, j + r.randint(1, 20), 1) for i, j in ((r.randrange(60), r.randrange(60)) for _ in range(r.randint(0, 25)))]
        got = substring.covering(rows)
        for s, e in ((0, 1), (2, 3)):
            assert {k for x in got for k in range(x[s], x[e])} == {k for x in rows for k in range(x[s], x[e])}
        assert set(got) <= set(rows)


def test_what_agrees_as_it_stands_needs_no_broken_anchors(monkeypatch):
    r = random.Random(43)
    new = lambda n: [r.getrandbits(62) for _ in range(n)]
    calls = []
    broken = substring.broken
    monkeypatch.setattr(substring, "broken", lambda x, y: calls.append(1) or broken(x, y))
    p, q = new(300), new(100)
    worn = [w if (i + 1) % 4 else new(1)[0] for i, w in enumerate(q)]
    x, y = (np.array([*new(70), *p, *new(90)], np.uint64) for _ in "xy")
    assert [g[:2] for g in substring.compare(x, y, 50, 0.75)] == [(70, 370)] and not calls
    # beside it, one without five agreeing words in a row
    x, y = (np.array([*new(70), *p, *new(90), *some, *new(30)], np.uint64) for some in (q, worn))
    assert [g[:2] for g in substring.compare(x, y, 50, 0.75)] == [(70, 370), (460, 559)] and calls


def test_chains_that_end_where_they_begin_are_passed_over_only(monkeypatch):
    """compare() gives the same whether or not short chains are passed over."""
    r = random.Random(47)
    for _ in range(60):
        lines = [[r.getrandbits(62) for _ in range(r.randint(3, 12))] for _ in range(12)]
        x, y = (np.array([w for _ in range(40) for w in (*r.choice(lines), *(r.getrandbits(62) for _ in range(r.choice((0, 1, 2, 9, 40)))))], np.uint64) for _ in "xy")
        got = substring.compare(x, y, 50, 0.75)
        with monkeypatch.context() as m:
            m.setattr(substring, "_goes_on", lambda x, y, x3, y3, first, last, n: np.ones(len(first), bool))
            assert substring.compare(x, y, 50, 0.75) == got


def test_later_pairs_of_a_text_told_whole_are_not_compared(spark, monkeypatch):
    r = random.Random(53)
    p, q = passage(r, 80), passage(r, 60)
    texts = {0: p, 1: [*p, *q], 2: p, 3: [*q, *p], 4: p}
    raw = {k: " ".join(v).encode() for k, v in texts.items()}
    codec = pa.Codec("zstd")
    pairs = [(2, 0), (2, 1), (4, 1), (4, 2), (4, 3)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [a for a, _ in pairs], "other": [b for _, b in pairs], **{f"{n}": [codec.compress(raw[x[i]], asbytes=True) for x in pairs] for i, n in enumerate("ab")}, **{f"{n}_size": [len(raw[x[i]]) for x in pairs] for i, n in enumerate("ab")}})
    calls, compare = [], substring.compare
    monkeypatch.setattr(substring, "compare", lambda *a: calls.append(1) or compare(*a))
    told = set()
    got = [substring._compared(b, 50, 0.75, told) for b in (batch.slice(0, 3), batch.slice(3))]
    assert len(calls) == 2 and [(d, o) for g in got for d, o in zip(g["doc_id"], g["other_doc_id"], strict=True)] == [(2, 0), (4, 1)]


def test_surroundings_of_many_words_rarely_share_bits_by_chance():
    """Of 64 bits a side, two sides of 22 words without a common one share 11 in one case of hundreds; of 128, in hardly any."""
    text = " ".join(f"c{i}" for i in range(60000)).encode()
    w = words.words_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    about = substring.surroundings(w, np.arange(30, 59900, 50), 5)
    score = np.concatenate([substring.alike(about[k:], about[: len(about) - k]) for k in range(1, 40)])
    assert (score >= 0).mean() < 0.001 and (substring.alike(about, about) == 200).all()
    none = np.zeros((0, about.shape[1]), np.uint64)
    assert len(substring.alike(none, none)) == 0 and len(substring.linked(none[:, 0], none[:, 0].view(np.int64), none)[0]) == 0


@pytest.mark.parametrize("known", [0, substring.KNOWN])
def test_copies_link_once_by_their_texts(spark, monkeypatch, known):
    """Not by each of their seeds: a copy's link came as often as it has seeds in other tasks, which grew faster than the table."""
    r = random.Random(61)
    p, q = passage(r, 80), passage(r, 70)
    text = " ".join([*p, *passage(r, 30), *q])
    rows = [(1, " ".join([*passage(r, 40), *p])), (2, " ".join([*q, *passage(r, 40)])), *((i, text) for i in range(5, 30))]
    rows += [(40, text), (40, " ".join(passage(r, 20))), *((i, "few words") for i in range(50, 60)), *((i, text + " ") for i in (60, 61))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seeded, linked = [], substring._linked
    monkeypatch.setattr(substring, "_linked", lambda src, seed: linked(seeded.append(src) or src, seed))
    monkeypatch.setattr(substring, "KNOWN", known)
    got = [x for x in spans_of(substring.shared_passages(df).collect()) if x[0] != 40]
    assert {x["doc_id"] for x in seeded[0].collect()} == {1, 2, 5, 40, *range(50, 60), 60}
    parts = [(1, 80), (2, 70)]
    assert got == sorted([(i, o, n) for i in (*range(5, 30), 60, 61) for o, n in (*parts, *([(5, 180)] if i > 5 else []))])


def test_anchors_that_all_rise_chain_as_others_do():
    r = random.Random(67)
    for _ in range(200):
        n = r.randint(1, 40)
        a, b = (np.cumsum([r.choice((1, 3, 16, 90, 400)) for _ in range(n)]) for _ in range(2))
        # one anchor more, out of order and far away, so that it's in no other's chain
        want = substring.chains(np.r_[a, a[-1] + 10**6], np.r_[b, 0], 5)
        assert substring.chains(a, b, 5) == [x for x in want if x != [n]]
