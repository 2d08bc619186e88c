import hashlib
import html
import random
import struct
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernel.llm import html_extract, media, mixing, packing, quality, sharding, token_counts, topk

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "a", "a", "x" * 5000, "  two  spaces ", "tab\tline\nend", "<s> <|endoftext|> </s>", "é 日本語 🎉 ▁a", "\x00 z", "0123456789" * 30]


def documents(spark, extra=""):
    rows = [(i, t, "src" if i % 3 else None) for i, t in enumerate(ODD)] + [(3, "a", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("length", "start", "ids", "size", "shard", "h", "stats", "media", "bucket")})


def real(spark, table="documents"):
    return spark.read.parquet(f"{SF}/{table}.parquet")


def empty(spark):
    return documents(spark).limit(0)


# --- 1 packing


def check_packing(rows, texts):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: [*t.encode(x or "", add_special_tokens=False).ids, 1] for k, x in texts.items()}
    by_doc = {}
    for r in rows:
        a = ids[r["doc_id"]]
        piece = a[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(a) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece)) and len(piece) == r["length"] > 0
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for k, pieces in by_doc.items():
        n = sum(p[1] for p in pieces)
        assert n % len(ids[k]) == 0 and {s for s, _ in pieces} == set(range(0, len(ids[k]), 2048))
    seq = {}
    for r in rows:
        seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(seq) == list(range(len(seq)))
    return seq


def test_packing_odd_texts(spark):
    rows = packing.pack_documents(documents(spark)).collect()
    check_packing(rows, dict(enumerate(ODD)))
    assert len(rows) == len(ODD) + 1 + 0 and packing.pack_documents(empty(spark)).count() == 0


def test_packing_real_texts_with_little_padding(spark):
    d = real(spark)
    rows = packing.pack_documents(d, keep_ids=False).collect()
    seq = check_packing(rows, {r["doc_id"]: r["text"] for r in d.collect()})
    total = sum(r["length"] for r in rows)
    assert len(seq) * 2048 / total < 1.03


def test_patterns_place_everything():
    r = random.Random(4)
    for _ in range(30):
        cap = r.choice([8, 64, 2048])
        counts = {r.randint(1, cap): r.choice([1, 2, 7, 5000]) for _ in range(r.randint(1, 40))}
        placed = {}
        for packs, runs in packing.spf_patterns(counts, cap):
            assert packs > 0 and sum(n * k for n, k in runs) <= cap
            for n, k in runs:
                placed[n] = placed.get(n, 0) + packs * k
        assert placed == counts
    one = packing.spf_patterns({100: 10**6}, 2048)
    assert sum(p for p, _ in one) == 50_000  # one hot length fills its sequences


# --- 2 token counts


def test_counts_equal_the_library(spark):
    import public_tokenizers as P
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(0)
    texts = ODD + ["".join(r.choice("ab etho ing  \n.,▁é0") for _ in range(r.randint(0, 60))) for _ in range(500)]
    machine = token_counts.transducer(P.path("piece_bpe_32k.model"))
    want = [len(sp.encode(t or "")) for t in texts]
    for chunk in (3, 17, 1 << 15):
        assert [machine.count(t or "", chunk) for t in texts] == want
    got = token_counts.count_tokens(documents(spark), limit=100).collect()
    assert all((x["n_tokens"], x["n_bytes"], x["over_limit"]) == (want[x["doc_id"]], len((ODD[x["doc_id"]] or "").encode()), want[x["doc_id"]] > 100) for x in got)
    assert token_counts.count_tokens(empty(spark)).count() == 0


def test_state_maps_compose_associatively():
    m = token_counts.CountTransducer({"▁": 5, "a": 9, "b": 9, "ab": 1, "▁a": 2, "ba": 3, "▁ab": 4, "aa": 6})
    parts = [m.chunk_map(x) for x in (" a", "ba b", "b", "aab ", " a", "")]
    left = parts[0]
    for p in parts[1:]:
        left = m.compose(left, p)
    right = parts[-1]
    for p in parts[-2::-1]:
        right = m.compose(p, right)
    assert left == right == m.scan(parts)


# --- 3 pages


def test_pages_equal_their_articles(spark):
    import re

    got = {r["page_id"]: r for r in html_extract.extract_text(real(spark, "pages").withColumn("text", F.lit(1))).collect()}
    for p in real(spark, "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", p["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article)]
        want = " ".join(x for x in parts if x)
        assert got[p["page_id"]]["text"] == want and got[p["page_id"]]["n_chars"] == len(want)


def test_host_boilerplate_without_markup(spark):
    nav = "Home About Contact Terms Privacy Imprint Help Jobs More"
    rows = [(i, "http://h.example/x", f"<div><div>{nav}</div><div>unique words of page {i} are w{i} x{i}</div></div>") for i in range(12)]
    rows += [(50, None, None), (51, "junk", ""), (52, "http://one.example", "<p>only page &lt;b&gt; here<p cla"), (53, "http://one.example", "<article><p>a<nav>menu</nav>b</p><div class='reader-comments'>c</div></article><footer>f</footer>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{i} are w{i} x{i}" or got[i] == f"unique words of page {i} are w{i} x{i}" for i in range(12))
    assert (got[50], got[51], got[52], got[53]) == ("", "", "only page <b> here", "a b")


def test_suffix_ranks():
    r = random.Random(2)
    s = [r.randrange(3) for _ in range(200)]
    rank = html_extract.suffix_ranks(np.array(s), 8)
    keys = [tuple(s[i : i + 8]) for i in range(200)]
    order = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert len(set(rank)) == len(order) and [k for _, k in sorted(zip(rank, keys, strict=True))] == sorted(keys)


# --- 4 sharding


def test_minimax_equals_brute_force():
    import functools

    r = random.Random(9)
    for _ in range(100):
        s = [r.choice([0, 1, 5, r.randint(0, 50)]) for _ in range(r.randint(1, 9))]
        k = r.randint(1, 4)

        @functools.cache
        def best(i, k, s=tuple(s)):
            return 0 if i == len(s) else 1e9 if not k else min(max(sum(s[i:j]), best(j, k - 1)) for j in range(i + 1, len(s) + 1))

        cap, cuts = sharding.minimax_cuts(np.array(s), k)
        edges = [0, *cuts, len(s)]
        assert cap == best(0, k) and len(cuts) < k and max(sum(s[a:b]) for a, b in zip(edges, edges[1:], strict=False)) <= cap


def test_capacity_is_the_smallest_over_groups(spark):
    r = random.Random(11)
    for n, hot in ((400, 0), (400, 3000), (3, 0)):
        rows = [(r.randrange(1 << 62) if i % 5 else (i // 50) << 40, r.choice([1, 10, 500, r.randint(1, 2000)])) for i in range(n)] + [(1 << 61, hot)] * 2
        groups = {}
        for p, s in rows:
            groups[p] = groups.get(p, 0) + s
        order = sorted(groups)
        want, _ = sharding.minimax_cuts(np.array([groups[p] for p in order]), 16)
        for atoms in (4, 1 << 16):
            starts = sharding.shard_starts(spark.createDataFrame(rows, "_place long, size long"), 16, atoms)
            sums = {}
            for p in order:
                k = sum(p >= c for c in starts)
                sums[k] = sums.get(k, 0) + groups[p]
            assert max(sums.values()) == want and len(starts) <= 15


def test_shards(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0
    for df in (documents(spark), real(spark)):
        rows = sharding.shard_documents(df).collect()
        assert len(rows) == df.count()
        text, shards, slots = {}, {}, {}
        for x in df.select("doc_id", "text").collect():
            text[x[0]] = x[1]
        for r in rows:
            raw = (text[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
            assert shards.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(slots) <= 15


# --- 5 mixing


@pytest.mark.parametrize("which", ["odd", "real"])
def test_mix_equals_sql(spark, which):
    df = documents(spark) if which == "odd" else real(spark)
    got = mixing.mix_documents(df).toPandas()
    c = duckdb.connect()
    documents_ = df.select("doc_id", "text", "source").toPandas()  # noqa: F841
    c.sql("create table documents as select * from documents_")
    want = c.sql(mixing.ORACLE).df()
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    a, b = (x[cols].drop_duplicates().sort_values(cols).reset_index(drop=True).astype(float) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
    assert (got["taken"] <= 2 * got["size"]).all()
    if which == "real":
        s = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
        assert (abs(s["taken"] - s["target"]) <= s["most"]).all()


def test_mix_of_nothing(spark):
    assert mixing.mix_documents(empty(spark)).count() == 0


# --- 6 media


def test_media_round_trip(spark):
    got = {r["doc_id"]: r for r in media.digests(documents(spark)).collect()}
    stored = {r["doc_id"]: bytes(r["media"]) for r in media.to_media(documents(spark)).collect()}
    for k, t in enumerate(ODD):
        raw = (t or "").encode()
        padded = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored[k]), hashlib.sha256(stored[k]).hexdigest())
        fps, frames = media.read_avi(stored[k])
        assert fps == 25 and media.decode_frames(frames).tobytes() == padded
    assert media.digests(empty(spark)).count() == 0


def test_shots_at_scene_changes(spark):
    r = np.random.default_rng(0)
    scenes = [np.clip(r.normal(m, 10, (n, 576)), 0, 255).astype(np.uint8) for m, n in ((40, 30), (200, 25), (90, 45))]
    assert media.shots(np.concatenate(scenes)) == [(0, 30), (30, 55), (55, 100)]
    avi = media.write_avi(media.encode_frames(np.concatenate(scenes)))
    clips = media.clip_rows(spark.createDataFrame([(1, bytearray(avi))], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(c["start_s"], c["end_s"]) for c in clips] == [(0, 1.2), (1.2, 2.2), (2.2, 4.0)]


# --- 9 search


def test_topk_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(i, [round(r.uniform(-2, 2), 2) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [1.0] * 6) for i in range(40)] + [(500, None), (501, [1.0, None]), (520, [float("nan")] * 6), (540, [float("inf")] + [0.0] * 5), (560, [9.0, 9.0])]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, g int")
    q = {k: np.append(np.floor(64 * np.array(v, np.float32).astype(float)), [0] * (6 - len(v))).astype(int) for k, v in rows if v is not None and None not in v and np.isfinite(v).all()}
    want = set()
    for a in q:
        if a % 20 == 0:
            best = sorted(((-int(q[a] @ q[b]), b) for b in q if b != a))[:20]
            want |= {(a, i + 1, b, -s) for i, (s, b) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want
    few = topk.top_k(df.where("vec_id < 5")).collect()
    assert len(few) == 4 and topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [30, 700])
def test_nra_stops_early_and_stays_exact(n):
    r = np.random.default_rng(n)
    x = np.round(r.standard_exponential((n, 3)) ** 3 * 10)
    q = np.round(r.normal(size=(9, 3)) * 5)
    got = topk.nra_topk(q, np.arange(9) + 10**6, x, np.arange(n), 4)
    want = [(10**6 + i, j, int(q[i] @ x[j])) for i in range(9) for j in sorted(range(n), key=lambda j: (-(q[i] @ x[j]), j))[:4]]
    assert list(zip(*(a.tolist() for a in got), strict=True)) == want


# --- 10 quality


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~held))
    p = quality.score(docs.join(labels.where(held), "doc_id"), model).join(labels, "doc_id").toPandas()
    good = (p["quality"] == 1) & (p["toxic"] == 0)
    assert p[good]["kept"].mean() > 0.98 and p[~good]["kept"].mean() < 0.15


def test_classifier_odd_cases(spark):
    d = documents(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(999, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    assert set(got) == set(range(len(ODD))) and not got[0]["kept"] and not got[1]["kept"] and not got[2]["kept"]
    one = quality.classify(d, labels.where("quality = 1")).collect()
    assert all(r["kept"] == (r["doc_id"] not in (0, 1, 2)) for r in one)
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.classify(d, labels.limit(0)).count() == len(ODD) + 1


def test_boilerplate_runs_equal_brute_force():
    r = random.Random(8)
    for n in (1, 2, 12, 150):
        common = [[f"c{r.randrange(40)}" for _ in range(r.choice([2, 5, 8, 12, 20]))] for _ in range(6)]
        pages = [[r.choice(common) if r.random() < 0.4 else [f"u{r.randrange(10**9)}" for _ in range(r.randint(1, 15))] for _ in range(r.randint(0, 6))] for _ in range(n)]
        runs: dict[tuple, set] = {}
        cut = lambda b: [tuple(b)] if len(b) < 8 else [tuple(b[i : i + 8]) for i in range(len(b) - 7)]
        for p in pages:  # copies of a page are one
            for b in p:
                for x in cut(b):
                    runs.setdefault(x, set()).add(repr(p))
        least = max(3, int(0.1 * len(set(map(repr, pages)))))
        for p, got in zip(pages, html_extract.repeated(pages, 8, 0.1), strict=True):
            for b, covered in zip(p, got, strict=True):
                want = [False] * len(b)
                for i, x in enumerate(cut(b)):
                    if len(runs[x]) >= least:
                        want[i : i + len(x)] = [True] * len(x)
                assert covered.tolist() == want


def test_a_query_id_asks_once_and_blocks_share_bounds(spark, monkeypatch):
    r = np.random.default_rng(3)
    v = r.normal(size=(90, 5))
    rows = [(i % 60, v[i % 80].tolist()) for i in range(90)]  # repeated ids, some with the same vector
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    q = np.floor(64 * np.array([x for _, x in rows]))
    want = set()
    for a in (0, 20, 40):
        one = np.floor(64 * np.array(min(x for i, x in rows if i == a)))
        best = sorted((-int(one @ q[j]), rows[j][0]) for j in range(90) if rows[j][0] != a)[:20]
        want |= {(a, k + 1, b, -s) for k, (s, b) in enumerate(best)}
    assert {tuple(x) for x in topk.top_k(df).collect()} == want
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 16)
    assert {tuple(x) for x in topk.top_k(df).collect()} == want


def test_classifier_pool_gives_the_surest_rows(spark):
    n = np.zeros(3001, np.int64)
    n[[2990, 2950, 2900, 1000]] = 5, 10, 50, 500
    least = quality.thresholds({("text", 1): n}, 565, 0.5, 0.1, 0.95)["text", 1]
    assert least == (2900, pytest.approx((0.1 * 565 * 0.5 - 15) / 50))
    assert quality.thresholds({("text", 1): n}, 565, 1.0, 1.0, 0.95)["text", 1][0] > 1000  # none less sure than 0.95


def test_summed_fit_equals_a_fit_of_all_rows():
    r = np.random.default_rng(5)
    x, w = r.normal(size=(400, 4)), np.array([1.0, -2.0, 0.5, 0.0])
    y = (r.random(400) < 1 / (1 + np.exp(-x @ w))).astype(float)
    whole = quality.fit_logistic(x, y, l2=1.0, steps=50)
    parts = quality.fit_logistic(x[:100], y[:100], l2=1.0, steps=50, more=lambda v: tuple(sum(s) for s in zip(*(quality.curvature(x[i : i + 100], y[i : i + 100], v, 0.0, 1.0) for i in (100, 200, 300)), strict=True)))
    assert np.allclose(whole, parts, atol=1e-4)


def test_copies_of_a_page_keep_their_text(spark):
    copy = "<div><p>one two three four five six seven eight nine ten</p><p>short</p></div>"
    other = lambda i: f"<div><p>all pages of the host say just this again and again</p><p>{' '.join(f'w{i}x{j}' for j in range(12))}</p></div>"
    for n in (0, 17, 300):
        rows = [(i, "http://h/x", copy) for i in range(3)] + [(10 + i, "http://h/y", other(i)) for i in range(n)]
        got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert {got[i] for i in range(3)} == {"one two three four five six seven eight nine ten short"}
        assert all(got[10 + i] == " ".join(f"w{i}x{j}" for j in range(12)) for i in range(n))
    assert html_extract.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_boilerplate_is_counted_over_the_whole_host(spark):
    """Brute force over a host of many groups: pages with lines that 9, 10 or 50% of them hold, copies, an empty page, an article."""
    r = random.Random(4)

    def blocks(i):
        own = " ".join(f"w{i}x{j}" for j in range(r.choice([3, 12])))
        lines = [x for x, p in (("about nine in a hundred pages of this host say so", 0.09), ("ten in a hundred", 0.11), ("half of all the pages of this one host have it too", 0.5)) if r.random() < p]
        return [*lines, own, *(["here and there " + own + " half of all the pages of this one host"] if i % 7 == 0 else [])]

    pages = {i: blocks(i) for i in range(700)}
    pages |= {1000 + i: pages[5] for i in range(400)} | {2000: [], 2001: blocks(2001)}
    rows = [(i, "http://big/x", "".join(f"<p>{x}</p>" for x in p)) for i, p in pages.items()]
    rows[-1] = (2001, "http://big/x", f"<article>Main text</article>{rows[-1][2]}")
    cut = lambda b: [tuple(b)] if len(b) < 8 else [tuple(b[i : i + 8]) for i in range(len(b) - 7)]
    held: dict[tuple, set] = {}
    for p in pages.values():
        for b in p:
            for x in cut(b.split(" ")):
                held.setdefault(x, set()).add(repr(p))
    least = max(3, int(0.1 * len(set(map(repr, pages.values())))))
    want = {}
    for i, p in pages.items():
        left = []
        for b in p:
            words = b.split(" ")
            gone = [False] * len(words)
            for k, x in enumerate(cut(words)):
                if len(held[x]) >= least:
                    gone[k : k + len(x)] = [True] * len(x)
            left += [w for w, g in zip(words, gone, strict=True) if not g]
        want[i] = " ".join(left)
    want[2001] = "Main text"
    assert 3 < sum(len(v) >= least for v in held.values()) < 20
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (16, 256, 10_000):  # 45 groups, 3, and none
        assert {x["page_id"]: x["text"] for x in html_extract.extract_text(df, group=group).collect()} == want


def test_articles_lose_what_their_host_marks_as_boilerplate(spark):
    """Through the host's suffix array: a notice that leaks into articles goes; teasers, shared lines, short lines and copies stay."""
    notice = "we and our partners store cookies on your device to show adverts"
    teaser, line = (" ".join(f"{c}{j}" for j in range(11)) for c in "tl")
    short = "read this next"
    pages = []
    for i in range(60):
        own = " ".join(f"w{i}x{j}" for j in range(9))
        inside = [own, line, short] + ([notice + " today"] if i % 10 == 0 else []) + ([teaser] if i == 7 else [])
        around = f"<nav>{short}</nav><div>{teaser}</div>" + (f"<div class=notice>{notice}</div>" if i % 5 else "")
        pages.append((around, inside))
    pages += [(pages[7][0], pages[7][1])] * 5 + [(f"<p>{notice} n{i}</p>", [f"few say so {i}", "a quote of ten words in a row and no more"]) for i in range(4)]
    rows = [(i, "http://n.example/a", f"{a}<article>{''.join(f'<p>{x}</p>' for x in b)}</article>") for i, (a, b) in enumerate(pages)]
    rows += [(1000 + i, "http://other.example/a", f"<article><p>{notice}</p></article>") for i in range(5)]
    want = {i: " ".join(x.replace(notice + " ", "") for x in b) for i, (_, b) in enumerate(pages)} | {1000 + i: notice for i in range(5)}
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (8, 256):
        assert {x["page_id"]: x["text"] for x in html_extract.extract_text(df, group=group).collect()} == want


def test_repeated_rows_are_spread_over_cells(spark):
    same = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("equal words").alias("text"))
    got = sharding.shard_documents(same).groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["d"] == r["m"] + 1 for r in got) and sum(r["n"] for r in got) == 60_000
    packed = packing.pack_documents(same, keep_ids=False)
    assert "_row" not in packed.columns
    seq = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), (F.max("offset") + F.first("length")).alias("end"), F.count_distinct("offset").alias("d"), F.count("*").alias("k")).collect()
    assert sum(r["k"] for r in seq) == 60_000 and all(r["n"] == r["end"] <= 2048 and r["d"] == r["k"] for r in seq)
    cell = F.pmod(F.xxhash64(F.lit(None).cast("long"), F.lit(0), F.monotonically_increasing_id()), F.lit(64))
    assert max(r["count"] for r in same.repartition(4).groupBy(cell.alias("c")).count().collect()) < 1500


def test_labelled_rows_are_bounded_not_ids(spark, monkeypatch):
    seen = []
    plain = quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda packed, y, *a, **b: seen.append(len(y)) or plain(packed, y, *a, **b))
    one = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("text number "), "id").alias("text"))
    docs = one.union(spark.range(100, 200).select("id", F.concat(F.lit("other text "), "id")))
    labels = spark.range(100, 140).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic")).union(spark.createDataFrame([(7, 1, 0)], "doc_id long, quality int, toxic int"))
    assert quality.classify(docs, labels, max_labelled=100).count() == 20_100
    assert seen and seen[0] <= 100
