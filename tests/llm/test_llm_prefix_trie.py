import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from quernel.llm import prefix_trie as T

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All nodes, from dictionaries of whole texts."""
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            r, t = r or "", t or ""
            code = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((n is not None, n or 0, code, len(t.encode()), (r, t)))
    own = {c: [x[4] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h] + v[h:])
    members = {}
    for c, v in made.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        got = [below(k) for k in kids.get(p, [])]
        size = len(p[-1][1].encode()) if p else 0
        return sum(g[0] for g in got) or 1, sum(g[1] for g in got) + (len(members[p]) - 1) * size

    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(made[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *below(p), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in T.conversation_nodes(df).collect())


def random_rows(seed, n, turns=4, words=2):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, turns + 9 * (c % 17 == 0))):
            rows.append((c, r.choice([None, t, t]), r.choice(["user", None, ""]), r.choice(["é", "", None, "x" * r.randrange(1, 4)][:words + 1])))
    return rows + rows[:5] + [(None, 1, "user", "lost")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(T, "RANGE_ROWS", 3)
    monkeypatch.setattr(T, "RUN_BYTES", 700)
    rows = random_rows(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "run", "pos", "span", "node", "own", "h", "base", "code")}).repartition(3)
    monkeypatch.setattr(T, "FEW_NODES", 100_000 if seed == 1 else 0)
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        assert got(df) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_many_copies_spread_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(T, "RANGE_ROWS", 8)
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(60) for t in range(3)] + [(5 * c + 1, 0, "user", "turn 0") for c in range(9)]
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_empty_and_one(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    one = [(3, None, None, None)]
    assert got(spark.createDataFrame(one, SCHEMA)) == brute(one)


def test_long_conversations_and_texts(spark):
    rows = [(c, t, "user", "w" * 30000 if t == 7 else str(t // (c + 1))) for c in range(3) for t in range(250)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute_flat(rows)


def brute_flat(rows):
    import sys

    sys.setrecursionlimit(10000)
    return brute(rows)


def test_merge_shares_and_orders():
    r = random.Random(9)
    key = lambda: b"".join(bytes([r.randrange(3)]) * T.TURN for _ in range(r.randrange(6)))
    for k in (1, 2, 3, 5, 8):
        runs = [[(key(), r.randrange(5)) for _ in range(r.randrange(0, 30))] for _ in range(k)]
        out = list(T.merged([T.sorted_run(x) for x in runs]))
        want = sorted(e for x in runs for e in x)
        assert [(a, c) for _, a, c in out] == want
        assert [n for n, _, _ in out] == [T.shared_turns(want[i - 1][0] if i else b"", want[i][0]) for i in range(len(want))]


def test_merge_compares_shared_turns_once(monkeypatch):
    """Each comparison begins where what is shared with the last output ends."""
    looked = []
    plain = T.shared_turns
    monkeypatch.setattr(T, "shared_turns", lambda a, b, start=0: looked.append(plain(a, b, start) - start + 1) or plain(a, b, start))
    same = b"\1" * T.TURN * 500
    runs = [[(0 if i == 0 else 500, same + bytes([i * 8 + j]) * T.TURN, 0) for i in range(20)] for j in range(8)]
    out = list(T.merged(runs))
    assert len(out) == 160 and sum(looked) < 500 * 8 + 160 * 3 * 3


def test_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    cur = c.sql(T.ORACLE)
    at = [cur.columns.index(n) for n in T.NODES]
    df = T.conversation_nodes(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert df.columns == list(T.NODES)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    mine = sorted(repr(tuple(r)) for r in df.collect())
    assert mine == brute(rows)
    assert mine == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())
