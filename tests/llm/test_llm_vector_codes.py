import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quernel.llm import vector_codes as V

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks' hash, by Python's whole numbers."""
    import math

    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts)
    v = [[math.floor(4096 * c) for c in r[1]] + [0] * (width * parts - len(r[1])) for r in kept]
    cut = lambda x, p: x[p * width : (p + 1) * width]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[cut(v[i], p) for i in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min((far(cut(x, p), e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        got = [[near(x, p)[1] for p in range(parts)] for x in v]
        new = []
        for p in range(parts):
            own = [[cut(x, p) for x, g in zip(v, got, strict=True) if g[p] == i] for i in range(len(first))]
            new.append([[sum(c) // len(o) for c in zip(*o, strict=True)] if o else e for o, e in zip(own, books[p], strict=True)])
        books = new
    ends = [[near(x, p) for p in range(parts)] for x in v]
    error = [sum(d for d, _ in e) for e in ends]
    by = {}
    for r, e in zip(kept, error, strict=True):
        by[r[2]] = by.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((repr(r[0]), "".join(f"{i:02x}" for _, i in e), x, by[r[2]]) for r, e, x in zip(kept, ends, error, strict=True)), sha


def got(df):
    rows = V.codes(df).collect()
    assert len({r["codebooks_sha256"] for r in rows}) <= 1
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in rows), rows[0]["codebooks_sha256"] if rows else None


def test_equals_brute_force_on_odd_rows(spark):
    r = random.Random(3)
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(round(r.gauss(0, 1), 3)) for _ in range(16)], r.choice([0, 1, None])) for i in range(90)]
    rows += [(5, None, 1), (6, [nan] * 16, 1), (7, [inf] * 16, 1), (8, [None] * 16, 0), (None, [0.25] * 16, 2), (3, [0.5] * 16, 1), (3, [0.5] * 16, 1), (100, [1.0, -1.0, 0.125], 0), (101, [], 0), (102, [0.5] * 17, None)]
    rows = [(a, None if b is None else [None if c is None else float(F_(c)) for c in b], c) for a, b, c in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "v", "ids", "labels", "data", "same", "salt", "code", "error")}).repartition(5)
    assert got(df) == brute(rows)


def F_(c):
    import numpy as np

    return np.float32(c)


@pytest.mark.parametrize("n", [0, 1, 7])
def test_fewer_vectors_than_entries(spark, n):
    rows = [(i, [float(i % 3), 0.5 * i, -1.0 * i, 0.0] * 4, i % 2) for i in range(n)]
    a, b = got(spark.createDataFrame(rows, SCHEMA))
    assert (a, b) == (brute(rows) if n else ([], None))


def test_large_numbers_are_exact(spark):
    rows = [(i, [float(1 << (12 + i % 5)) * (-1) ** i, 3.0 * i] * 8, 0) for i in range(40)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_errors_beyond_a_long_are_null(spark):
    rows = [(i, [1e30 * i] * 8, i % 2) for i in range(40)]
    assert {r["error"] for r in V.codes(spark.createDataFrame(rows, SCHEMA)).collect()} >= {None}


def test_many_labels_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(V, "FEW_LABELS", 1)
    rows = [(i, [0.01 * i, -0.02 * i] * 8, None if i % 3 == 0 else i % 4) for i in range(60)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cur = c.sql(V.ORACLE)
    at = [cur.columns.index(n) for n in ("vec_id", "code", "error", "label_error", "codebooks_sha256")]
    want = sorted(tuple(r[i] for i in at) for r in cur.fetchall())
    df = V.codes(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and dict(df.dtypes)["error"] == dict(df.dtypes)["label_error"] == "bigint"
    assert sorted(map(tuple, df.collect())) == want and len(want) == 500
