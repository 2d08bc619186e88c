"""The trie of conversations' common beginnings, by an external mergesort that knows how much neighbours share.

A turn becomes 24 bytes: 16 of the SHA-256 of its role and text, and its text's length. A conversation is the sequence
of its turns' bytes, so that sorting brings equal beginnings together without moving texts. Tasks sort RUN_BYTES of
conversations at a time into runs, each entry with the number of turns that it shares with the one before (its LCP); the
runs are dealt out by ranges of (sequence, conv_id) and written. A range's parts of all runs are merged by a loser
tree: of two entries the one that shares more with the last output comes first, so only turns beyond what is shared
are compared, and each once. The merged stream goes over a stack of open nodes, which closes the nodes that the next
entry doesn't share, finished.

A node that reaches into the next range is finished there. What each range saw of such nodes adds up: counts, savings
and leaves are sums (a range takes off the first copy of a node's text only where it begins, and counts a leaf or child
only where it ends), and the lists of ids follow each other by range. Copies of one conversation, however many, are so
spread over ranges by their ids.

Defined cases: turns by number (null first), then by their bytes' digest; null role or text is empty; repeated rows are
turns each; rows without a conv_id belong to no conversation and are left out; an empty table has no nodes; other
columns are ignored, whatever their names. A conversation is one row of 24 bytes a turn and has to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import ship, written

TURN = 24
#: Bytes of a run and of a range, about; rows of a range at least, where there are tasks for more ranges; boundary
#: nodes up to which they are broadcast; ways in which a node's children are dealt beyond.
RUN_BYTES, RANGE_BYTES, RANGE_ROWS, FEW_NODES, SALTS = 8 << 20, 16 << 20, 512, 100_000, 64
RUNS = "run long, pos long, lcp int, key binary, conv_id long"
#: node: whole nodes have none; the others are put together by it.
PIECES = "node binary, span int, depth long, parent binary, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def shared_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """How many turns a and b share from the beginning; start: how many they are known to share."""
    at, end = start * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def sorted_run(entries: list[tuple[bytes, int]]) -> list[tuple[int, bytes, int]]:
    """(lcp with the entry before, key, conv_id) in order."""
    out, last = [], b""
    for key, conv in sorted(entries):
        out.append((shared_turns(last, key), key, conv))
        last = key
    return out


def merged(runs: list[list[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int]]:
    """The entries of sorted runs in order, each with the number of turns shared with the one before.

    A loser tree: tree[i] has the run that lost at node i. A head's lcp is with the last output, or, where it lost, with
    the entry that beat it, which is the last output once that has left along the path."""
    runs = [r for r in runs if r]
    k = len(runs)
    at, lcp = [0] * k, [0] * k
    key: list[bytes | None] = [r[0][1] for r in runs]
    conv = [r[0][2] for r in runs]

    def first(a: int, b: int) -> bool:
        if key[a] is None or key[b] is None:
            return key[b] is None
        if lcp[a] != lcp[b]:
            return lcp[a] > lcp[b]
        n = shared_turns(key[a], key[b], lcp[a])
        x, y = key[a][n * TURN : (n + 1) * TURN], key[b][n * TURN : (n + 1) * TURN]
        wins = x < y or x == y and conv[a] <= conv[b]
        lcp[b if wins else a] = n
        return wins

    tree = [-1] * k
    best = -1
    for leaf in range(k):  # a run waits at the first free node of its path; the last one reaches the top
        best, node = leaf, (leaf + k) // 2
        while node >= 1:
            if tree[node] < 0:
                tree[node], best = best, -1
                break
            if not first(best, tree[node]):
                best, tree[node] = tree[node], best
            node //= 2
    while best >= 0 and key[best] is not None:
        yield lcp[best], key[best], conv[best]
        run = runs[best]
        at[best] += 1
        if at[best] < len(run):
            lcp[best], key[best], conv[best] = run[at[best]]
        else:
            key[best] = None
        node = (best + k) // 2
        while node >= 1:
            if not first(best, tree[node]):
                best, tree[node] = tree[node], best
            node //= 2


class _Node:
    __slots__ = ("depth", "size", "before", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, size: int, before: bool) -> None:
        self.depth, self.size, self.before = depth, size, before
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: list[int] = []
        self.waiting: list[tuple] = []


def _names(key: bytes, depth: int) -> list[bytes]:
    """The names of key's beginnings of 0 to depth turns."""
    h, out = hashlib.sha256(), []
    for d in range(depth + 1):
        out.append(h.digest()[:16])
        h.update(key[d * TURN : (d + 1) * TURN])
    return out


def finished_nodes(stream: Iterator[tuple[int, bytes, int]], left: int, right: int, span: int) -> Iterator[tuple]:
    """Rows of PIECES for a range's merged stream, nodes as they close.

    left, right: how many turns the range's first (last) entry shares with the range before (after) it; -1 if there is none."""
    path: list[_Node] = []
    names: list[bytes] = []
    done: list[tuple] = []

    def close(more: bool = False) -> None:
        """Close the deepest open node; more: the next range goes on with it."""
        node = path.pop()
        up = path[-1] if path else None
        if not more and not node.children:
            node.leaves += 1
        node.saved += node.size * (node.n - (not node.before))
        if up is not None:
            up.n += node.n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.leaves += node.leaves
            up.saved += node.saved
            up.children += not more
        ends = ",".join(map(str, node.ends))
        whole = not node.before and not more
        of = None if whole else names[node.depth]
        done.extend((None, None, depth, of, conv, node.least if whole else None, *rest) for depth, conv, *rest in node.waiting)
        if not whole:
            done.append((of, span, node.depth, names[node.depth - 1] if node.depth else None, node.least, None, node.n, node.children, node.leaves, node.saved, ends if node.ends else None))
            return
        row = (node.depth, node.least, node.n, node.children, node.leaves, node.saved, hashlib.sha256(ends.encode()).hexdigest())
        if up is None:
            done.append((None, None, row[0], None, row[1], None, *row[2:]))
        else:
            up.waiting.append(row)

    last = None
    for lcp, key, conv in stream:
        if last is None:
            names = _names(key, left) if left >= 0 else []
            path.append(_Node(0, 0, left >= 0))
        while path[-1].depth > lcp:
            close()
        for d in range(path[-1].depth + 1, len(key) // TURN + 1):
            path.append(_Node(d, int.from_bytes(key[d * TURN - 8 : d * TURN], "big"), last is None and d <= left))
        node = path[-1]
        node.n += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.ends.append(conv)
        last = key
        yield from done
        done.clear()
    if last is not None:
        while path[-1].depth > right and path[-1].depth > 0:
            close()
        if right >= 0:
            names = _names(last, right)
        while path:
            close(path[-1].depth <= right)
        yield from done


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, group: int = 5, heads: int = 9) -> DataFrame:
    """conv_id and key, the turns' bytes, where conversations of a group begin alike: the first h turns are those of the
    group's conversation conv_id - conv_id % group, h the crc32 of the decimal conv_id modulo heads; its own follow after its first h."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    code = F.concat(F.substring(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 32), F.lpad(F.hex(F.octet_length(t).cast("long")), 16, "0"))
    n = F.col(turn)
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.struct(n.isNotNull(), n, code.alias("code")).alias("t")).where("conv_id is not null")
    own = rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["code"]).alias("own"))
    own = written(own, "turns")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    both = own.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    turns = F.concat(head, F.slice("own", F.col("h") + 1, F.greatest(F.size("own"), F.lit(1))))
    return both.select("conv_id", F.unhex(F.array_join(turns, "")).alias("key"))


def sorted_runs(batches: Iterator[pa.RecordBatch], run_bytes: int | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of (conv_id, key) as sorted runs, rows of RUNS."""
    part, entries, size, n = TaskContext.get().partitionId(), [], 0, 0

    def run() -> Iterator[pa.RecordBatch]:
        out = sorted_run(entries)
        for i in range(0, len(out), 4096):
            some = out[i : i + 4096]
            yield pa.RecordBatch.from_pydict({"run": [part << 32 | n] * len(some), "pos": range(i, i + len(some)), "lcp": [x[0] for x in some], "key": [x[1] for x in some], "conv_id": [x[2] for x in some]}, pa.schema([("run", pa.int64()), ("pos", pa.int64()), ("lcp", pa.int32()), ("key", pa.binary()), ("conv_id", pa.int64())]))

    for b in batches:
        for c, k in zip(b.column("conv_id").to_pylist(), b.column("key").to_pylist(), strict=True):
            entries.append((k, c))
            size += len(k) + 64
            if size >= (run_bytes or RUN_BYTES):
                yield from run()
                entries, size, n = [], 0, n + 1
    if entries:
        yield from run()


def runs_of(table: pa.Table) -> list[list[tuple[int, bytes, int]]]:
    """A range's rows of RUNS as runs; what the first entry of each shares with one in an earlier range doesn't count."""
    t = table.select(["run", "pos", "lcp", "key", "conv_id"]).sort_by([("run", "ascending"), ("pos", "ascending")])
    out: list[list[tuple[int, bytes, int]]] = []
    last = None
    for run, lcp, key, conv in zip(*(t.column(c).to_pylist() for c in ("run", "lcp", "key", "conv_id")), strict=True):
        if run != last:
            out.append([])
        out[-1].append((lcp if run == last else 0, key, conv))
        last = run
    return out


_PIECES = pa.schema([("node", pa.binary()), ("span", pa.int32()), ("depth", pa.int64()), ("parent", pa.binary()), *((c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends", pa.string())])


def _merge_range(runs: pa.Table, edges: pa.Table) -> pa.Table:
    if not runs.num_rows:
        return _PIECES.empty_table()
    edge = edges.to_pylist()[0]
    rows = list(finished_nodes(merged(runs_of(runs)), edge["left"], edge["right"], edge["span"]))
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)], schema=_PIECES)


def _edges(ranged: DataFrame) -> DataFrame:
    """span, left and right: how many turns each range shares with the ones before and after it. One row a range."""

    @F.pandas_udf("int")
    def shared(a, b):
        return a.combine(b, lambda x, y: -1 if x is None or y is None else shared_turns(x, y))

    ends = ranged.groupBy("span").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    order = Window.orderBy("span")
    ends = ends.select("span", "low", "high", F.lag("high").over(order).alias("before"), F.lead("low").over(order).alias("after"))
    return ends.select("span", shared("before", "low").alias("left"), shared("high", "after").alias("right"))


def _ids_hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's lists of ids, which come in order: (node, ends_sha256)."""
    node, h = None, None
    done: list[tuple[bytes, str]] = []
    out = lambda: pa.RecordBatch.from_pydict({"node": [d[0] for d in done], "ends_sha256": [d[1] for d in done]}, pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())]))
    for b in batches:
        for name, ends in zip(b.column("node").to_pylist(), b.column("ends").to_pylist(), strict=True):
            if name != node:
                if node is not None:
                    done.append((node, h.hexdigest()))
                node, h = name, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        yield out()
        done.clear()
    if node is not None:
        done.append((node, h.hexdigest()))
        yield out()


def _with_parents(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Fill in parent_conv_id from the boundary node that parent names; a node may have any number of children."""
    convs = nodes.select(F.col("node").alias("_node"), F.col("conv_id").alias("_conv"))
    if nodes.count() <= FEW_NODES:
        out = rows.join(F.broadcast(convs), F.col("parent") == F.col("_node"), "left")
    else:
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
        each = convs.withColumn("_its", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = dealt.join(each, (F.col("parent") == F.col("_node")) & (F.col("_salt") == F.col("_its")), "left")
    return out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv"))


def trie(sequences: DataFrame) -> DataFrame:
    """The nodes of the trie of (conv_id, key): NODES."""
    spark = sequences.sparkSession
    ship(spark)
    sequences = written(sequences, "sequences")
    rows, size = sequences.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, -(-size // RANGE_BYTES), min(parts, rows // RANGE_ROWS))
    runs = sequences.mapInArrow(sorted_runs, RUNS).repartitionByRange(ranges, "key", "conv_id").withColumn("span", F.spark_partition_id())
    runs = written(runs, "runs")
    pieces = written(runs.groupBy("span").cogroup(_edges(runs).groupBy("span")).applyInArrow(_merge_range, PIECES), "trie-pieces")
    part = pieces.where("node is not null")
    total = part.groupBy("node").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")))
    ends = part.where("ends is not null").select("node", "span", "ends").repartition("node").sortWithinPartitions("node", "span").mapInArrow(_ids_hashed, "node binary, ends_sha256 string")
    total = total.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
    total = written(total.withColumn("parent_conv_id", F.lit(None).cast("long")), "trie-boundary")
    whole = pieces.where("node is null").withColumnRenamed("ends", "ends_sha256").select("parent", *NODES)
    return _with_parents(whole.unionByName(total.select("parent", *NODES)), total).select(*NODES)


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Every distinct beginning of the rebuilt conversations as a node."""
    return trie(rebuilt(conversations))


_BYTES = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))"
_CRC = f"""xor(4294967295, list_reduce(list_concat([4294967295], {_BYTES}), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""

ORACLE = f"""
WITH t AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, list(struct_pack(m := m, size := size) ORDER BY turn NULLS FIRST, m) AS l FROM t GROUP BY conv_id),
hh AS MATERIALIZED (SELECT *, CAST({_CRC} % 9 AS BIGINT) AS h FROM own),
re AS MATERIALIZED (SELECT c.conv_id, list_concat(coalesce(b.l[1 : c.h], []), c.l[c.h + 1 :]) AS l FROM hh c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS MATERIALIZED (SELECT conv_id, len(l) AS n, d AS depth, array_to_string(list_transform(l[1 : d], lambda x: x.m), '') AS k, array_to_string(list_transform(l[1 : d - 1], lambda x: x.m), '') AS up, CASE WHEN d = 0 THEN 0 ELSE l[d].size END AS size
  FROM re, LATERAL (SELECT unnest(range(len(l) + 1)) AS d)),
nodes AS MATERIALIZED (SELECT k, depth, any_value(CASE WHEN depth > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) * (count(*) - 1) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256 FROM p GROUP BY k, depth),
kids AS MATERIALIZED (SELECT up, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY up),
full_ AS MATERIALIZED (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN kids c ON c.up = n.k),
below AS (SELECT left(f.k, CAST(32 * d AS BIGINT)) AS k, count(*) FILTER (WHERE f.n_children = 0) AS n_leaves, sum(f.saved) AS saved_tokens FROM full_ f, LATERAL (SELECT unnest(range(f.depth + 1)) AS d) GROUP BY 1)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, CAST(f.n_children AS BIGINT) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below b USING (k) LEFT JOIN full_ u ON u.k = f.up"""
