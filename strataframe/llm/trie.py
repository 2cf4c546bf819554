"""The prefix trie of rebuilt conversations, by a splitter-skeleton.

A conversation is a path of turn digests. Paths are range-partitioned in order, so all that share a prefix are neighbours. A prefix that
spans two partitions is a prefix of the splitter between them: the trie of all splitter paths (the skeleton) is broadcast,
local sorted shards finish every other node in one pass with a stack, and hand in partial sums for skeleton nodes, which a
reduction adds up.

Paths are cut into segments of ``SEGMENT`` turns, so a cell and a splitter are bounded. A segment hangs below the digest of all
turns before it; sums go from deeper segments to the ones above, a pass for each depth at which two conversations still agree. What
one conversation has alone below such a depth needs no pass. Splitters also hold the conversation's id, so equal
conversations are split too.
"""

from __future__ import annotations

import bisect
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.common import Scratch, shuffle_partitions
from strataframe.llm.turns import in_order, starts

SEGMENT, SAMPLE, PIECE = 256, 8, 10_000
WIDTH = 32  # hex digits of a turn's digest

# How conversations are rebuilt.
FAMILY, HEADS = 5, 9
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NOBODY = hashlib.sha256(b"").hexdigest()


def _borrowed(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, pos, n, token, bytes): runs of equal turns with their first place in the conversation."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.filter("conv_id IS NOT NULL").groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    token = F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, WIDTH)
    placed = in_order(rows, "n").select("conv_id", "part", "place", "n", token.alias("token"), F.octet_length("text").cast("long").alias("bytes"))
    placed = scratch.stored(placed, "turns")
    # conversations that run through several partitions: two a partition at most
    edges = starts(placed.groupBy("conv_id", "part").agg(F.sum("n").alias("n")), "size(by) > 1").select("conv_id", "part", "before")
    return placed.join(F.broadcast(edges), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "n", "token", "bytes")


def segments(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, level, path, sizes, total): rebuilt conversations in segments; the last one is never full, and may be empty."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = turns.groupBy("conv_id").agg(F.sum("n").alias("own")).select("*", base.alias("base"), F.when(F.col("conv_id") == base, 0).otherwise(_borrowed(F.col("conv_id"))).alias("h"))
    heads = turns.filter(f"conv_id % {FAMILY} = 0 AND pos < {HEADS - 1}").groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "n", "token", "bytes")).alias("heads"), F.least(F.sum("n"), F.lit(HEADS - 1)).alias("most"))
    # of a conversation that is its own base, h stands as 0: all turns are its own
    info = own.join(heads, "base", "left").withColumn("lent", F.least("h", F.coalesce("most", F.lit(0))))
    info = scratch.stored(info.withColumn("total", F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).drop("most"), "rebuilt")
    first = F.greatest("pos", "h")
    mine = turns.join(info.select("conv_id", "h", "lent", "total"), "conv_id").select("conv_id", (first - F.col("h") + F.col("lent")).alias("a"), (F.col("pos") + F.col("n") - F.col("h") + F.col("lent")).alias("e"), "token", "bytes", "total").filter("a < e")
    lent = info.filter("lent > 0").select("conv_id", "h", "total", F.explode("heads").alias("x")).select("conv_id", F.col("x.pos").alias("a"), F.least(F.col("x.pos") + F.col("x.n"), "h").alias("e"), "x.token", "x.bytes", "total").filter("a < e")
    runs = mine.unionByName(lent).withColumn("level", F.explode(F.sequence(F.floor(F.col("a") / SEGMENT), F.floor((F.col("e") - 1) / SEGMENT))))
    at = F.col("level") * SEGMENT
    runs = runs.select("conv_id", "level", "total", F.greatest(F.col("a") - at, F.lit(0)).cast("int").alias("a"), F.least(F.col("e") - at, F.lit(SEGMENT)).cast("int").alias("e"), "token", "bytes")
    marks = info.select("conv_id", F.floor(F.col("total") / SEGMENT).alias("level"), "total", F.lit(0).alias("a"), F.lit(0).alias("e"), F.lit("").alias("token"), F.lit(0).cast("long").alias("bytes"))
    whole = runs.unionByName(marks).groupBy("conv_id", "level", "total").agg(F.sort_array(F.collect_list(F.struct("a", "e", "token", "bytes"))).alias("runs"))
    path = F.array_join(F.transform("runs", lambda r: F.repeat(r["token"], r["e"] - r["a"])), "")
    return whole.select("conv_id", "level", path.alias("path"), F.flatten(F.transform("runs", lambda r: F.array_repeat(r["bytes"], r["e"] - r["a"]))).alias("sizes"), "total")


def grouped(segs: DataFrame, scratch: Scratch) -> DataFrame:
    """segments with top, what they hang below, and next, what hangs below them. Digests of segments are added up by exclusive or, in order of levels."""
    several = F.col("total") >= SEGMENT
    hashed = F.sha2(F.concat(F.col("level").cast("string"), F.lit(":"), "path"), 256)
    lanes = [F.conv(F.substring(hashed, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2)]
    by = Window.partitionBy("conv_id").orderBy("level")
    upto = lambda w, shift: F.concat((F.col("level") + shift).cast("string"), *(x for lane in ("lane0", "lane1") for x in (F.lit(":"), F.hex(F.bit_xor(lane).over(w)))))
    # a row for SEGMENT turns of the longer conversations
    keys = segs.filter(several).select("conv_id", "level", lanes[0].alias("lane0"), lanes[1].alias("lane1"))
    keys = keys.select("conv_id", "level", F.when(F.col("level") == 0, "").otherwise(upto(by.rowsBetween(Window.unboundedPreceding, -1), 0)).alias("top"), upto(by, 1).alias("next"))
    long = segs.filter(several).join(keys, ["conv_id", "level"]).withColumn("next", F.when(F.length("path") == WIDTH * SEGMENT, F.col("next")))
    short = segs.filter(~several).select("*", F.lit("").alias("top"), F.lit(None).cast("string").alias("next"))
    return scratch.stored(short.unionByName(long), "segments")


class Skeleton:
    """The trie of splitter paths: each splitter's nodes by depth, numbered as they first occur."""

    def __init__(self, splitters: list):
        self.keys = [(s["top"], s["path"], s["conv_id"]) for s in splitters]
        self.nodes, self.ids = [], []  # nodes: [top, depth, parent, children, bytes below]
        for i, s in enumerate(splitters):
            shared = self.shared(self.keys[i - 1], s["top"], s["path"]) if i else -1
            ids = self.ids[-1][: shared + 1] if i else []
            for depth in range(shared + 1, len(s["path"]) // WIDTH + 1):
                parent = ids[-1] if ids else None
                if parent is not None:
                    self.nodes[parent][3] += 1
                for above in ids if depth else []:
                    self.nodes[above][4] += s["sizes"][depth - 1]
                ids = [*ids, len(self.nodes)]
                self.nodes.append([s["top"], depth, parent, 0, s["sizes"][depth - 1] if depth else 0])
            self.ids.append(ids)

    @staticmethod
    def shared(key, top: str, path: str) -> int:
        """Depth to which a path agrees with a splitter, -1 below another top."""
        return common(key[1], path) if key[0] == top else -1

    def shard(self, top: str, path: str, conv_id: int) -> int:
        return bisect.bisect_right(self.keys, (top, path, conv_id))

    def on_path(self, shard: int, top: str, path: str) -> list[int]:
        """Numbers of the skeleton's nodes on a path of a shard: only the splitters at its ends can share any."""
        out: list[int] = []
        for i in (shard - 1, shard):
            if 0 <= i < len(self.keys):
                n = self.shared(self.keys[i], top, path) + 1
                if n > len(out):
                    out = self.ids[i][:n]
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a node; only where a splitter ends there may be no node below, and the nodes above are listed."""
        ends = {ids[-1]: ids for ids in self.ids}
        rows = [(i, *node, ends.get(i)) for i, node in enumerate(self.nodes)]
        return spark.createDataFrame(rows, "sk int, top string, depth int, parent_sk int, static_children long, static_bytes long, above array<int>")


def common(a: str, b: str) -> int:
    """How many whole digests two paths share."""
    if a == b:
        return len(a) // WIDTH
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * WIDTH] == b[: mid * WIDTH] else (low, mid - 1)
    return low


class Open:
    """A node of which more members may come."""

    __slots__ = ("size", "sk", "conv_id", "n", "children", "leaves", "saved", "ends", "listed", "below", "waiting", "pieces")

    def __init__(self, size: int, sk: int | None):
        self.size, self.sk, self.conv_id, self.n, self.children, self.leaves, self.saved = size, sk, None, 0, 0, 0, 0
        self.ends, self.listed, self.below, self.waiting, self.pieces = hashlib.sha256(), 0, None, [], []

    def end(self, conv_id: int) -> None:
        if self.sk is None:
            self.ends.update((b"," if self.listed else b"") + str(conv_id).encode())
        else:
            self.pieces.append(conv_id)
        self.listed += 1

    def met(self, conv_id: int, n: int) -> None:
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)
        self.n += n


OUT = "kind string, conv_id long, depth int, parent_conv_id long, parent_sk int, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top string, sk int, shard int, step int, below boolean"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


def _shards(skeleton):
    """Sorted rows of shards -> finished nodes, parts of skeleton nodes and pieces of their lists of ends, as rows of OUT."""

    def run(batches):
        plan, out, stack = skeleton.value, [], []
        shard = top = path = None
        step = 0

        def put(kind, **more):
            out.append({"kind": kind} | more)

        def pieces(node):
            nonlocal step
            put("piece", sk=node.sk, shard=shard, step=step, ends_sha256=",".join(map(str, node.pieces)))
            node.pieces, step = [], step + 1

        def close():
            node, depth, parent = stack[-1], len(stack) - 1, stack[-2] if len(stack) > 1 else None
            stack.pop()
            if node.below:
                node.children, node.leaves, node.saved = node.children + node.below["n_children"], node.leaves + node.below["n_leaves"], node.saved + node.below["saved_tokens"]
            sums = {"conv_id": node.conv_id, "depth": depth, "n_convs": node.n}
            if node.sk is not None:
                if node.pieces:
                    pieces(node)
                node.saved += node.n * node.size
                put("part", **sums, n_children=node.children, n_leaves=node.leaves, saved_tokens=node.saved, sk=node.sk, below=bool(node.below), ends_sha256=node.below and node.below["ends_sha256"])
            else:
                node.saved += (node.n - 1) * node.size
                node.leaves += not node.children and not node.below
                done = sums | {"n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": node.below["ends_sha256"] if node.below else node.ends.hexdigest()}
                for child in node.waiting:
                    put("node", **child, parent_conv_id=node.conv_id)
                if not depth:
                    put("top", **done, top=top)
                elif parent.sk is not None:
                    put("node", **done, parent_sk=parent.sk)
                else:
                    parent.waiting.append(done)
            if parent:
                parent.met(node.conv_id, node.n)
                parent.children += node.sk is None
                parent.leaves, parent.saved = parent.leaves + node.leaves, parent.saved + node.saved

        for b in batches:
            for r in b.to_pylist():
                shared = common(path, r["path"]) if stack and (shard, top) == (r["shard"], r["top"]) else -1
                while len(stack) > shared + 1:
                    close()
                shard, top, path = r["shard"], r["top"], r["path"]
                skeletal = plan.on_path(shard, top, path)
                for depth in range(len(stack), len(path) // WIDTH + 1):
                    stack.append(Open(r["sizes"][depth - 1] if depth else 0, skeletal[depth] if depth < len(skeletal) else None))
                node = stack[-1]
                node.met(r["conv_id"], 1)
                if r["next"] is None:
                    node.end(r["conv_id"])
                    if len(node.pieces) >= PIECE:
                        pieces(node)
                elif r["below"]:
                    node.below = r["below"]
                if len(out) >= 2000:
                    yield _rows(out)
                    out.clear()
        while stack:
            close()
        yield _rows(out)

    return run


def _rows(out: list[dict]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in out], kinds[k]) for c, k in (x.split() for x in OUT.split(", "))], names=_NAMES)


def _digests(batches):
    """Pieces of lists of ids in order -> the digest of each whole list."""
    sk, digest = None, None
    done = lambda: pa.RecordBatch.from_arrays([pa.array([sk], pa.int32()), pa.array([digest.hexdigest()])], names=["sk", "ends"])
    for b in batches:
        for r in b.to_pylist():
            if r["sk"] != sk:
                if digest:
                    yield done()
                sk, digest = r["sk"], hashlib.sha256(r["ends_sha256"].encode())
            else:
                digest.update(f",{r['ends_sha256']}".encode())
    if digest:
        yield done()


def _sharded(rows: DataFrame, skeleton, parts: int) -> DataFrame:
    """rows dealt to the shards of a broadcast skeleton, each sorted."""

    def run(batches):
        for b in batches:
            at = [skeleton.value.shard(*x) for x in zip(*(b.column(c).to_pylist() for c in ("top", "path", "conv_id")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "shard"])

    dealt = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))
    return dealt.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "top", "path", "conv_id")


def level_nodes(rows: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (conv_id, top, path, sizes, next, below) of one level -> its nodes, and sums of the tops. below is given once a next."""
    spark, parts = rows.sparkSession, shuffle_partitions(rows.sparkSession)
    # a bounded sample, SAMPLE rows a shard or so; it only says where shards are cut
    share = min(1.0, SAMPLE * parts / max(rows.count(), 1))
    some = rows.filter(F.pmod(F.xxhash64("conv_id", "top"), F.lit(1 << 30)) < int(share * (1 << 30))).select("top", "path", "conv_id", "sizes")
    order = Window.orderBy("top", "path", "conv_id")
    ranked = some.select("*", F.row_number().over(order).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy()).alias("all"))
    cut = ranked.filter(F.floor(F.col("rank") * parts / F.col("all")) > F.floor((F.col("rank") - 1) * parts / F.col("all"))).filter("rank < all")
    skeleton = Skeleton(sorted(cut.collect(), key=lambda s: (s["top"], s["path"], s["conv_id"])))
    sent = spark.sparkContext.broadcast(skeleton)
    found = scratch.stored(_sharded(rows, sent, parts).mapInArrow(_shards(sent), OUT), f"found-{name}")
    sums = found.filter("kind = 'part'").groupBy("sk").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("below").alias("below"), F.max("ends_sha256").alias("ends_below")
    )
    pieces = found.filter("kind = 'piece'").select("sk", "shard", "step", "ends_sha256").repartition(parts, "sk").sortWithinPartitions("sk", "shard", "step").mapInArrow(_digests, "sk int, ends string")
    sums = skeleton.table(spark).join(sums, "sk").join(pieces, "sk", "left").withColumn("n_children", F.col("n_children") + F.col("static_children"))
    sums = scratch.stored(sums, f"skeleton-{name}")  # a row a node of the skeleton: SEGMENT rows a shard at most
    bare = sums.filter("n_children = 0 AND NOT below").select(F.explode("above").alias("sk")).groupBy("sk").agg(F.count(F.lit(1)).alias("bare"))
    whole = sums.join(bare, "sk", "left").select(
        "sk", "parent_sk", "top", "depth", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.coalesce("bare", F.lit(0))).alias("n_leaves"),
        (F.col("saved_tokens") - F.col("static_bytes")).alias("saved_tokens"), F.coalesce("ends_below", "ends", F.lit(NOBODY)).alias("ends_sha256"),
    )
    parents = F.broadcast(sums.select(F.col("sk").alias("parent_sk"), F.col("conv_id").alias("above_id")))
    below = found.filter("kind = 'node'").select(*NODE, "parent_sk").unionByName(whole.filter("depth > 0").select("*", F.lit(None).cast("long").alias("parent_conv_id")).select(*NODE, "parent_sk"))
    nodes = below.join(parents, "parent_sk", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above_id")).select(*NODE)
    tops = found.filter("kind = 'top'").select("top", *NODE).unionByName(whole.filter("depth = 0").select("top", *(F.lit(None).cast("long").alias(c) if c == "parent_conv_id" else c for c in NODE)))
    return nodes, tops


def _alone(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and tops of segments that hang alone below theirs: a chain each, which ends there or goes on below."""
    one = lambda c, v: F.lit(v).cast("long").alias(c)
    listed = F.sha2(F.col("conv_id").cast("string"), 256)
    chain = rows.filter(F.size("sizes") > 0).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("sizes"))))
    depth = F.col("level") * SEGMENT + F.col("at")
    ends = depth == F.col("total")
    nodes = chain.select("conv_id", depth.alias("depth"), F.col("conv_id").alias("parent_conv_id"), one("n_convs", 1), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"), one("n_leaves", 1), one("saved_tokens", 0), F.when(ends, listed).otherwise(NOBODY).alias("ends_sha256"))
    bare = F.size("sizes") == 0
    tops = rows.select("top", "conv_id", one("depth", 0), F.lit(None).cast("long").alias("parent_conv_id"), one("n_convs", 1), F.when(bare, 0).otherwise(1).cast("long").alias("n_children"), one("n_leaves", 1), one("saved_tokens", 0), F.when(bare, listed).otherwise(NOBODY).alias("ends_sha256"))
    return nodes, tops


_BELOW = ("n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _with_below(rows: DataFrame, tops: DataFrame | None) -> DataFrame:
    """rows with what hangs below their segments, each top's at its smallest conversation alone."""
    kept = ("conv_id", "top", "path", "sizes", "next")
    if tops is None:
        return rows.select(*kept, F.lit(None).cast("struct<n_children:long,n_leaves:long,saved_tokens:long,ends_sha256:string>").alias("below"))
    sums = tops.select(F.col("top").alias("next"), "conv_id", F.struct(*_BELOW).alias("below"))
    return rows.join(sums, ["next", "conv_id"], "left").select(*kept, "below")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes (see NODE) of the trie of rebuilt conversations.

    Rows without conv_id are in no conversation. Null turns come first, rows of one turn go by role and text, rows that repeat are
    each a turn. Ids below zero: the remainder has the sign of the id, as in SQL. No conversations: no nodes, not even a root. Extra columns are left out.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    segs = grouped(segments(ordered_turns(conversations, scratch), scratch), scratch)
    at = lambda nodes, level: nodes.select(*(F.col(c).cast("string" if c == "ends_sha256" else "long").alias(c) if c != "depth" else (F.col(c) + level * SEGMENT).cast("long").alias(c) for c in NODE))
    if segs.filter("level > 0").isEmpty():
        nodes, tops = level_nodes(_with_below(segs, None), scratch, "0")
        return at(nodes, 0).unionByName(at(tops, 0))
    deep = segs.filter("level > 0")
    deep = scratch.stored(deep.join(deep.groupBy("top").agg(F.count(F.lit(1)).alias("members")), "top"), "deep")
    nodes, alone = _alone(deep.filter("members = 1"))
    result, shared = at(nodes, 0), deep.filter("members > 1")
    # as many as two conversations agree in whole segments
    levels = sorted(r[0] for r in shared.select("level").distinct().collect())
    tops = alone
    for level in [*levels[::-1], 0]:
        rows = segs.filter("level = 0") if not level else shared.filter(F.col("level") == level)
        nodes, own = level_nodes(_with_below(rows, tops), scratch, str(level))
        result, tops = result.unionByName(at(nodes, level)), own.select(*alone.columns).unionByName(alone)
    return result.unionByName(at(own, 0))


def op12_trie(conversations: DataFrame) -> DataFrame:
    """A row a node of the trie; see ``prefix_trie``."""
    return prefix_trie(conversations)


#: The plain way: a digest of every prefix of every conversation.
ORACLE = """
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL) x, bits),
filled AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p FROM filled),
rebuilt AS (
  SELECT i.conv_id, p.p, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.base AND p.p < i.h
  UNION ALL SELECT i.conv_id, p.p, p.role, p.text FROM ids i JOIN placed p ON p.conv_id = i.conv_id AND p.p >= i.h),
turns AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, strlen(text) AS bytes, sha256(concat(strlen(role), ':', role, text)) AS token FROM rebuilt),
paths AS (
  SELECT conv_id, 0 AS d, '' AS key, 0 AS bytes FROM ids
  UNION ALL SELECT conv_id, d, sha256(string_agg(token, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)), bytes FROM turns),
lengths AS (SELECT conv_id, max(d) AS t FROM paths GROUP BY conv_id),
nodes AS (
  SELECT d, key, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = t), '')) AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY d, key),
linked AS (SELECT n.*, p.key AS above FROM nodes n LEFT JOIN paths p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
kids AS (SELECT d - 1 AS d, above AS key, count(*) AS k FROM linked WHERE d > 0 GROUP BY ALL),
known AS (
  SELECT l.*, coalesce(k.k, 0) AS k, a.conv_id AS parent FROM linked l LEFT JOIN kids k ON k.d = l.d AND k.key = l.key LEFT JOIN nodes a ON a.d = l.d - 1 AND a.key = l.above),
sums AS (
  SELECT p.d, p.key, count(*) FILTER (w.k = 0) AS leaves, sum((w.n - 1) * w.bytes) AS saved FROM known w JOIN paths p ON p.conv_id = w.conv_id AND p.d <= w.d GROUP BY p.d, p.key)
SELECT conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM known JOIN sums USING (d, key)"""
