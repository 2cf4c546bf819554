"""SimHash near-dedup by bit-sliced comparison.

1. One Arrow pass makes a 64-bit fingerprint of each text; equal fingerprints are one node from here on.
2. Candidates, without loss: two fingerprints at 3 or fewer differing bits agree on one of four 16-bit
   blocks, and the other 48 bits, again at 3 or fewer, on one of four 12-bit parts: 16 keys of 28 bits. Keys that
   only one fingerprint has are dropped by a count.
3. Rows of a key are sorted together and compared in bit-sliced form: bit j of all rows is a packed
   plane; shifting a plane by s lines every row up with its s-th successor, so a machine word holds 64 pairs,
   and the differing bits of all of them are counted by a carry-save counter of two planes with
   a sticky overflow. Words whose lanes have all overflowed are abandoned, usually after a few planes.
4. A key's links leave the task as a forest, not as pairs, and become components on the cluster.

A key of more than ``CHUNK`` rows is split in the same way as the whole: two of its rows that link agree on one of four parts
of the bits that the key leaves open. Few bits leave few fingerprints, so after some splits every key is small; no pair is
lost, and work grows with the rows and not with their pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Scratch, row_key, utf8
from strataframe.llm.components import connected_components

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Rows of one key that are compared in one task.
CHUNK = 2048
#: Rows that a task compares at once, but for whole keys.
BLOCK = 1 << 15


def simhash(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned integer; 0 without words."""
    import xxhash

    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter((len(w) for w in words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    if n < shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    a, b = starts[: n - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist()
    h64 = xxhash.xxh64_intdigest
    count, total = np.zeros(64, np.int64), len(a)
    for k in range(0, total, 1 << 14):
        part = np.array([h64(joined[i:j], SEED) for i, j in zip(a[k : k + (1 << 14)], b[k : k + (1 << 14)])], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (see ``row_key``), fp: the fingerprint's bits as a signed long. Null text counts as empty."""

    def run(batches):
        for b in batches:
            fp = np.array([simhash(t, shingle) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), pa.array(fp)], names=["doc_id", "row", "fp"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row"), utf8(docs).alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, fp long")


def _low(c: Column, bits: int) -> Column:
    return c.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def _without(c: Column, at: int, bits: int) -> Column:
    """The bits of ``c`` but for so many from ``at`` on."""
    return F.shiftleft(F.shiftrightunsigned(c, at + bits), at).bitwiseOR(_low(c, at)) if at + bits < 64 else _low(c, at)


def block_keys(fp: Column) -> Column:
    """The 16 keys: which table, its 16-bit block and a 12-bit part of the other 48 bits."""
    keys = []
    for b in range(4):
        block, rest = _low(F.shiftrightunsigned(fp, 16 * b), 16), _without(fp, 16 * b, 16)
        for s in range(4):
            part = _low(F.shiftrightunsigned(rest, 12 * s), 12)
            keys.append(F.lit((4 * b + s) << 28).cast("long").bitwiseOR(F.shiftleft(block, 12)).bitwiseOR(part))
    return F.array(*keys)


#: Bits that a key of ``block_keys`` leaves open.
OPEN = 36


def open_bits(fp: Column, key: Column) -> Column:
    """The bits of the fingerprint that its key leaves open."""
    rests = [_without(_without(fp, 16 * b, 16), 12 * s, 12) for b in range(4) for s in range(4)]
    return F.element_at(F.array(*rests), (F.shiftrightunsigned(key, 28) + 1).cast("int"))


def narrower_keys(key: Column, rest: Column, bits: int) -> Column:
    """Of each of four parts of the open bits: a key that fixes it too, and the bits that are open then."""
    cuts = [bits * k // 4 for k in range(5)]
    made = []
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = _low(F.shiftrightunsigned(rest, a), b - a)
        made.append(F.struct(F.xxhash64(key, F.lit(k), part).alias("key"), _without(rest, a, b - a).alias("rest")))
    return F.array(*made)


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(bits, words + 1) of uint64: bit i of plane j is bit j of row i. Rows are 64-bit numbers or rows of bytes."""
    n = len(fp)
    words = -(-n // 64) + 1
    bits = np.unpackbits(fp.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.zeros((bits.shape[1], words * 8), np.uint8)
    rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    packed[:, : rows.shape[1]] = rows
    return packed.view(np.uint64)


def linked(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS):
    """Yields (i, j) index arrays of the rows of one group within ``radius`` bits, by offset.

    The counters start so high that one more than ``radius`` overflows them.
    """
    n = len(fp)
    planes = planes_of(fp)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    size = radius.bit_length()
    start = (1 << size) - 1 - radius
    for s in range(1, n):
        same = np.zeros(planes.shape[1] * 64, np.uint8)
        same[: n - s] = group[s:] == group[:-s]
        lanes = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(lanes)
        if not len(at):
            return
        skip, bit = divmod(s, 64)
        over = ~lanes[at]
        counter = [np.full_like(over, full if start >> k & 1 else 0) for k in range(size)]
        src, nxt = at + skip, np.minimum(at + skip + 1, planes.shape[1] - 1)
        src = np.minimum(src, planes.shape[1] - 1)
        for j, p in enumerate(planes):
            ahead = p[src] >> np.uint64(bit)
            if bit:
                ahead |= p[nxt] << np.uint64(64 - bit)
            carry = p[at] ^ ahead
            for c in counter:
                more = c & carry
                c ^= carry
                carry = more
            over |= carry
            if j % 6 == 5:
                live = over != full
                if not live.all():
                    at, src, nxt, over, *counter = (x[live] for x in (at, src, nxt, over, *counter))
                    if not len(at):
                        break
        if len(at):
            hits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            w, lane = np.nonzero(hits)
            i = at[w] * 64 + lane
            yield i, i + s


def forest(n: int, pairs) -> np.ndarray:
    """The least index that each of n rows is joined to by ``pairs``."""
    root = np.arange(n)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        apart = root[i] != root[j]
        for a, b in zip(i[apart].tolist(), j[apart].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        while True:
            deeper = root[root]
            if (deeper == root).all():
                break
            root = deeper
    return root


def compare(radius: int):
    """Rows (key, part, fp) sorted by key and part -> (a, b): a forest of the links in each part."""

    def solve(key, part, fp):
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
        root = forest(len(fp), linked(fp.view(np.uint64), np.cumsum(new), radius))
        child = np.flatnonzero(root != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            own = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "part", "fp")]
            held = own if held is None else [np.concatenate(x) for x in zip(held, own)]
            if len(held[0]) >= BLOCK:
                edge = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                if len(edge):
                    yield solve(*(x[: edge[-1]] for x in held))
                    held = [x[edge[-1] :] for x in held]
        if held is not None and len(held[0]):
            yield solve(*held)

    return run


def near_links(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): links whose components are those of all links."""
    scratch = Scratch(nodes.sparkSession, "links")
    rows, bits, level, dealt = nodes.select("fp", F.explode(block_keys(F.col("fp"))).alias("key")), OPEN, 0, None
    while True:
        # written, so that the join with it can be split where a key is hot
        sizes = scratch.stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"sizes-{level}")
        last = bits < 4 or 1 << bits <= chunk or sizes.filter(F.col("n") > chunk).isEmpty()
        shared = rows.join(sizes, "key")
        own = (shared if last else shared.filter(F.col("n") <= chunk)).select("key", F.lit(level).alias("part"), "fp")
        dealt = own if dealt is None else dealt.unionByName(own)
        if last:
            break
        rest = F.col("rest") if level else open_bits(F.col("fp"), F.col("key"))
        narrower = shared.filter(F.col("n") > chunk).select("fp", F.explode(narrower_keys(F.col("key"), rest, bits)).alias("x"))
        rows = scratch.stored(narrower.select("fp", "x.key", "x.rest"), f"keys-{level}")
        bits, level = bits - bits // 4, level + 1
    return dealt.repartition("key", "part").sortWithinPartitions("key", "part", "fp").mapInArrow(compare(radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, row, fp, component, component_id of each row: the group and its least doc_id, that links of fingerprints lead to.

    Null and blank texts have fingerprint zero and link like any other. Null doc_ids never name a group that
    has another id. Rows that repeat, and rows of one fingerprint, are in one group. No rows: no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.stored(fingerprints(docs), "prints")
    nodes = scratch.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "nodes")
    members = connected_components(near_links(nodes.select("fp"), radius))
    named = nodes.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    return prints.join(named.join(least, "component").select("fp", "component", "component_id"), "fp")


def op2_simhash(docs: DataFrame) -> DataFrame:
    """Fingerprint and component of each row; see ``near_groups`` for odd rows."""
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
