"""Suffix-array dedup: Burrows-Wheeler transforms of shards, merged by interleave refinement.

Every byte that a 400-byte string covers which starts anywhere else too is removed. Anchors (see ``anchors``)
bring the places that may share such a string together: a context is a run of window starts with one
anchor and the bytes that they cover. Equal contexts are combined by their digest, so their bytes travel once, with whether they have
several places. The distinct contexts of an anchor go to one task, and there:

- The symbols are the ids of 100-byte blocks at every byte, so the suffix of a window start has its
  400 bytes in its first 4 symbols, and the predecessor of a suffix starts 100 bytes before it.
  A context ends in unique terminators.
- The contexts are dealt to two shards, whose suffixes are sorted each by itself, and a shard is then
  nothing but its transform: the symbol before each suffix, in suffix order.
- The shards are merged as Holt and McMillan do ("Merging of multi-string BWTs with applications"): the interleave
  starts as one shard after the other, and each round walks it, reads the next symbol of the shard that it
  names and deals the places out by that symbol, stably. After t rounds it is right by t symbols and the
  boundaries that appeared up to then are where common prefixes are shorter. So 4 rounds give
  the repeated intervals; the suffixes are not sorted again. A suffix of a context with several places counts
  as two, as it would stand twice in its shard. Every removed window comes from these intervals.

An anchor of more than ``SHARD`` distinct contexts is split by further k-grams (see ``matching``) until each part has fewer,
and these go the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm import anchors
from strataframe.llm.common import NO_ID, Scratch
from strataframe.llm.matching import CONTEXTS, RANGES, spans_of_rows
from strataframe.llm.matching import repeated_windows as windows_told
from strataframe.llm.substrings import context_rows, keyed_rows, passages_of, pieces, runs_of, split_contexts

WINDOW, GRAM, BLOCK = 400, 128, 100
#: Distinct contexts of an anchor that are merged at once; anchors of more are split.
SHARD = 256
#: Bytes of contexts that a task merges at once, but for whole anchors.
BATCH = 1 << 16


def byte_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(text) + 1)
    return at[:-1], at[1:]


def byte_contexts(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            parts = []
            for text, doc, row in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), b.column("row").to_pylist()):
                if len(text) >= window:
                    parts.append((*anchors.contexts(text, *byte_bounds(text), window, gram), ("doc_id", pa.int64(), doc), ("row", pa.int64(), row)))
            if parts:
                yield context_rows(parts, ["anchor", "context", "doc_id", "row", "first", "last"])

    return rows.mapInArrow(run, CONTEXTS)


def by_symbol(c: np.ndarray) -> np.ndarray:
    """Stable order of non-negative 32-bit symbols, by two passes over their halves."""
    order = np.argsort((c & 0xFFFF).astype(np.uint16), kind="stable")
    if len(c) and c.max() > 0xFFFF:
        order = order[np.argsort((c >> 16).astype(np.uint16)[order], kind="stable")]
    return order


class Texts:
    """Contexts of some anchors as sequences of block symbols."""

    def __init__(self, group: np.ndarray, texts: list[bytes], block: int):
        # one place more for each, so every sequence of blocks ends in a terminator
        texts = [x + b"\0" for x in texts]
        length = np.array([len(x) for x in texts])
        self.base = np.concatenate(([0], np.cumsum(length)))
        self.owner = np.repeat(np.arange(len(texts)), length)
        n = int(self.base[-1])
        at = np.arange(n)
        offset = at - self.base[self.owner]
        left = length[self.owner] - offset
        whole = left > block
        hashed = anchors.Hashed(b"".join(texts), strict=True)
        ids = anchors.mixed(hashed.of(at[whole], at[whole] + block) ^ (group[self.owner[whole]].astype(np.uint64) * np.uint64(anchors.MIX)))
        ends = int((~whole).sum())
        self.symbol = np.empty(n, np.int64)
        self.symbol[~whole] = np.arange(ends)  # terminators, no two alike
        self.symbol[whole] = np.unique(ids, return_inverse=True)[1] + ends
        #: Where the suffix starts that is one symbol longer; before the first symbol stands the terminator.
        self.before = np.where(offset >= block, at - block, at + (left - 1) // block * block)
        self.left = left


def shard_transform(texts: Texts, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of the positions ``members`` and the symbols before them, which are the shard's transform."""
    order, block = members, np.zeros(len(members), np.int64)
    while True:
        longer = texts.before[order]
        c = texts.symbol[longer]
        perm = by_symbol(c)
        order, c, block = longer[perm], c[perm], block[perm]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (block[1:] != block[:-1])
        block = np.cumsum(new)
        if new.all():  # terminators differ, so this comes
            return order, texts.symbol[texts.before[order]]


def merge(one: np.ndarray, two: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(interleave, interval): after ``depth`` rounds, which shard each place is from, and the number of the
    interval of equal ``depth``-symbol prefixes that it lies in."""
    z = np.concatenate((np.zeros(len(one), np.int8), np.ones(len(two), np.int8)))
    interval = np.zeros(len(z), np.int64)
    c = np.empty(len(z), np.int64)
    for _ in range(depth):
        c[z == 0], c[z == 1] = one, two
        perm = by_symbol(c)
        z, interval, s = z[perm], interval[perm], c[perm]
        new = np.ones(len(z), bool)
        new[1:] = (s[1:] != s[:-1]) | (interval[1:] != interval[:-1])
        interval = np.cumsum(new) - 1
    return z, interval


def repeated_windows(group: np.ndarray, texts: list[bytes], window: int = WINDOW, block: int = BLOCK, several=None) -> list[tuple[int, int, int]]:
    """(text number, start, end): the runs of window starts whose bytes start elsewhere in their group too.

    ``several`` marks texts that stand for more than one place.
    """
    t = Texts(group, texts, block)
    # every other context of a group goes to the second shard
    second = (np.arange(len(texts)) - np.searchsorted(group, group)) % 2 == 1
    side = second[t.owner]
    (sa1, bwt1), (sa2, bwt2) = (shard_transform(t, np.flatnonzero(side == k)) for k in (False, True))
    z, interval = merge(bwt1, bwt2, window // block)
    place = np.empty(len(z), np.int64)
    place[z == 0], place[z == 1] = sa1, sa2
    repeated = np.zeros(len(z) + 1, bool)
    weight = None if several is None else 1 + np.asarray(several, np.int64)[t.owner[place]]
    repeated[place[(np.bincount(interval, weight) > 1)[interval]]] = True
    repeated[:-1] &= t.left > window
    # a context's last window start is followed by places without a window, so runs end within it
    return [(int(t.owner[a]), a - int(t.base[t.owner[a]]), b - int(t.base[t.owner[a]])) for a, b in runs_of(repeated[:-1])]


def merge_shards(window: int, block: int):
    """PASSAGES sorted by anchor -> RANGES of repeated windows, which hold for all places."""

    def solve(rows):
        anchor, context, several, texts = zip(*rows)
        group = np.cumsum(np.concatenate(([0], np.diff(np.array(anchor, np.int64)) != 0)))
        found = repeated_windows(group, list(texts), window, block, several)
        columns = zip(*((anchor[i], context[i], False, a, b) for i, a, b in found)) if found else ([], [], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32()))], names=["anchor", "context", "later", "start", "end"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(n).to_pylist() for n in ("anchor", "context", "several", "words"))):
                if size >= BATCH and row[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield solve(held)

    return run


def repeated_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """rows (doc_id, row, text), dealt by row and doc_id -> row, doc_id and the sorted byte spans that occur elsewhere too."""
    scratch = Scratch(rows.sparkSession, "suffixes")
    contexts = scratch.stored(byte_contexts(rows, window, gram), "contexts")

    def bring(wanted):
        return passages_of(rows, wanted, lambda text, first, last: [text[f : e + window] for f, e in zip(first, last)])

    def match(passages):
        return passages.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(merge_shards(window, block), RANGES)

    later = F.lit(False)
    found, told = windows_told(contexts, bring, match, split_contexts(byte_bounds, window, gram), later, window - gram + 1, shard, scratch)
    scratch.drop("contexts")
    return spans_of_rows(found, told, later, window)


def cut_spans(text: bytes, spans) -> tuple[int, bytes]:
    """Number of maximal removed runs, and what remains."""
    out, at, runs = [], 0, 0
    for s in spans or ():
        if s["start"] > at or not runs:
            out.append(text[at : s["start"]])
            runs += 1
        at = max(at, s["end"])
    return runs, b"".join([*out, text[at:]])


def without_repeated_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each row's bytes outside 400-byte strings that occur elsewhere too.

    Strings are judged on the input and never cross rows; all their places go, the first one too. Null
    text: no bytes. Rows that repeat are places of their own. A null doc_id is as good as any. No rows: no rows.
    """
    rows = keyed_rows(docs)
    marked = rows.join(repeated_spans(rows), ["row", "doc_id"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            texts = b.column("text").to_pylist()
            made = [cut_spans(t, s) for t, s in zip(texts, b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, (_, k) in zip(texts, made)], pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([k for _, k in made], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    made = marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op7_suffixes(docs: DataFrame) -> DataFrame:
    """Bytes of each row, how many go in how many runs, and the digest of the rest; see ``without_repeated_bytes`` for odd rows."""
    return without_repeated_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (
  SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 399)) AS i FROM d WHERE length(h) >= 800),
x AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, md5(substr(h, 2 * i - 1, 800)) AS k FROM p) QUALIFY count(*) OVER (PARTITION BY k) > 1),
r AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
  FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM x)),
g AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 399 AS b FROM r GROUP BY doc_id, run),
n AS (
  SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY run), 0) AS past FROM g),
s AS (
  SELECT n.doc_id, CAST(sum(b - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * past + 1, 2 * (a - 1 - past)), '' ORDER BY run) AS head, max(b) AS last
  FROM n JOIN d ON n.doc_id = d.doc_id GROUP BY n.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN s.doc_id IS NULL THEN h ELSE concat(head, substr(h, 2 * last + 1)) END)) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
