"""Line dedup: range-partitioned hashes, secondary sort, first occurrences, keep bitmaps.

Lines become (128-bit hash of the key, doc_id, position). These are range-partitioned by hash and
descending doc_id and sorted by the same and position, so a key's first document in the stream is the one
that keeps its lines. As the range includes the document, a key that a third of all lines
share runs over many partitions instead of filling one. A task streams its rows and decides every run
that lies within it; of the run that may go on across its edge it only says how many
documents it saw. Those notes are two a partition, so joining them is a broadcast of bounded size.
The result is a compressed bitmap of kept lines for each document that loses any.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import BLANK_CHARS, Scratch, id_key, row_key, shuffle_partitions, text_of

MIN_CHARS, MIN_DOCS = 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: kind 0: drop this line; 1: drop it if its run proves to be long enough; 2: note on a run.
FOUND = "kind int, h1 long, h2 long, doc_id long, row long, pos int, docs long"


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    lines = docs.select(docs["doc_id"].cast("long").alias("doc_id"), row_key(docs).alias("row"), F.posexplode(F.split(text_of(docs), "\n", -1)).alias("pos", "line"))
    key = F.translate(F.btrim("line", F.lit(BLANK_CHARS)), UPPER, LOWER)
    keyed = lines.select("doc_id", "row", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"), "doc_id", "row", "pos")


def stream_runs(min_docs: int):
    """Rows sorted by (h1, h2, doc_id descending, row, pos) -> rows of FOUND."""

    def pack(kind, h1, h2, doc, none, row, pos, docs):
        n = len(h1)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int32)), pa.array(h1), pa.array(h2), pa.array(doc, mask=none), pa.array(row), pa.array(pos), pa.array(np.broadcast_to(np.int64(docs), n).copy())],
            names=["kind", "h1", "h2", "doc_id", "row", "pos", "docs"],
        )

    def run(batches):
        head = None  # the partition's first run: its rows can't be decided here
        state = None  # (h1, h2), number of documents, first and last document, rows of the second document
        for batch in batches:
            h1, h2, row, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "row", "pos"))
            none = np.asarray(batch.column("doc_id").is_null())
            doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            n = len(h1)
            if not n:
                continue
            new_run = np.ones(n, bool)
            new_run[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new_doc = new_run.copy()
            new_doc[1:] |= (doc[1:] != doc[:-1]) | (none[1:] != none[:-1])
            if state is not None and state["key"] == (h1[0], h2[0]):
                new_run[0] = False
                new_doc[0] = (doc[0], none[0]) != state["doc"]
            starts = np.flatnonzero(new_run)
            bounds = [0, *([s for s in starts if s > 0]), n]
            ordinal = np.cumsum(new_doc)
            drop = np.zeros(n, bool)
            for a, b in zip(bounds[:-1], bounds[1:]) if len(bounds) < 3 else ((bounds[0], bounds[1]), (bounds[-2], bounds[-1])):
                # the first and last run of a batch go through the carried state
                if new_run[a]:
                    if state is not None:
                        yield from close(state, head, pack)
                    state = {"key": (h1[a], h2[a]), "docs": 0, "doc": None, "top": (doc[a], none[a]), "held": [], "head": head is None}
                    if head is None:
                        head = state
                count = state["docs"] + (ordinal[a:b] - (ordinal[a - 1] if a else 0))
                if a == 0 and b < n and len(bounds) > 2:
                    middle = slice(b, bounds[-2])
                else:
                    middle = None
                if state["head"]:
                    yield pack(1, h1[a:b], h2[a:b], doc[a:b], none[a:b], row[a:b], pos[a:b], 0)
                else:
                    total = count[-1]
                    later = count >= 2
                    if total >= min_docs:
                        for x in state["held"]:
                            yield pack(0, *x, 0)
                        state["held"] = []
                        drop[a:b] |= later
                    elif later.any():
                        m = np.flatnonzero(later) + a
                        state["held"].append((h1[m], h2[m], doc[m], none[m], row[m], pos[m]))
                state["docs"] = int(count[-1])
                state["doc"] = (doc[b - 1], none[b - 1])
                if middle is not None:
                    i, j = middle.start, middle.stop
                    yield from close(state, head, pack)
                    if i < j:
                        first = np.flatnonzero(new_run[i:j]) + i
                        sizes = np.diff(np.append(first, j))
                        base = np.repeat(ordinal[first], sizes)
                        docs_in = np.repeat(np.append(ordinal[first[1:]] - 1, ordinal[j - 1]) - ordinal[first] + 1, sizes)
                        drop[i:j] = (docs_in >= min_docs) & (ordinal[i:j] > base)
                    state = None
            if drop.any():
                yield pack(0, h1[drop], h2[drop], doc[drop], none[drop], row[drop], pos[drop], 0)
        if state is not None:
            yield from close(state, head, pack, last=True)

    def close(state, head, pack, last=False):
        """Notes on a run that touches the partition's edge, and what it still holds."""
        if state["head"] or last:
            top, none = state["top"]
            one = lambda v, t: np.array([v], t)
            yield pack(2, one(state["key"][0], np.int64), one(state["key"][1], np.int64), one(top, np.int64), one(none, bool), one(0, np.int64), one(0, np.int32), state["docs"])
            for x in state["held"]:
                yield pack(1, *x, 0)
        state["held"] = []

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, pos) of every line that goes."""
    rows = line_rows(docs, min_chars)
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc_nulls_last()]
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order, "row", "pos")
    found = Scratch(docs.sparkSession, "lines").stored(dealt.mapInArrow(stream_runs(min_docs), FOUND), "runs")
    notes = found.filter("kind = 2").groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("top"))
    notes = notes.filter(F.col("all_docs") >= min_docs)
    # two notes a partition at most
    edge = found.filter("kind = 1").drop("docs").join(F.broadcast(notes), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("top")))
    return found.filter("kind = 0").select("doc_id", "row", "pos").unionByName(edge.select("doc_id", "row", "pos")).distinct()


def bitmap(n: int, positions: list[int]) -> bytes:
    keep = np.ones(n, np.uint8)
    keep[positions] = 0
    return zlib.compress(np.packbits(keep).tobytes())


def kept_mask(n: int, packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8), count=n).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, row (see ``row_key``), n_bits, n_dropped, keep_bits of each document that loses lines.

    keep_bits is zlib over one bit a line, high bit first, up to the last dropped line; lines
    after it stay. Documents that lose nothing have no row. A line's key is the line
    without blanks at its ends and in lower case (A-Z); a key of ``min_chars`` code points or more in
    ``min_docs`` distinct doc_ids or more stays only in the largest of them, null ids being the smallest.
    """
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "row").agg(F.collect_list("pos").alias("gone"))

    def pack(batches):
        for b in batches:
            gone = [np.array(x) for x in b.column("gone").to_pylist()]
            n = [int(x.max()) + 1 for x in gone]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("row"), pa.array(n, pa.int32()), pa.array([len(x) for x in gone], pa.int64()), pa.array([bitmap(k, x) for k, x in zip(n, gone)], pa.binary())],
                names=["doc_id", "row", "n_bits", "n_dropped", "keep_bits"],
            )

    return gone.mapInArrow(pack, "doc_id long, row long, n_bits int, n_dropped long, keep_bits binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The texts with what their row of ``bitmaps`` says; by row hash and id, so that hashes that meet cost nothing."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"), row_key(docs).alias("key"), id_key(docs).alias("id"))
    marks = bitmaps.select(F.col("row").alias("key"), id_key(bitmaps).alias("id"), "n_bits", "n_dropped", "keep_bits")
    return rows.join(marks, ["key", "id"], "left")


def kept_text(text: str, n_bits: int, packed: bytes) -> str:
    lines = text.split("\n")
    keep = kept_mask(n_bits, packed)
    return "\n".join([x for i, x in enumerate(lines) if i >= n_bits or keep[i]])


def op3_lines(docs: DataFrame) -> DataFrame:
    """Null or empty text: one empty line, which stays. No rows: no rows. Repeated rows: the same result each."""
    joined = with_bitmaps(docs, keep_bitmaps(docs))

    def cut(batches):
        for b in batches:
            out = [t if z is None else kept_text(t, n, z) for t, n, z in zip(*(b.column(c).to_pylist() for c in ("text", "n_bits", "keep_bits")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_lines"), b.column("n_dropped"), pa.array(out, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    n_lines = (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines")
    sha = F.sha2("kept", 256).alias("kept_sha256")
    whole = joined.filter("keep_bits is null").select("doc_id", n_lines, F.lit(0).cast("long").alias("n_dropped"), F.col("text").alias("kept"))
    less = joined.filter("keep_bits is not null").select("doc_id", n_lines, "n_dropped", "text", "n_bits", "keep_bits")
    less = less.mapInArrow(cut, "doc_id long, n_lines long, n_dropped long, kept string")
    return whole.unionByName(less).select("doc_id", "n_lines", "n_dropped", sha)


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (
  SELECT k.doc_id, k.pos, k.line, (g.key IS NOT NULL AND k.doc_id <> g.top) AS gone FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
