"""Substring dedup: suffix automata of reference shards, matching statistics, maximal spans.

Broadcasting the automata of all shards to all documents would be work in the product of both and memory
without a bound, so the shards are cut by anchor (see ``anchors``): copies of a 50-word window have the same
anchor, so a document has to be streamed only through the automata of its own anchors.

1. One Arrow pass emits a row per context: anchor, digest of its words, document, windows.
2. Equal contexts are combined by their digest, so that words that very many documents share travel once.
3. The distinct contexts of one anchor are a reference shard: the first
   document of each context brings its words, and they are streamed in order of documents through the shard's
   suffix automaton, which then takes them in. Windows that end where the matching statistic is 50
   or more occur in an earlier document. If later documents have the same context, it is streamed once more for them, when the
   automaton knows the first one's words. Every removed window comes from these statistics. Results go back to places
   by (anchor, context), a join which AQE splits where one is hot.
4. An anchor of more than ``SHARD`` distinct contexts is split by further k-grams (see ``matching``) into shards that
   are small enough, and these go the same way.
5. All spans of a document go back to it; its words outside of them are what is kept.

Steps 3 and 5 read the words through one shuffle of the texts by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm import anchors
from strataframe.llm.common import NO_ID, Scratch, id_key, row_key, utf8
from strataframe.llm.matching import CONTEXTS, PASSAGES, RANGES, repeated_windows, spans_of_rows

WINDOW, GRAM = 50, 16
#: Distinct contexts of an anchor that one automaton takes; anchors of more are split.
SHARD = 256
#: Bytes of texts that a task has as Python objects at once, but for whole texts.
PIECE = 1 << 20


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the words joined by one space."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1] + 1
    return starts, ends


def pieces(batch: pa.RecordBatch):
    """Yields the batch in slices of about ``PIECE`` bytes of text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = [0, *(np.flatnonzero(np.diff(size // PIECE)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def context_rows(parts, names: list[str]) -> pa.RecordBatch:
    """parts: (anchors, digests, first, last, *values of the other columns: (name, type, value)) of each text."""
    sizes = [len(p[0]) for p in parts]
    at = pa.array(np.repeat(np.arange(len(parts)), sizes))
    join = lambda i, kind: pa.array(np.concatenate([p[i] for p in parts]).astype(kind))
    made = {"anchor": join(0, np.int64), "context": pa.array([d for p in parts for d in p[1]], pa.binary()), "first": join(2, np.int32), "last": join(3, np.int32)}
    for k, (name, kind, _) in enumerate(parts[0][4:]):
        made[name] = pa.array([p[4 + k][2] for p in parts], kind).take(at)
    return pa.RecordBatch.from_arrays([made[n] for n in names], names=names)


def word_contexts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    def run(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            parts = []
            for text, doc, row in zip(b.column("text").to_pylist(), b.column("doc_id").to_pylist(), b.column("row").to_pylist()):
                words = text.split()
                if len(words) >= window:
                    parts.append((*anchors.contexts(b" ".join(words), *word_bounds(words), window, gram), ("doc_id", pa.int64(), doc), ("row", pa.int64(), row)))
            if parts:
                yield context_rows(parts, ["anchor", "context", "doc_id", "row", "first", "last"])

    return docs.mapInArrow(run, CONTEXTS)


def split_contexts(bounds, window: int, gram: int):
    """depth -> a map from PASSAGES to the contexts within them, of so many k-grams (PARTS).

    Those of a context with several places come twice, the second time as of its largest document. ``bounds`` gives where the elements of some bytes start and end.
    """

    def at_depth(depth: int):
        def run(batches):
            for b in batches:
                for a, c, d, z, several, text in zip(*(b.column(n).to_pylist() for n in ("anchor", "context", "doc_id", "last_id", "several", "words"))):
                    starts, ends = bounds(text)
                    made = anchors.contexts(text, starts, ends, window, gram, depth)
                    n = len(made[0])
                    same = lambda v, t, n=n: pa.array([v] * n, t)
                    words = [text[x:y] for x, y in zip(starts[made[2]].tolist(), ends[made[3] + window - 1].tolist())]
                    row = int.from_bytes(c[:8], "little", signed=True) ^ a
                    for later, doc in ((False, d), (True, z))[: 1 + several]:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(made[0]), pa.array(made[1], pa.binary()), same(doc, pa.int64()), same(row ^ later, pa.int64()), pa.array(made[2].astype(np.int32)), pa.array(made[3].astype(np.int32)), same(a, pa.int64()), same(c, pa.binary()), same(later, pa.bool_()), pa.array(words, pa.binary())],
                            names=["anchor", "context", "doc_id", "row", "first", "last", "up_anchor", "up_context", "up_later", "words"],
                        )

        return run

    return at_depth


def passages_of(rows: DataFrame, wanted: DataFrame, cut) -> DataFrame:
    """rows (doc_id, row, text), what is wanted of places -> PASSAGES. cut: text, first and last windows -> the elements of each.

    What is wanted of a text is one array, so that the text goes to Python once and not with each of its contexts.
    """
    own = ["anchor", "context", "kinds", "last_id", "several"]
    lists = wanted.groupBy("row", "doc_id").agg(F.collect_list(F.struct("first", "last", *own)).alias("wanted"))

    def run(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            lists = b.column("wanted")
            made, sizes = lists.flatten(), pc.list_value_length(lists).to_pylist()
            first, last = made.field("first").to_pylist(), made.field("last").to_pylist()
            out, at = [], 0
            for text, n in zip(b.column("text").to_pylist(), sizes):
                out += cut(text, first[at : at + n], last[at : at + n])
                at += n
            columns = {c: made.field(c) for c in own} | {"doc_id": b.column("doc_id").take(pc.list_parent_indices(lists)), "words": pa.array(out, pa.binary())}
            names = [x.split()[0] for x in PASSAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return rows.join(lists, ["row", "doc_id"]).select("text", "doc_id", "wanted").mapInArrow(run, PASSAGES)


class SuffixAutomaton:
    """Of several word sequences. Streaming a sequence through it gives its matching statistics."""

    def __init__(self):
        self.next, self.link, self.length = [{}], [-1], [0]

    def _copy(self, state: int, parent: int, word) -> int:
        """Split off the part of ``state`` that is one word longer than ``parent``."""
        q = len(self.next)
        self.next.append(dict(self.next[state]))
        self.length.append(self.length[parent] + 1)
        self.link.append(self.link[state])
        self.link[state] = q
        while parent >= 0 and self.next[parent].get(word) == state:
            self.next[parent][word] = q
            parent = self.link[parent]
        return q

    def add(self, words) -> None:
        last = 0
        for w in words:
            known = self.next[last].get(w)
            if known is not None:
                last = known if self.length[known] == self.length[last] + 1 else self._copy(known, last, w)
                continue
            state = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][w]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._copy(q, p, w)
            last = state

    def statistics(self, words) -> list[int]:
        """For each word, how many words up to it are a stretch of some sequence taken in."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state = self.next[state][w]
                n += 1
            else:
                n = 0
            out.append(n)
        return out


def runs_of(flags) -> list[tuple[int, int]]:
    """Maximal runs of true as (start, end)."""
    f = np.concatenate(([0], np.asarray(flags, np.int8), [0]))
    d = np.flatnonzero(np.diff(f))
    return list(zip(d[::2].tolist(), d[1::2].tolist()))


def match_shards(window: int):
    """PASSAGES sorted by anchor and doc_id -> the windows that earlier documents have, of the first place and of later documents' places."""
    kinds = (pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32())

    def matched(automaton, anchor, context, later, words):
        stats = automaton.statistics(words)
        return [(anchor, context, later, x, y) for x, y in runs_of([s >= window for s in stats[window - 1 :]])]

    def take_in(automaton, waiting, anchor):
        """A document's contexts go in, and those that later documents have too are streamed for these."""
        for _, words, _ in waiting:
            automaton.add(words)
        return [x for c, words, again in waiting if again for x in matched(automaton, anchor, c, True, words)]

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), kinds)], names=["anchor", "context", "later", "start", "end"])

    def run(batches):
        anchor = doc = automaton = None
        waiting = []
        for b in batches:
            found = []
            for a, d, z, c, text in zip(*(b.column(n).to_pylist() for n in ("anchor", "doc_id", "last_id", "context", "words"))):
                if a != anchor or automaton is None:
                    if any(again for _, _, again in waiting):
                        found += take_in(automaton, waiting, anchor)
                    anchor, doc, automaton, waiting = a, d, SuffixAutomaton(), []
                if d != doc:  # a document doesn't match its own contexts
                    found += take_in(automaton, waiting, anchor)
                    doc, waiting = d, []
                words = text.split(b" ")
                if automaton.length[-1]:
                    found += matched(automaton, a, c, False, words)
                waiting.append((c, words, z > d))
            if found:
                yield batch_of(found)
        if any(again for _, _, again in waiting) and (found := take_in(automaton, waiting, anchor)):
            yield batch_of(found)

    return run


def duplicate_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """rows (doc_id, row, text), dealt by row -> row, doc_id and the sorted word spans that earlier documents have.

    doc_id must not be null here: callers put a number in its place.
    """
    scratch = Scratch(rows.sparkSession, "substrings")
    contexts = scratch.stored(word_contexts(rows, window, gram), "contexts")

    def cut(text, first, last):
        words = text.split()
        return [b" ".join(words[f : e + window]) for f, e in zip(first, last)]

    def bring(wanted):
        # rows that repeat bring the same words again, to no other effect than these
        return passages_of(rows, wanted, cut)

    def match(passages):
        return passages.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(match_shards(window), RANGES)

    def bounds(text):
        return word_bounds(text.split(b" "))

    later = F.col("home_id") < F.col("doc_id")
    found, told = repeated_windows(contexts, bring, match, split_contexts(bounds, window, gram), later, window - gram + 1, shard, scratch)
    scratch.drop("contexts")
    return spans_of_rows(found, told, later, window)


def keyed_rows(docs: DataFrame) -> DataFrame:
    """The texts, dealt by row once for all that read them."""
    return docs.select(id_key(docs).alias("doc_id"), row_key(docs).alias("row"), utf8(docs).alias("text")).repartition("row", "doc_id")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each row's words outside windows that a smaller doc_id has too.

    Windows are judged on the input. Null text: no words. Null doc_ids count as one document
    smaller than all others. Rows that repeat an id never remove each other's words and get a result each.
    No rows: no rows. Extra columns are left out.
    """
    rows = keyed_rows(docs)
    marked = rows.join(duplicate_spans(rows, window), ["row", "doc_id"], "left")

    def cut(batches):
        for b in (p for batch in batches for p in pieces(batch)):
            n, kept_n, kept = [], [], []
            spans = b.column("spans").to_pylist()
            for text, s in zip(b.column("text").to_pylist(), spans):
                words = text.split()
                n.append(len(words))
                if s:
                    keep = np.ones(len(words), bool)
                    for x in s:
                        keep[x["start"] : x["end"]] = False
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                kept_n.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept_n, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    made = marked.select("doc_id", "text", "spans").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept binary")
    return made.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op4_substrings(docs: DataFrame) -> DataFrame:
    """Words of each row, how many go, and the digest of the rest; see ``without_repeats`` for odd rows."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS i, w FROM d WHERE len(w) >= 50),
x AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
g AS (
  SELECT h, min(doc_id) AS first FROM x GROUP BY h),
c AS (
  SELECT DISTINCT x.doc_id, x.i + k.k AS i FROM x JOIN g USING (h), (SELECT unnest(generate_series(0, 49)) AS k) k WHERE x.doc_id > g.first),
a AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
m AS (
  SELECT a.doc_id, a.i, a.word, c.i IS NOT NULL AS gone FROM a LEFT JOIN c ON a.doc_id = c.doc_id AND a.i = c.i),
s AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
         string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
  FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
