"""Benchmark decontamination: BM25 over the test items, block-max WAND, overlap of question and answer.

The test items are the indexed side: their inverted index is small and goes to every task, in shards
of at most ``SHARD_ITEMS`` items and ``SHARD_BYTES`` bytes, so a benchmark of any size is few passes
over the documents (mostly one) and never an index without a bound. Counts and lengths that scores rest on are of all items, so
they are the same however the items are dealt. Each document is cut into passages that
overlap by the longest item, so an item that a document holds lies whole in one of them. A passage's
distinct words are the query. Impacts are divided by the item's score for its own text, which makes scores
shares of that and the threshold one number. The block maxima of a passage's words add up to a bound for
each block of items, in one product a passage; blocks that stay under the threshold are skipped, and in
the others WAND skips every item that its words' bounds can't lift to it. What a passage retrieves
is verified by five-word shingles of question and answer over the whole document, so the two may stand far apart.

A narrow map over the documents: no shuffle, and the documents' other columns can ride along.
"""

from __future__ import annotations

import math
import pickle
from array import array
from bisect import bisect_left
from collections import Counter
from itertools import islice
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Scratch, table, utf8

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to be verified.
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
PASSAGE = 128
#: Items of a block: few, as the bound of a block is what keeps passages from being scored.
BLOCK = 4
#: What one pass over the documents takes of the benchmark.
SHARD_ITEMS, SHARD_BYTES = 32768, 16 << 20
#: Terms whose block maxima are gathered at once.
TERMS_AT_ONCE = 4096
#: For rounding in sums of impacts.
SLACK = 1e-5
#: ASCII punctuation counts as blank, A-Z as a-z.
FOLD = bytes(ord(c.lower()) if "A" <= c <= "Z" else c_ if (c.isalnum() or c_ > 127) else 32 for c_, c in ((i, chr(i)) for i in range(256)))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def shingles(words, size: int = SHINGLE) -> set:
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def parts(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Question and answer: what stands before and after the last line break; else the halves of the words."""
    head, line, tail = text.rstrip().rpartition(b"\n")
    question, answer = words_of(head), words_of(tail)
    if not line or not question or not answer:
        words = words_of(text)
        return words[: (len(words) + 1) // 2], words[(len(words) + 1) // 2 :]
    return question, answer


class Index:
    """Inverted index of some items: postings with impacts, and each term's largest impact in each block of items."""

    def __init__(self, items: list[tuple[int, bytes]], n_all: int, mean_words: float, df: dict[bytes, int], longest: int = 0):
        self.ids = [i for i, _ in items]
        both = [parts(t) for _, t in items]
        words = [q + a for q, a in both]
        self.longest = max(longest, *map(len, words), 0)
        self.needed = [[shingles(q), shingles(a)] for q, a in both]
        self.terms: dict[bytes, int] = {}
        self.items: list[array] = []
        self.impacts: list[array] = []
        for i, w in enumerate(words):
            impacts = {}
            for t, tf in Counter(w).items():
                idf = math.log(1 + (n_all - df[t] + 0.5) / (df[t] + 0.5))
                impacts[t] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(w) / max(mean_words, 1e-9)))
            own = sum(impacts.values())
            for t, x in impacts.items():
                k = self.terms.setdefault(t, len(self.items))
                if k == len(self.items):
                    self.items.append(array("i"))
                    self.impacts.append(array("d"))
                self.items[k].append(i)
                self.impacts[k].append(x / own)
        self.tops = None

    def block_tops(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's entries start, their blocks and largest impacts: as many as the postings at most."""
        if self.tops is None:
            starts, blocks, tops = [0], [], []
            for items, impacts in zip(self.items, self.impacts):
                own: dict[int, float] = {}
                for i, x in zip(items, impacts):
                    own[i // BLOCK] = max(x, own.get(i // BLOCK, 0.0))
                blocks.append(np.fromiter(own.keys(), np.int32, len(own)))
                tops.append(np.fromiter(own.values(), np.float64, len(own)))
                starts.append(starts[-1] + len(own))
            self.tops = (np.array(starts), np.concatenate(blocks), np.concatenate(tops))
        return self.tops

    def bounds(self, terms: np.ndarray) -> np.ndarray:
        """What the items of each block can score at most for the distinct ``terms``; so many terms at a time."""
        starts, blocks, tops = self.block_tops()
        n = -(-len(self.ids) // BLOCK)
        out = np.zeros(n)
        for k in range(0, len(terms), TERMS_AT_ONCE):
            low = starts[terms[k : k + TERMS_AT_ONCE]]
            size = starts[terms[k : k + TERMS_AT_ONCE] + 1] - low
            at = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
            out += np.bincount(blocks[at], tops[at], n)
        return out

    def retrieve(self, terms: list[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """WAND within a block: (item, score) of its items that score ``threshold`` or more for the distinct ``terms``."""
        low, high = block * BLOCK, (block + 1) * BLOCK
        cursors, found = [], []
        for t in terms:
            at = bisect_left(self.items[t], low)
            if at < len(self.items[t]) and self.items[t][at] < high:
                end = bisect_left(self.items[t], high, at)
                cursors.append([self.items[t][at], t, at, max(self.impacts[t][at:end])])
        while cursors:
            cursors.sort()
            bound, item = 0.0, None
            for c in cursors:
                bound += c[3]
                if bound + SLACK >= threshold:
                    item = c[0]
                    break
            if item is None:
                break
            score = 0.0
            for c in cursors:
                if c[0] > item:
                    break
                items = self.items[c[1]]
                c[2] = bisect_left(items, item, c[2])
                if c[2] < len(items) and items[c[2]] == item:
                    score += self.impacts[c[1]][c[2]]
                    c[2] += 1
                c[0] = items[c[2]] if c[2] < len(items) else high
            if score + SLACK >= threshold:
                found.append((item, score))
            cursors = [c for c in cursors if c[0] < high]
        return found

    def matches(self, text: bytes, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float, float]]:
        """item number -> (score, question overlap, answer overlap): the best passage's score, the shares of the whole text.

        One passage has to reach ``threshold``; from then on the item's shingles count wherever they stand.
        """
        words = words_of(text)
        n, scored = len(words), {}
        if not n or not self.items:
            return {}
        ids = np.array([self.terms.get(w, -1) for w in words], np.int64)
        at = np.flatnonzero(ids >= 0)
        ids = ids[at]
        length = max(PASSAGE, 2 * self.longest)
        starts = np.arange(0, max(1, n - self.longest), length - self.longest)
        first, last = np.searchsorted(at, starts).tolist(), np.searchsorted(at, starts + length).tolist()
        # where the same word stood before: a passage counts a word where that is outside of it
        order = np.argsort(ids, kind="stable")
        before = np.full(len(ids), -1)
        again = ids[order[1:]] == ids[order[:-1]]
        before[order[1:][again]] = at[order[:-1][again]]
        for start, a, b in zip(starts.tolist(), first, last):
            if a == b:
                continue
            new = before[a:b] < start
            bounds = self.bounds(ids[a:b][new])
            if bounds.max() + SLACK < threshold:
                continue
            terms = ids[a:b][new].tolist()
            for block in np.flatnonzero(bounds + SLACK >= threshold).tolist():
                for item, score in self.retrieve(terms, block, threshold):
                    scored[item] = max(score, scored.get(item, 0.0))
        return self.verified(words, scored, overlap)

    def verified(self, words: list[bytes], scored: dict[int, float], overlap: float) -> dict[int, tuple[float, float, float]]:
        """Those of the retrieved items that the words hold; only shingles of these items are kept while the words pass."""
        wanted: dict[int, set] = {}
        for item in scored:
            for s in set().union(*self.needed[item]):
                wanted.setdefault(len(s), set()).add(s)
        held, out = set(), {}
        for size, own in wanted.items():
            held |= own.intersection(zip(*(islice(words, k, None) for k in range(size))))
        for item, score in scored.items():
            have = [len(p & held) for p in self.needed[item]]
            total = sum(map(len, self.needed[item]))
            shares = [h / len(p) if p else 1.0 for h, p in zip(have, self.needed[item])]
            if total and sum(have) >= overlap * total and min(shares) > 0:
                out[item] = (score, *shares)
        return out


def index_shards(benchmark: DataFrame):
    """One ``Index`` after the other. Counts cover all items; each shard's size is bounded before it is collected."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), utf8(benchmark).alias("text"))
    n, total = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n:
        return
    shards = max(1, math.ceil(n / SHARD_ITEMS), math.ceil(total / SHARD_BYTES))
    # as words_of: A-Z alone are folded
    plain = F.translate(F.regexp_replace(F.decode("text", "UTF-8"), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", " "), ascii_uppercase, ascii_lowercase)
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).alias("shard")
    scratch = Scratch(items.sparkSession, "benchmark")
    numbered = scratch.stored(items.select("item_id", "text", shard, F.filter(F.split(plain, " "), lambda w: w != "").alias("words")), "items")
    mean, longest = numbered.agg(F.avg(F.size("words")), F.max(F.size("words"))).first()
    each = numbered.select("shard", F.explode(F.array_distinct("words")).alias("w"))
    # how many of all items have a word, for the words of each shard
    counts = scratch.stored(each.distinct().join(each.groupBy("w").agg(F.count(F.lit(1)).alias("df")), "w"), "counts")
    for k in range(shards):
        rows = [(r.item_id, bytes(r.text)) for r in numbered.filter(F.col("shard") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        df = {r.w.encode(): r.df for r in counts.filter(F.col("shard") == k).select("w", "df").collect()}
        yield Index(rows, n, mean or 0.0, df, longest or 0)
    scratch.drop("items", "counts")


def sent(spark, index: Index):
    """An index on its way to the tasks -> a function that gives it there.

    Plain broadcasts name classes by their module, which workers may lack; these bytes bring the class along.
    """
    bytes_ = spark.sparkContext.broadcast(cloudpickle.dumps(index))
    return lambda: pickle.loads(bytes_.value)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each item that a row's text holds.

    Null texts and items hold no words and match nothing; neither do items without words. Rows that
    repeat give their rows again. No documents or no items: no rows. Other columns are left out, whatever their names.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs).alias("text"))
    out = None
    for index in index_shards(benchmark):
        get = sent(docs.sparkSession, index)

        def run(batches, get=get):
            index = get()
            for b in batches:
                rows = [(d, index.ids[i], *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()) for i, m in index.matches(t, threshold, overlap).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = texts.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; a narrow filter.

    Null and empty texts stay, and null and empty items match nothing. Rows that repeat are judged each, alike. No
    documents: no rows; no items: all rows. Columns of any name ride along.
    """
    for index in index_shards(benchmark):
        get = sent(docs.sparkSession, index)

        def run(batches, get=get):
            index = get()
            for b in batches:
                at = b.schema.get_field_index("text")
                keep = [not (t and index.matches(t.encode(), threshold, overlap)) for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontam(spark, sf_dir: str) -> DataFrame:
    """``leaks`` of all documents, for all items."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
