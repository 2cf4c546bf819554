"""Which windows of a corpus occur twice: contexts that meet by anchor, level by level.

Shared by the word and the byte operator. Equal contexts (see ``anchors``) are combined, so each distinct one is shuffled whole
only once, with how many places it has; a bounded task then compares those of an anchor. What is removed is always read from
that comparison. An anchor
with more than ``shard`` of them is split: each of its windows gets an anchor of more of its least k-grams, and the
same is done with the runs of windows that share that. When all k-grams of a window count, what an anchor still
has are windows that are equal. So every anchor goes the same way, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import Scratch

CONTEXTS = "anchor long, context binary, doc_id long, row long, first int, last int"
#: Contexts within a context: also which one, whether for its first or a later place, and its bytes.
PARTS = f"{CONTEXTS}, up_anchor long, up_context binary, up_later boolean, words binary"
#: Distinct contexts as they are compared: first place's document, largest one, whether there are several places.
PASSAGES = "anchor long, context binary, kinds long, doc_id long, last_id long, several boolean, words binary"
#: Windows that occur elsewhere: of places in the first document, or of later ones.
RANGES = "anchor long, context binary, later boolean, start int, end int"
#: By how much the number of k-grams of an anchor grows with each split.
FACTOR = 8


def shared_contexts(contexts: DataFrame, scratch: Scratch, level: int) -> tuple[DataFrame, DataFrame]:
    """All contexts -> (those whose anchor occurs again, what is known of each distinct one that has company).

    The second has anchor, context, home (the first place), last_id (the largest doc_id), n (places) and kinds (distinct contexts of the anchor), for
    contexts with several places or several kinds. Most anchors occur once; they leave after one small count, and
    only the rest is shuffled whole. Counts have partial sums and their results are written, so the joins with
    them split an anchor that very many places share.
    """
    again = scratch.stored(contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor"), f"again-{level}")
    found = scratch.stored(contexts.join(again, "anchor", "left_semi"), f"found-{level}")
    home = F.min(F.struct("doc_id", "row", "first", "last")).alias("home")
    distinct = scratch.stored(found.groupBy("anchor", "context").agg(home, F.max("doc_id").alias("last_id"), F.count(F.lit(1)).alias("n")), f"distinct-{level}")
    several = scratch.stored(distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), f"several-{level}")
    known = distinct.join(several, "anchor", "left").withColumn("kinds", F.coalesce("kinds", F.lit(1).cast("long"))).filter("n > 1 or kinds > 1")
    known = scratch.stored(known, f"known-{level}")
    scratch.drop(f"again-{level}", f"distinct-{level}", f"several-{level}")
    return found, known


def hits(found: DataFrame, told: DataFrame, later: Column, *keys: str) -> DataFrame:
    """keys, start, end: the windows of each place that occur elsewhere; ``later`` says of which kind a place is."""
    own = F.when(later, F.col("later_ranges")).otherwise(F.col("ranges"))
    moved = F.transform(own, lambda r: F.struct((r["start"] + F.col("first")).alias("start"), (r["end"] + F.col("first")).alias("end")))
    spans = F.explode(moved).alias("span")
    return found.join(told, ["anchor", "context"]).select(*keys, spans).select(*keys, "span.start", "span.end")


def repeated_windows(contexts: DataFrame, bring, match, split, later: Column, width: int, shard: int, scratch: Scratch, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """contexts (of CONTEXTS, written) -> (found, told), from which ``hits`` reads the windows of each place.

    bring: what is wanted of places (PASSAGES with row, first and last, but without words) -> PASSAGES.
    match: PASSAGES of whole anchors -> RANGES. split: depth -> a map from PASSAGES to PARTS; a context of several places gives
    its parts twice. later: whether a place is a later one, from doc_id and home_id. width: k-grams of a window.
    """
    found, known = shared_contexts(contexts, scratch, depth)
    wanted = known.select("anchor", "context", "kinds", "last_id", (F.col("n") > 1).alias("several"), "home.*")
    passages = scratch.stored(bring(wanted), f"passages-{depth}")
    columns = [x.split()[0] for x in PASSAGES.split(", ")]
    if depth >= width or (hot := passages.filter(F.col("kinds") > shard)).isEmpty():
        ranges = match(passages)
    else:
        deeper = min(width, depth * FACTOR)
        parts = scratch.stored(hot.mapInArrow(split(deeper), PARTS), f"parts-{deeper}")
        place = ["anchor", "context", "doc_id", "row", "first"]
        own = lambda wanted: parts.join(wanted.select(*place, "kinds", "last_id", "several"), place).select(*columns)
        below = repeated_windows(parts.drop("words"), own, match, split, later, width, shard, scratch, deeper)
        above = hits(*below, later, "up_anchor", "up_context", "up_later")
        above = above.select(F.col("up_anchor").alias("anchor"), F.col("up_context").alias("context"), F.col("up_later").alias("later"), "start", "end")
        ranges = match(passages.filter(F.col("kinds") <= shard)).unionByName(above)
    span = F.struct("start", "end")
    of = lambda which: F.collect_set(F.when(F.col("later") == which, span))
    ranges = ranges.groupBy("anchor", "context").agg(of(False).alias("ranges"), of(True).alias("later_ranges"))
    told = known.select("anchor", "context", F.col("home.doc_id").alias("home_id")).join(ranges, ["anchor", "context"])
    told = scratch.stored(told, f"told-{depth}")
    scratch.drop(f"known-{depth}", f"passages-{depth}")
    return found, told


def spans_of_rows(found: DataFrame, told: DataFrame, later: Column, window: int) -> DataFrame:
    """row, doc_id and the sorted spans of elements that repeated windows cover."""
    span = F.struct("start", (F.col("end") + (window - 1)).alias("end"))
    return hits(found, told, later, "row", "doc_id").groupBy("row", "doc_id").agg(F.sort_array(F.collect_set(span)).alias("spans"))
