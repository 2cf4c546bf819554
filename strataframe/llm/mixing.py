"""Mixing sources to target weights: random order, distributed prefix sums, exact cuts.

Every row gets a hash-random key. Its leading digits put it into one of ``BUCKETS`` ranges of its
source; a range's word total is summed over the cluster, the totals of a source are
added up in range order, and within a range the rows are sorted by key and summed on from there.
So no source, however hot, meets in one task: a task holds a 4096th of a source at
most, and the only frame that is gathered by source has a row per range.

Rows that repeat id and text share a key and would be one range, so they are counted first, with partial sums, and one row with
their number goes through the ranges. At the end it is told apart into parts of ``COPIES``, which are dealt anew
before they become rows again. Texts are read once: both branches read the counted rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.llm.common import BLANKS, shuffle_partitions, text_of

#: Weights by rank of the source name, repeating.
WEIGHTS = (5, 2, 1)
#: Share of all words that the mix has, and the times that a source may repeat.
SHARE, REPEATS = 1.5, 2
#: Hex digits of the key that name its range: 3 make 4096 ranges a source.
RANGE_DIGITS = 3
BUCKETS = 16**RANGE_DIGITS
#: Rows that a part of repeated rows becomes, at most.
COPIES = 1024


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    # rows without an id are told apart, and spread over the ranges, by their texts
    name = F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("text "), F.sha2(text_of(docs), 256)))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), name))
    return docs.select(
        docs["doc_id"],
        docs["source"].isNull().alias("no_source"),
        F.coalesce(docs["source"], F.lit("")).alias("source_key"),
        F.regexp_count(text_of(docs), F.lit(f"[^{BLANKS}]+")).cast("long").alias("size"),
        key.alias("mix_key"),
        F.substring(key, 1, RANGE_DIGITS).alias("mix_range"),
        # ties of the key are repeats of an id: texts tell them apart
        F.xxhash64(text_of(docs)).alias("tie"),
    )


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Per source its target: ``least(repeats * size, level * weight)`` with one level for all.

    Sharing by weight, stopping at the cap and resharing the excess until none is above ends
    at that level. It is found by sorting the sources by cap / weight: the sources up to
    some place are capped, the others share what is left, and the level is the share of the first
    place whose level isn't above its own ratio. One row per source, so single-partition windows.
    """
    by_name = Window.orderBy("no_source", "source_key")
    everything = Window.partitionBy()
    ranked = by_source.withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    )
    cap = F.col("source_size") * F.lit(float(repeats))
    ratio = ranked.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    up_to = Window.orderBy("ratio", "no_source", "source_key")
    before = up_to.rowsBetween(Window.unboundedPreceding, -1)
    onwards = up_to.rowsBetween(0, Window.unboundedFollowing)
    level = ratio.withColumn(
        "level",
        (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / F.sum("weight").over(onwards),
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no_source", "source_key", "level"))).over(everything)
    return level.select(
        "no_source", "source_key", "source_size",
        F.least(F.col("cap"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight")).alias("target"),
    )


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each row the mix takes.

    A source takes whole epochs while they fit into its target and then the rows that come first
    by random key, the last of them in part, up to exactly its rounded target.

    Null text: size 0, taken 0. Null source: a source of its own, last by name. Null doc_id: such rows
    are keyed by text. Rows that repeat an id are rows of their own. No rows: no rows.
    Extra columns are left out.
    """
    place = ["no_source", "source_key", "mix_range"]
    order = ["mix_key", "doc_id", "tie", "size"]
    rows = sized(docs, seed).groupBy(*place, *order).agg(F.count(F.lit(1)).alias("copies"))
    words = F.col("size") * F.col("copies")
    ranges = rows.groupBy(*place).agg(F.sum(words).alias("range_size"))
    by_source = ranges.groupBy("no_source", "source_key").agg(F.sum("range_size").alias("source_size"))
    so_far = Window.partitionBy("no_source", "source_key").orderBy("mix_range")
    ranges = ranges.withColumn("ahead", F.sum("range_size").over(so_far) - F.col("range_size"))
    plan = ranges.join(targets(by_source, weights, share, repeats), ["no_source", "source_key"])
    within = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    # what the last epoch has left at the first of the copies
    left = budget - F.col("epochs") * F.col("source_size") - (F.col("ahead") + F.col("through") - words)
    placed = rows.withColumn("through", F.sum(words).over(within)).join(plan, place).withColumn("epochs", epochs).withColumn("left", left)
    parts = placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source_key")).alias("source"), "size", "source_size", "target", "epochs", "left", "copies", "mix_key",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))).alias("part"),
    ).repartition(shuffle_partitions(docs.sparkSession), "mix_key", "part")
    first = F.col("part") * COPIES
    each = parts.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("copies")) - 1)))
    extra = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("left") - F.col("copy") * F.col("size")))
    return each.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("epochs") + extra).cast("long").alias("taken"))


def op6_mixing(docs: DataFrame) -> DataFrame:
    """Size, target and words taken of each row; see ``mix`` for odd rows."""
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('0:' || CAST(doc_id AS VARCHAR)) AS k
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows_ GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM by_source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM by_source) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (
  SELECT source, source_size,
         least(cap, (SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight) AS target
  FROM l),
s AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
  FROM rows_ d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM s)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""
