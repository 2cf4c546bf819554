"""Exact dedup by a stateful stream: disk-backed keyed state that never expires.

The rows' manifest (digest, doc_id, locator; no text) is landed in the shared folder and
read as a stream. A streaming aggregation holds per digest the smallest id, its locator and the
number of rows, in a RocksDB state store on disk, with no watermark and so no expiry; a later file
of the same manifest meets the state of all earlier ones. Partial aggregation before the
shuffle keeps a digest that a third of the rows share down to a row for each task.

A digest that is met again is a hit, not yet a copy: the full normalised texts of hits are
compared with the text behind the stored locator, and rows that differ from it (a
collision of digests) are grouped anew by their text.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from strataframe.llm.common import BLANKS, Scratch, one_of_each, text_of

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: The state's settings. A store reserves megabytes of disk for its logs unless told otherwise; there is one for
#: each partition, so with many small ones that would outweigh what they hold.
STATE_CONF = {PROVIDER: ROCKSDB, "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}


def normalised(docs: DataFrame) -> Column:
    return F.regexp_replace(text_of(docs), f"[{BLANKS}]+", " ")


def first_seen(manifest: DataFrame) -> DataFrame:
    """The stateful operator: per digest the row that stays and the number of rows so far.

    ``manifest`` has digest, doc_id, locator and, to tell rows apart that repeat both, n. It may be a stream or a
    batch; over a stream the aggregation's state lives in the session's state store.
    """
    # A null id is larger than any other.
    order = F.struct(F.col("doc_id").isNull().alias("none"), *[c for c in ("doc_id", "locator", "n") if c in manifest.columns])
    return manifest.groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))


def run_stream(spark: SparkSession, source: DataFrame, state_path: str, out_path: str) -> DataFrame:
    """Drain ``source`` (a streaming manifest) through the state; returns the state's latest rows.

    ``state_path`` is the stream's checkpoint: with the same path a later call goes on from the kept
    state and reads only new files. Each micro-batch writes the digests that it touched into a
    folder of its own, so a batch that is run again replaces what it wrote.
    """
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        query = (
            first_seen(source).writeStream.outputMode("update")
            .foreachBatch(lambda df, n: df.select("digest", "first", "group_size").write.mode("overwrite").parquet(f"{out_path}/batch={n}"))
            .option("checkpointLocation", state_path)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    schema = first_seen(source).schema.add("batch", IntegerType())
    touched = spark.read.schema(schema).option("basePath", out_path).parquet(out_path)
    return touched.groupBy("digest").agg(F.max_by(F.struct("first", "group_size"), "batch").alias("s")).select("digest", "s.first", "s.group_size")


#: Micro-batches that a manifest is read in, at most, and their least number of files.
BATCHES, FILES = 16, 64


def decisions(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per row: doc_id, locator, digest, keep_id, group_size, kept.

    Equal are texts that are identical once each run of blanks is one space; null counts as empty.
    The smallest doc_id of a group stays (null ids come last). Of rows that repeat id and
    text one stays. No rows: no rows. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    text = normalised(docs)
    # numbers that tell rows apart; they are written, so they stay what they are
    n = F.monotonically_increasing_id().bitwiseXOR(F.lit(random.getrandbits(62)).cast("long")).alias("n")
    manifest = scratch.stored(
        docs.select(F.unhex(F.sha2(text, 256)).alias("digest"), docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text_of(docs)).alias("locator"), n), "manifest"
    )
    files = manifest.inputFiles()
    if not files:  # an empty table has no part files
        return manifest.select("doc_id", "locator", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    stream = spark.readStream.schema(manifest.schema).option("maxFilesPerTrigger", max(FILES, -(-len(files) // batches))).parquet(scratch.path("manifest"))
    # written, so that the join with it isn't bound to the aggregation's partitions and can be split where a digest is hot
    state = scratch.stored(run_stream(spark, stream, scratch.path("state"), scratch.path("out")), "latest")
    seen = manifest.join(state, "digest").select("doc_id", "locator", "n", "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_locator"), F.col("first.n").alias("keep_n"), "group_size")
    seen = scratch.stored(seen, "seen")
    scratch.drop("manifest", "state", "out", "latest")
    alone = seen.filter("group_size = 1").select(*DECIDED, F.lit(True).alias("kept"))
    return alone.unionByName(verified(docs, seen.filter("group_size > 1"), scratch))


DECIDED = ["doc_id", "locator", "digest", "keep_id", "group_size"]


def verified(docs: DataFrame, hits: DataFrame, scratch: Scratch) -> DataFrame:
    """Compare the full text of every hit with the one behind its group's locator.

    Texts travel only for hits: the join's other side, the whole table, is shuffled once
    by (doc_id, locator). Groups are compared through a second shuffle of the hits' texts' by locator
    of the row that stays, which AQE splits where a group is hot.
    """
    text = docs.select(docs["doc_id"].cast("long").alias("t_id"), F.xxhash64(text_of(docs)).alias("t_locator"), normalised(docs).alias("norm"))
    wanted = hits.select("doc_id", "locator").distinct()
    texts = scratch.stored(
        wanted.join(text, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("locator") == F.col("t_locator")))
        .groupBy("doc_id", "locator").agg(F.min("norm").alias("norm")),
        "texts",
    )
    kept_texts = hits.select("keep_id", "keep_locator").distinct().join(
        texts.select(F.col("doc_id").alias("k_id"), F.col("locator").alias("k_loc"), F.col("norm").alias("kept_norm")),
        F.col("keep_id").eqNullSafe(F.col("k_id")) & (F.col("keep_locator") == F.col("k_loc")),
    )
    own = hits.join(texts.select(F.col("doc_id").alias("o_id"), F.col("locator").alias("o_loc"), "norm"), F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("locator") == F.col("o_loc"))).select(*hits.columns, "norm")
    # written, so that the join of a hot group's rows with the one text that stays can be split
    kept = scratch.stored(kept_texts.select(F.col("keep_id").alias("j_id"), F.col("keep_locator").alias("j_loc"), "kept_norm"), "kept")
    pairs = own.join(kept, F.col("keep_id").eqNullSafe(F.col("j_id")) & (F.col("keep_locator") == F.col("j_loc")))
    other = F.when(F.col("norm") != F.col("kept_norm"), F.col("norm")).alias("other")
    pairs = scratch.stored(pairs.select(*DECIDED, "n", "keep_n", other), "pairs")
    scratch.drop("texts", "kept")
    same, clash = pairs.filter("other is null"), pairs.filter("other is not null")
    if clash.isEmpty():
        return same.select(*DECIDED, (F.col("n") == F.col("keep_n")).alias("kept"))
    # as many rows less as the digest's rows differ
    lost = clash.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
    less = same.join(lost, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce("lost", F.lit(0)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "locator", "n")).alias("first")
    anew = clash.groupBy("digest", "other").agg(first, F.count(F.lit(1)).alias("new_size"))
    more = clash.join(anew, ["digest", "other"]).select("doc_id", "locator", "digest", F.col("first.doc_id").alias("keep_id"), F.col("new_size").alias("group_size"), (F.col("n") == F.col("first.n")).alias("kept"))
    return less.select(*DECIDED, (F.col("n") == F.col("keep_n")).alias("kept")).unionByName(more)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that of the smallest doc_id, null ids last.

    Null counts as empty. Of rows that repeat id and text, the one whose other columns have the least hash
    stays. No rows: no rows. Columns of any name ride along.
    """
    stay = decisions(docs).filter("kept").select(F.col("doc_id").alias("__sf_id"), F.col("locator").alias("__sf_loc")).distinct()
    own = docs.withColumns({"__sf_own_id": docs["doc_id"].cast("long"), "__sf_own": F.xxhash64(text_of(docs))})
    single = one_of_each(own, "__sf_own_id", "__sf_own")
    kept = single.join(stay, F.col("__sf_own_id").eqNullSafe(F.col("__sf_id")) & (F.col("__sf_own") == F.col("__sf_loc")), "left_semi")
    return kept.select(*[f"`{c}`" for c in docs.columns])


def op10_exact(docs: DataFrame) -> DataFrame:
    """The row that stays for each row, and its group; see ``decisions`` for odd rows."""
    return decisions(docs).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""
