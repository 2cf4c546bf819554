"""Appending to a history as new versions arrive.

Versions come as files of a stream (commit_seq, sha, content; in order). A micro-batch is built from its own
versions and the heads that the batch before it left, so its work follows the batch and the number of
entities, not the length of the history. The axis is a total order, so there is nothing to wait for: no
watermark. Heads of all entities are written again each batch; where only what changed is at hand, ``entities`` keeps them as a
stream's state instead. A version at or before the last one that was built means that history was rewritten; the batch
is refused, and the caller builds anew.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.changes import HEADS, change_tables, heads_of, missing_content, number_readable, presence_of_documents, seeded

VERSIONS = "commit_seq int, sha string, content string"
POSITION = "last_seq int, last_vidx int"


class HistoryRewritten(ValueError):
    """A batch brings versions at or before the last built one."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_batch(versions: DataFrame, root: str, batch: int) -> None:
    """Build the tables of one micro-batch into folders of its number; doing it again replaces them."""
    spark = versions.sparkSession
    position = _read(spark, f"{root}/position", POSITION + ", batch int").filter(F.col("batch") < batch).orderBy(F.desc("batch")).first()
    last_seq, last_vidx, before = (position.last_seq, position.last_vidx, position.batch) if position else (-1, -1, None)
    span = versions.agg(F.min("commit_seq").alias("lo"), F.max("commit_seq").alias("hi")).first()
    if span.lo is None:
        return
    if span.lo <= last_seq:
        raise HistoryRewritten(f"version {span.lo} comes after {last_seq}")
    numbered = number_readable(versions).withColumn("vidx", (F.col("vidx") + last_vidx + 1).cast("int"))
    heads = spark.createDataFrame([], HEADS) if before is None else _read(spark, f"{root}/heads/batch={before}", HEADS)
    # worked out once for the tables and the heads
    path = f"{root}/_presence/batch={batch}"
    seeded(presence_of_documents(versions, numbered), heads).write.mode("overwrite").option("compression", "zstd").parquet(path)
    presence = spark.read.parquet(path)
    tables = change_tables(presence, numbered)  # the join with the new versions leaves the seeds out
    tables["skipped"] = tables["skipped"].unionByName(missing_content(versions))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
    top = numbered.agg(F.max("vidx")).first()[0]
    top = last_vidx if top is None else top
    heads_of(presence, top).write.mode("overwrite").parquet(f"{root}/heads/batch={batch}")
    # written last: a batch without a position is done again
    spark.createDataFrame([(span.hi, top)], POSITION).coalesce(1).write.mode("overwrite").parquet(f"{root}/position/batch={batch}")


def append_stream(spark: SparkSession, source: str, root: str, checkpoint: str, files_per_batch: int = 16):
    """Start the stream over the files in ``source``; it ends when what is there has been built."""
    stream = spark.readStream.schema(VERSIONS).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def build(df, n):
        held = df.persist()
        try:
            append_batch(held, root, n)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(build).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
