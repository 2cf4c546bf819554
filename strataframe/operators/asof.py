"""The state of entities at many points at once: one sort of probes and states together, or one rank of each, never a product."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strataframe.sources.artifact import shared_folder

_KEYS = ("__by", "__at", "__probe", "__id")


def asof(probes: DataFrame, states: DataFrame, by: str, at: str) -> DataFrame:
    """probes with ``state_at``: the greatest ``at`` of a state of the same ``by`` that isn't after the probe's, null where there is none.

    Both sides are range-partitioned and sorted together by (by, at), so an entity with a third of all probes runs over many
    partitions. What is sorted is written below the shared folder, as its partitions are numbered. A partition passes on one row, the last state of the entity at its end. Probes keep their rows, however often they
    repeat; null keys match nothing. ``at`` is a whole number.
    """
    spark = probes.sparkSession
    given = probes.withColumn("__id", F.xxhash64(*probes.columns))  # splits probes that agree in both keys
    kind = lambda n: F.lit(n).cast("int").alias("__probe")
    left = given.select(F.col(by).cast("string").alias("__by"), F.col(at).cast("long").alias("__at"), kind(1), "__id", F.struct(*probes.columns).alias("__row"))
    right = states.select(F.col(by).cast("string").alias("__by"), F.col(at).cast("long").alias("__at"), kind(0), F.lit(0).cast("long").alias("__id")).distinct().filter("__by is not null and __at is not null")
    both = left.unionByName(right.withColumn("__row", F.lit(None).cast(left.schema["__row"].dataType)))
    schema = T.StructType([*both.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__state", T.LongType()), T.StructField("__last", T.BooleanType())])
    kinds = [*to_arrow_schema(both.schema).types, pa.int32(), pa.int64(), pa.bool_()]

    def run(batches):
        """Each row with the last state before it in its partition; the last state of all once more, marked."""
        part, entity, state = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids, ats = b.column("__by").fill_null("").to_numpy(zero_copy_only=False), b.column("__at").fill_null(0).to_numpy(zero_copy_only=False)
            here = b.column("__probe").to_numpy(zero_copy_only=False) == 0
            n = np.arange(b.num_rows)
            first = np.maximum.accumulate(np.where(np.concatenate([[True], ids[1:] != ids[:-1]]), n, 0))
            near = np.maximum.accumulate(np.where(here, n, -1))
            known = near >= first
            value, ok = np.where(known, ats[np.maximum(near, 0)], 0), known
            if state is not None and ids[0] == entity:
                carried = (first == 0) & ~known
                value, ok = np.where(carried, state, value), ok | carried
            entity, state = ids[-1], int(value[-1]) if ok[-1] else None
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(value, pa.int64(), mask=~ok), pa.array(np.zeros(b.num_rows, bool))], names=schema.names)
        if state is not None:
            one = {"__by": entity, "__at": state, "__probe": 0, "__id": 0, "__row": None, "__part": part, "__state": state, "__last": True}
            yield pa.RecordBatch.from_arrays([pa.array([one[name]], kind) for name, kind in zip(schema.names, kinds, strict=True)], names=schema.names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in _KEYS]
    path = shared_folder(spark, "asof")
    both.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    sorted_rows = spark.read.schema(schema).parquet(path)
    # a row a partition, each the greatest of its entity there
    ends = sorted_rows.filter("__last").select(F.col("__by").alias("__end"), F.col("__part").alias("__from"), F.col("__state").alias("__carried"))
    w = Window.partitionBy("__end").orderBy("__from")
    ends = ends.withColumn("__to", F.lead("__from").over(w))
    found = sorted_rows.filter("__probe = 1")
    open_rows = found.filter("__state is null")
    # the last partition before a probe's own in which its entity ended with a state: at most one row a partition is sent
    carried = open_rows.join(F.broadcast(ends), (F.col("__by") == F.col("__end")) & (F.col("__from") < F.col("__part")) & (F.col("__to").isNull() | (F.col("__to") >= F.col("__part"))), "left")
    done = found.filter("__state is not null").select("__row.*", F.col("__state").alias("state_at"))
    return done.unionByName(carried.select("__row.*", F.col("__carried").alias("state_at")))


def states_at_releases(snapshots: DataFrame, commits: DataFrame, releases: DataFrame) -> DataFrame:
    """(tag, term_id, commit_seq, content_hash): the latest snapshot of every entity at every release.

    Releases are numbered along the axis; a snapshot holds for a stretch of numbers, up to the entity's next one, and is repeated
    only over its own. Rows that no release sees are dropped before anything is joined with clauses.
    """
    per_commit = releases.groupBy("commit_seq").agg(F.count(F.lit(1)).alias("n"))
    axis = commits.select("commit_seq").join(per_commit, "commit_seq", "left")
    order = Window.orderBy("commit_seq")  # a row a commit
    ranked = axis.select("commit_seq", (F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    total = releases.agg(F.count(F.lit(1)).alias("total"))
    numbered = releases.select("tag", (F.row_number().over(Window.orderBy("commit_seq", "tag")) - 1).cast("long").alias("place"))
    shots = snapshots.select("term_id", "commit_seq", "content_hash").join(ranked, "commit_seq")
    until = F.coalesce(F.lead("before").over(Window.partitionBy("term_id").orderBy("commit_seq")), F.lit(None))
    spans = shots.withColumn("until", until).select("*", F.coalesce("until", F.lit(total.scalar())).alias("end")).filter("before < end")
    held = spans.select("term_id", "commit_seq", "content_hash", F.explode(F.sequence("before", F.col("end") - 1)).alias("place"))
    return held.join(numbered, "place").select("tag", "term_id", "commit_seq", "content_hash")
