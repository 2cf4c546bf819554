"""Conversations in order, without any of them whole in one task.

Rows are range-partitioned by conversation and place, so a conversation of a third of all rows runs over many
partitions; each row gets the number of its partition and its place among the conversation's rows there. What has to be known beyond a
partition is a row a conversation and partition that it runs through.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.llm.common import shuffle_partitions

#: Turns without a number come first; rows of one turn go by role and text.
ORDER = ("conv_id", "turn", "role", "text")


def in_order(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """rows with part (int) and place (long, from 0 within conversation and part), sorted. No two rows may agree in all of ORDER.

    A row takes one place, or as many as the column ``weight`` says; then its place is the first of them.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType())])
    keys = [F.col(c).asc_nulls_first() for c in ORDER]

    def run(batches):
        part, before, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            ids, null = b.column("conv_id").fill_null(0).to_numpy(zero_copy_only=False), b.column("conv_id").is_null().to_numpy(zero_copy_only=False)
            new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])])
            starts = np.flatnonzero(new)
            takes = b.column(weight).to_numpy(zero_copy_only=False) if weight else np.ones(b.num_rows, np.int64)
            place = np.cumsum(takes) - takes
            place -= place[starts][np.cumsum(new) - 1]
            if before == (ids[0], null[0]):
                place[: starts[1] if len(starts) > 1 else None] += seen
            before, seen = (ids[-1], null[-1]), int(place[-1] + takes[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), pa.array(place)], names=[f.name for f in schema.fields])

    return rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def starts(counts: DataFrame, of: str = "total > 1") -> DataFrame:
    """(conv_id, part, n) -> (conv_id, part, before, total) of some conversations, such as those whose n are over 1 in all.

    before is the sum of n over the conversation's former parts. One list a conversation, of a struct a part.
    """
    by = F.sort_array(F.collect_list(F.struct("part", "n")))
    whole = counts.groupBy("conv_id").agg(by.alias("by"), F.sum("n").alias("total")).filter(of)
    summed = F.transform("by", lambda x, i: F.struct(x["part"].alias("part"), F.aggregate(F.slice("by", 1, i), F.lit(0).cast("long"), lambda s, y: s + y["n"]).alias("before")))
    return whole.select("conv_id", F.explode(F.when(F.size("by") > 1, summed).otherwise(F.transform("by", lambda x: F.struct(x["part"].alias("part"), F.lit(0).cast("long").alias("before"))))).alias("x"), "total").select("conv_id", "x.part", "x.before", "total")


def matched(a: DataFrame, b: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """a joined with b on keys in which null equals null; the keys once."""
    b = b.withColumnsRenamed({k: f"__sf_{k}" for k in keys})
    on = functools.reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__sf_{k}")) for k in keys))
    return a.join(b, on, how).drop(*(f"__sf_{k}" for k in keys))
