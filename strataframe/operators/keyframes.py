"""Another layout of a history: whole states at every so many commits, and what happens between.

Frame j holds the clauses of every entity as they are after commit j * every. Between two frames lie signed events, in a folder of their
own. The state at a commit is one frame and one signed sum over the events up to the commit: two folders are read, however
long the history is.

An entity's life is numbered (``ep``): removal ends one, and the next event begins another. A removed entity keeps its last clauses, marked
as not alive, until it comes back, as questions that aren't strict ask for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FRAMES = "frame int, term_id string, ep int, alive boolean, predicate string, value string, n int"
DELTAS = "frame int, commit_seq int, term_id string, ep int, removal boolean, predicate string, value string, sign int"
CLAUSE = ("term_id", "ep", "predicate", "value")


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that holds a row an entity or more, and is never broadcast: Spark would judge it by its files,
    and a few MB of these hold millions of entities."""
    return df.hint("merge")


def lives(events: DataFrame) -> DataFrame:
    """(term_id, commit_seq, ep, removal) of the commits that change an entity; a row each, no clauses."""
    sign = F.when(F.col("operation") == "add", 1).otherwise(-1)
    net = events.groupBy("term_id", "commit_seq").agg(F.sum(sign).alias("net"))
    w = Window.partitionBy("term_id").orderBy("commit_seq")
    removal = F.sum("net").over(w) == 0
    told = net.withColumn("removal", removal)
    return told.select("term_id", "commit_seq", F.coalesce(F.sum(F.col("removal").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int").alias("ep"), "removal")


def deltas_of(events: DataFrame, every: int) -> DataFrame:
    """DELTAS: signed events; those of frame j come after frame j - 1 and up to frame j's commit."""
    sign = F.when(F.col("operation") == "add", 1).otherwise(-1)
    own = events.groupBy("term_id", "commit_seq", "predicate", "value").agg(F.sum(sign).cast("int").alias("sign")).filter("sign <> 0")
    return own.join(shuffled(lives(events)), ["term_id", "commit_seq"]).select(F.ceil(F.col("commit_seq") / every).cast("int").alias("frame"), "commit_seq", "term_id", "ep", "removal", "predicate", "value", "sign")


def frames_of(deltas: DataFrame, last: int) -> DataFrame:
    """FRAMES up to the frame ``last``. Each count is repeated only in the frames where it holds, so work follows the result."""
    spans = deltas.groupBy("term_id", "ep").agg(F.min("frame").alias("born"), F.min(F.when(F.col("removal"), F.col("frame"))).alias("died"))
    spans = spans.withColumn("until", F.coalesce(F.lead("born").over(Window.partitionBy("term_id").orderBy("ep")), F.lit(last + 1)))
    steps = deltas.filter("not removal").groupBy(*CLAUSE, "frame").agg(F.sum("sign").alias("sign"))
    w = Window.partitionBy(*CLAUSE).orderBy("frame")
    counts = steps.select(*CLAUSE, "frame", F.sum("sign").over(w).cast("int").alias("n"), F.lead("frame").over(w).alias("next")).filter("n > 0")
    held = counts.join(shuffled(spans), ["term_id", "ep"]).withColumn("end", F.least(F.coalesce("next", "until"), "until")).filter("frame < end")
    held = held.withColumn("frame", F.explode(F.sequence("frame", F.col("end") - 1)))
    return held.select("frame", "term_id", "ep", (F.col("died").isNull() | (F.col("died") > F.col("frame"))).alias("alive"), "predicate", "value", "n")


class Keyframes:
    """Questions to frames and deltas, in tables or as written by ``write``."""

    def __init__(self, frames: DataFrame, deltas: DataFrame, every: int):
        self.frames, self.deltas, self.every = frames, deltas, every

    @classmethod
    def of(cls, events: DataFrame, every: int = 10) -> Keyframes:
        deltas = deltas_of(events, every)
        return cls(frames_of(deltas, -(-(events.agg(F.max("commit_seq")).first()[0] or 0) // every)), deltas, every)

    def write(self, root: str) -> None:
        """A folder a frame, entities in order within it, so both a frame and an entity are found without reading the others."""
        for name, df in (("frames", self.frames), ("deltas", self.deltas)):
            df.repartitionByRange("frame", "term_id").sortWithinPartitions("frame", "term_id").write.mode("overwrite").option("compression", "zstd").partitionBy("frame").parquet(f"{root}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, root: str, every: int) -> Keyframes:
        return cls(spark.read.schema(FRAMES).parquet(f"{root}/frames"), spark.read.schema(DELTAS).parquet(f"{root}/deltas"), every)

    def states_at(self, seq: int, term_id: str | None = None, strict: bool = False) -> DataFrame:
        """(term_id, predicate, value) at a commit, as ``History.states_at`` says it; a commit past the last one is the last."""
        mine: Column = F.lit(True) if term_id is None else F.col("term_id") == term_id
        frame = seq // self.every
        before = self.frames.filter((F.col("frame") == frame) & mine).select(*CLAUSE, F.col("n").alias("sign"), (~F.col("alive")).alias("removal"), F.lit(True).alias("counts"))
        after = self.deltas.filter((F.col("frame") == frame + 1) & (F.col("commit_seq") <= seq) & mine).select(*CLAUSE, "sign", "removal", (~F.col("removal")).alias("counts"))
        rows = before.unionByName(after)
        latest = rows.groupBy("term_id", "ep").agg(F.max("removal").alias("removed")).groupBy("term_id").agg(F.max(F.struct("ep", "removed")).alias("x")).select("term_id", "x.ep", "x.removed")
        if strict:
            latest = latest.filter("not removed")
        net = rows.filter("counts").groupBy(*CLAUSE).agg(F.sum("sign").cast("int").alias("n")).filter("n > 0")
        return net.join(shuffled(latest), ["term_id", "ep"]).select("term_id", "predicate", "value", F.explode(F.sequence(F.lit(1), "n")).alias("__n")).drop("__n").orderBy("term_id", "predicate", "value")
