"""The history tables on storage: reading, checking and writing them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.history import History
from strataframe.schemas import REQUIRED, SCHEMA_VERSION, TABLES


class ArtifactNotFound(FileNotFoundError):
    """Names the required tables that are missing."""


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table in the folder ``name``, else in the file ``name.parquet``, else None.

    Read with the declared schema: columns that an older writer didn't know come as null.
    """
    for path in (f"{root.rstrip('/')}/{name}", f"{root.rstrip('/')}/{name}.parquet"):
        try:
            df = spark.read.schema(TABLES[name]).parquet(path)
            return df.select(*[x for x in df.columns if x != "batch"])  # the folders of a stream's batches
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return None


def open_history(spark: SparkSession, root: str, views: bool = False) -> History:
    found = {name: read_table(spark, root, name) for name in (*REQUIRED, "releases", "skipped")}
    missing = [name for name in REQUIRED if found[name] is None]
    if missing:
        raise ArtifactNotFound(f"{root}: missing {', '.join(missing)}")
    if views:
        for name, df in found.items():
            if df is not None:
                df.createOrReplaceTempView(name)
    return History(found["events"], found["commits"], found["term_snapshots"], found["releases"])


def write_table(df: DataFrame, root: str, name: str, mode: str = "overwrite", rows_per_file: int = 5_000_000) -> None:
    """Part files of the declared schema; an empty table is written as one too. Entities are clustered for skipping."""
    spark = df.sparkSession
    want = spark.createDataFrame([], TABLES[name]).schema
    have = set(df.columns)
    shaped = df.select(*[(df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
    if "term_id" in df.columns:
        # row groups of few entities: a filter on one reads few of them
        shaped = shaped.repartitionByRange("term_id", "commit_seq").sortWithinPartitions("term_id", "commit_seq")
    shaped.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{root.rstrip('/')}/{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``); a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="strataframe-")
    return f"{named.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def no_shuffles_left(spark: SparkSession):
    """What is written within leaves no shuffle files behind, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_history(history: History, root: str) -> None:
    """Commits, events, snapshots and releases of a history, to be opened and asked often."""
    for name, df in (("commits", history.commits), ("events", history.events), ("term_snapshots", history.snapshots), ("releases", history.releases_table)):
        if df is not None:
            write_table(df, root, name)


def build_meta(commits: DataFrame, source_path: str, generator: str) -> DataFrame:
    return commits.agg(F.min("commit_seq").alias("first_commit_seq"), F.max("commit_seq").alias("last_commit_seq"), F.count(F.lit(1)).cast("int").alias("n_commits")).select(
        F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(generator).alias("generator_version"), F.lit(source_path).alias("source_path"),
        "first_commit_seq", "last_commit_seq", "n_commits",
    )


def compact(spark: SparkSession, root: str, name: str, to: str) -> None:
    """Rewrite a table of many small part files into few, under another root."""
    df = read_table(spark, root, name)
    if df is None:
        raise ArtifactNotFound(f"{root}: missing {name}")
    write_table(df, to, name)
