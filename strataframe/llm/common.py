"""What the operators of this subpackage share: reading, scratch tables, word rules.

Words are maximal runs of anything but the six characters x20 and x09-x0D. ``bytes.split()``
and ``bytes.lower()`` follow exactly these rules (ASCII only), so the Python stages work on UTF-8
bytes and never on ``str``, whose methods would also touch other alphabets.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blank characters of every contract, as the inside of a character class.
BLANKS = "\\x20\\x09-\\x0D"
#: The same characters for trim functions.
BLANK_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session without one gets a folder of its own; on a cluster that would be one that executors don't see.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="strataframe-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


#: Folders of scratch tables that this session has opened and not dropped.
_folders: list[tuple[SparkSession, str]] = []


class Scratch:
    """A folder of its own for the intermediate tables of one call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/strataframe/{name}-{uuid.uuid4().hex}"
        _folders.append((spark, self.root))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """Write a stage's result to the shared folder and go on from the written table.

        Cuts the lineage in a way that survives lost executors, and keeps an expensive
        stage from running once for each of its readers.
        """
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables of the folder that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.path(name))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def scratch_mark() -> int:
    return len(_folders)


def drop_scratch(since: int = 0) -> None:
    """Delete the scratch folders that were opened since a ``scratch_mark``, once what the calls returned has been
    written or isn't needed: results are lazy and read their last scratch tables."""
    while len(_folders) > since:
        _delete(*_folders.pop())


def checkpointed(df: DataFrame) -> DataFrame:
    """checkpoint() of a small frame, as the rounds of an iterative job need it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def text_of(docs: DataFrame) -> Column:
    """The text, null as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def utf8(docs: DataFrame) -> Column:
    return F.encode(text_of(docs), "UTF-8")


def row_key(docs: DataFrame) -> Column:
    """What tells one row's decisions from another's: id and text.

    Rows that repeat both share every decision, so nothing else is needed to send a decision back
    to its row, and rows that repeat only the id keep apart.
    """
    return F.xxhash64(docs["doc_id"], F.coalesce(docs["text"], F.lit("")))


def one_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """One row of those that share the ``keys``: the one whose columns have the least hash.

    Summed up before the shuffle, so a key that a third of the rows share leaves each task as one row.
    """
    rest = [f"`{c}`" for c in rows.columns if c not in keys]
    least = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("__sf_one"))
    return least.select(*keys, "__sf_one.*")


#: Stands for a null id where ids are keys: such rows are one document, smaller than all others.
NO_ID = -(1 << 63)


def id_key(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
