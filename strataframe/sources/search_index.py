"""Searching written events through an index: which files hold which three-character pieces of values.

A value that contains a text contains all of its pieces, so only files that have them all can hold a hit; these are scanned as
ever. Texts of under three characters, and patterns that need none, scan all files. Pieces are taken of values as they are and
folded, so searches of either kind find their candidates. Files that came after the index was written are scanned too, until
``index_events`` is called again, which reads only those.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.history import History
from strataframe.schemas import TABLES
from strataframe.sources.artifact import open_history

SIZE = 3
POSTINGS, KNOWN = "gram string, file string", "file string"
META = set("\\.[]{}()*+?|^$")
#: Letters that letters of other alphabets fold to, so a fold of a value need not have them.
FOLDED_TO = set("sSkKiI")


def grams(text: str) -> set[str]:
    return {text[i : i + SIZE] for i in range(len(text) - SIZE + 1)}


def literals(pattern: str, ignore_case: bool) -> list[str]:
    """Texts that every match of a pattern holds; none where that isn't plain to see."""
    if "|" in pattern or "(?" in pattern or "\\Q" in pattern:
        return []
    out, run, depth, i = [], "", 0, 0

    def end(drop: bool = False):
        nonlocal run
        out.append(run[:-1] if drop else run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            end()
            i += 2
            continue
        if c == "[":
            end()
            close = pattern.find("]", i + (3 if pattern[i + 1 : i + 2] == "^" else 2))
            if close < 0 or "[" in pattern[i + 1 : close] or "\\" in pattern[i:close]:
                return []
            i = close
        elif c in "()":
            end()
            depth += 1 if c == "(" else -1
        elif c in "*?{":
            end(drop=True)
            if c == "{":
                i = max(i, pattern.find("}", i))
        elif c in META or ignore_case and (not c.isascii() or c in FOLDED_TO):
            end()
        elif depth == 0:
            run += c
        i += 1
    end()
    return [x for x in out if len(x) >= SIZE]


def needed(query: str, regex: bool = False, ignore_case: bool = False) -> set[str]:
    """The pieces that a file must have to hold a hit."""
    texts = literals(query, ignore_case) if regex else [query]
    return set().union(*(grams(x.lower() if ignore_case else x) for x in texts))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _files(spark: SparkSession, root: str) -> list[str]:
    """The event files below ``root``/events, asked of the file system: a table that is cached doesn't name its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/events")
    fs, out = path.getFileSystem(spark._jsc.hadoopConfiguration()), []
    if fs.exists(path):
        listed = fs.listFiles(path, True)
        while listed.hasNext():
            one = listed.next().getPath()
            if one.getName().endswith(".parquet") and not one.getName().startswith(("_", ".")):
                out.append(one.toString().rpartition("/events/")[2])
    return sorted(out)


def _events(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    return spark.read.schema(TABLES["events"]).parquet(*(f"{root}/events/{f}" for f in files))


def index_events(spark: SparkSession, root: str) -> int:
    """Index the event files below ``root`` that aren't yet; their number. A row for each piece and file, in order of pieces."""
    known = {r.file for r in _read(spark, f"{root}/_grams/files", KNOWN).collect()}  # a row a file
    fresh = [f for f in _files(spark, root) if f not in known]
    if fresh:
        values = _events(spark, root, fresh).select(F.regexp_extract(F.input_file_name(), "^.*/events/(.*)$", 1).alias("file"), "value").distinct()
        both = values.select("file", F.explode(F.array_distinct(F.array("value", F.lower("value")))).alias("v")).filter(F.length("v") >= SIZE)
        # one walk over a value: a substring by position would count its characters anew for each
        pieces = F.array_distinct(F.regexp_extract_all("v", F.lit(f"(?s)(?=(.{{{SIZE}}}))"), F.lit(1)))
        found = both.select("file", F.explode(pieces).alias("gram")).distinct()
        found.select("gram", "file").repartitionByRange("gram").sortWithinPartitions("gram", "file").write.mode("append").option("compression", "zstd").parquet(f"{root}/_grams/postings")
        # last: what isn't listed here is scanned and indexed again, which only repeats rows
        spark.createDataFrame([(f,) for f in fresh], KNOWN).coalesce(1).write.mode("append").parquet(f"{root}/_grams/files")
    return len(fresh)


def candidates(spark: SparkSession, root: str, query: str, regex: bool = False, ignore_case: bool = False) -> list[str]:
    """The event files that may hold a hit."""
    every, pieces = _files(spark, root), needed(query, regex, ignore_case)
    if not pieces:
        return every
    known = {r.file for r in _read(spark, f"{root}/_grams/files", KNOWN).collect()}
    found = _read(spark, f"{root}/_grams/postings", POSTINGS).filter(F.col("gram").isin(sorted(pieces))).groupBy("file").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(pieces))
    hit = {r.file for r in found.collect()}  # files, not events
    return [f for f in every if f in hit or f not in known]


def indexed_search(spark: SparkSession, root: str, query: str, regex: bool = False, ignore_case: bool = False, **more) -> DataFrame:
    """``History.search`` that reads only the files that may hold a hit."""
    h, files = open_history(spark, root), candidates(spark, root, query, regex, ignore_case)
    events = _events(spark, root, files) if files else spark.createDataFrame([], TABLES["events"])
    return History(events, h.commits, h.snapshots, h.releases_table).search(query, regex=regex, ignore_case=ignore_case, **more)
