"""A file's history in git as a data source, for batches and for streams.

    register(spark)
    spark.read.format("git_history").option("file", "lists/birds.obo").load(clone)
    spark.readStream.format("git_history").option("file", "lists/birds.obo").load(clone)

``table`` says which rows: ``changes`` (CHANGES: only stanzas with other bytes than in the version before, and those gone), ``commits``
or ``tags``. Partitions are ranges of commits (``versionsPerTask``); comparisons with commit_seq choose among them
before anything is read; ``window`` leaves only the last so many versions. A stream's offset is the number of versions and the last one's sha, so history that was
rewritten is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from strataframe.schemas import BRANCH_COMMIT, CHANGES
from strataframe.sources import git

TABLES = {
    "changes": CHANGES,
    "commits": f"commit_seq int, sha string, author_name string, author_email string, committed_date timestamp_ntz, message string, parent_sha string, branch_commits array<{BRANCH_COMMIT}>",
    "tags": "tag string, sha string, date timestamp_ntz",
}
_ARROW = pa.schema([("commit_seq", pa.int32()), ("sha", pa.string()), ("term_id", pa.string()), ("pos", pa.int32()), ("raw", pa.string()), ("stanza", pa.string())])
_ROWS, _BYTES = 2000, 8 << 20


class HistoryRewritten(ValueError):
    """The version that a stream read last isn't in its place any more."""


@dataclass
class Commits(ds.InputPartition):
    """A range of versions with the blobs before it, or rows that are listed already."""

    versions: list = field(default_factory=list)
    before: list = field(default_factory=list)
    first: int = 0
    rows: list | None = None


class _Reading:
    def __init__(self, options, table: str):
        self.repo, self.file, self.ref = options["path"], options.get("file"), options.get("ref", "HEAD")
        self.table, self.per_task = table, int(options.get("versionsPerTask", 32))
        self.window = int(options["window"]) if options.get("window") else None
        if table != "tags" and not self.file:
            raise ValueError('option "file" names the file in the repository')

    def opened(self, versions: list[tuple]) -> int:
        """The first version of the window; nothing counts as having been before it."""
        return 0 if self.window is None else max(0, len(versions) - self.window)

    def ranges(self, versions: list[tuple], start: int, end: int) -> list[Commits]:
        """Parts of versions[start:end], each with as many blobs before it, nearest first."""
        blobs, first = [v[3] for v in versions], self.opened(versions)
        return [
            Commits([(v[0], v[1], v[3]) for v in versions[i : min(i + self.per_task, end)]], blobs[max(first, i - self.per_task) : i][::-1], i - first)
            for i in range(start, end, self.per_task)
        ]

    def read(self, part: Commits):
        if part.rows is not None:
            yield from part.rows
            return
        with git.Blobs(self.repo) as blobs:
            before = part.before
            if part.first > len(before) and not any(_readable(blobs, b) for b in before):
                # the whole stretch before is missing: look further back
                versions, first = git.file_history(self.repo, self.file, self.ref)[1], part.versions[0][0] - part.first
                before = [v[3] for v in versions[first : first + part.first]][::-1]
            held, size = [], 0
            for row in git.changed_stanzas(blobs, part.versions, before):
                held.append(row)
                size += len(row[5] or "")
                if len(held) >= _ROWS or size >= _BYTES:
                    yield _batch(held)
                    held, size = [], 0
            if held:
                yield _batch(held)


def _readable(blobs: git.Blobs, blob: str) -> bool:
    lines = blobs.lines(blob)
    if lines is None:
        return False
    for _ in lines:
        pass
    return True


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class GitHistoryReader(_Reading, ds.DataSourceReader):
    def __init__(self, options, table):
        super().__init__(options, table)
        self.low, self.high, self.among = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if self.table == "tags" or getattr(f, "attribute", None) != ("commit_seq",) or not self._narrowed(f):
                yield f

    def _narrowed(self, f) -> bool:
        least = {ds.EqualTo: 0, ds.GreaterThan: 1, ds.GreaterThanOrEqual: 0}.get(type(f))
        most = {ds.EqualTo: 0, ds.LessThan: -1, ds.LessThanOrEqual: 0}.get(type(f))
        if isinstance(f, ds.In):
            among = set(f.value)
            self.among = among if self.among is None else self.among & among
            return True
        if least is not None:
            self.low = max(self.low, f.value + least)
        if most is not None:
            self.high = f.value + most if self.high is None else min(self.high, f.value + most)
        return least is not None or most is not None

    def partitions(self):
        if self.table == "tags":
            return [Commits(rows=git.tags(self.repo))]
        commits, versions = git.file_history(self.repo, self.file, self.ref)
        end = len(versions) if self.high is None else min(len(versions), self.high + 1)
        wanted = [i for i in range(max(self.low, self.opened(versions)), end) if self.among is None or i in self.among]
        if self.table == "commits":
            rows = [commits[i] for i in wanted]
            return [Commits(rows=rows[i : i + 1000]) for i in range(0, len(rows), 1000)] or [Commits(rows=[])]
        runs = [[i, i + 1] for i in wanted[:1]]
        for i in wanted[1:]:
            if runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        return [p for run in runs for p in self.ranges(versions, *run)] or [Commits(rows=[])]


class GitHistoryStream(_Reading, ds.DataSourceStreamReader):
    def initialOffset(self):
        return {"versions": 0, "sha": ""}

    def latestOffset(self):
        versions = git.file_history(self.repo, self.file, self.ref)[1]
        return {"versions": len(versions), "sha": versions[-1][1] if versions else ""}

    def partitions(self, start, end):
        versions = git.file_history(self.repo, self.file, self.ref)[1]
        for at in (start, end):
            n = int(at["versions"])
            if n > len(versions) or n and versions[n - 1][1] != at["sha"]:
                raise HistoryRewritten(f"version {n - 1} was {at['sha']} and isn't any more")
        return self.ranges(versions, int(start["versions"]), int(end["versions"])) or [Commits(rows=[])]


class GitHistory(ds.DataSource):
    @classmethod
    def name(cls):
        return "git_history"

    def _table(self) -> str:
        table = self.options.get("table", "changes")
        if table not in TABLES:
            raise ValueError(f"no table {table}: {', '.join(TABLES)}")
        return table

    def schema(self):
        return TABLES[self._table()]

    def reader(self, schema):
        return GitHistoryReader(self.options, self._table())

    def streamReader(self, schema):
        if self._table() != "changes":
            raise ValueError("only changes come as a stream")
        return GitHistoryStream(self.options, "changes")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitHistory)


def git_table(spark: SparkSession, repo: str, file: str, table: str, **options):
    register(spark)
    return spark.read.format("git_history").options(file=file, table=table, **options).load(repo)
