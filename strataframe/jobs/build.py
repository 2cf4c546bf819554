"""Build the tables of a history from a git clone, and answer questions to it from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from strataframe.operators import commits as lists
from strataframe.operators import views
from strataframe.operators.changes import tables_of_changes
from strataframe.operators.commits import derive, releases_asof
from strataframe.schemas import TABLES
from strataframe.sources import artifact, git, git_source
from strataframe.streaming.entities import keyed_stream

VERSION = "0.1"


def build_from_git(spark: SparkSession, repo: str, path: str, out: str, limit: int | None = None) -> dict[str, int]:
    """Write all tables; returns their row counts.

    Contents are read from git once, a stanza at a time, and only stanzas that changed leave the reader. These, and what they say, are
    written below ``out`` as tables that the others are made from, and may be removed afterwards.
    """

    def kept(df, name):
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/_build/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/_build/{name}")

    window = {} if limit is None else {"window": str(limit)}
    rows = git_source.git_table(spark, repo, path, "changes", **window)
    tables = tables_of_changes(kept(rows, "changes"), lambda parsed: kept(parsed, "parsed")) | commit_tables(spark, repo, path, **window)
    for name, df in tables.items():
        artifact.write_table(df, out, name)
    return {name: artifact.read_table(spark, out, name).count() for name in tables}


def commit_tables(spark: SparkSession, repo: str, path: str, **window) -> dict[str, DataFrame]:
    """commits, releases and build_meta: a row a commit or tag."""
    commits = derive(git_source.git_table(spark, repo, path, "commits", **window)).select(*spark.createDataFrame([], TABLES["commits"]).columns)
    return {"commits": commits, "releases": releases_asof(git_source.git_table(spark, repo, path, "tags"), commits), "build_meta": artifact.build_meta(commits, path, VERSION)}


def sync(spark: SparkSession, url: str, path: str, clone: str, out: str, since: str | None = None) -> None:
    """Clone, or fetch what is new, and append it to the tables below ``out``; to be called again whenever there may be more.

    Entities are kept as the state of a stream, whose checkpoint is below ``out`` too.
    """
    git.synced(url, clone, path, since=since)
    git_source.register(spark)
    changes = spark.readStream.format("git_history").options(file=path).load(clone)
    keyed_stream(changes, out, f"{out}/_checkpoint").awaitTermination()
    for name, df in commit_tables(spark, clone, path).items():
        artifact.write_table(df, out, name)


def fresh(spark: SparkSession, what: str, pages: str, known: str | None, asset: str) -> DataFrame:
    """What saved pages of releases or submissions bring that the releases of the tables below ``known`` don't have."""
    read = spark.read.text(pages, wholetext=True).withColumnRenamed("value", "body")
    tags = artifact.read_table(spark, known, "releases") if known else None
    tags = spark.createDataFrame([], "tag string") if tags is None else tags.select("tag")
    if what == "new-releases":
        return lists.new_releases(lists.releases_listed(read), tags, asset)
    return lists.new_submissions(lists.require_language(lists.submissions(read)), tags)


def printed(df) -> None:
    """All rows, a line each, as they come; never the whole result at once."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in row))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="strataframe")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("repo"), b.add_argument("path"), b.add_argument("out"), b.add_argument("--limit", type=int)
    y = sub.add_parser("sync")
    y.add_argument("url"), y.add_argument("path"), y.add_argument("clone"), y.add_argument("out"), y.add_argument("--since")
    sub.add_parser("repack").add_argument("clone")
    for name in ("new-releases", "new-submissions"):
        q = sub.add_parser(name)
        q.add_argument("pages"), q.add_argument("--known"), q.add_argument("--asset", default="")
    for name, *extra in (("term", "term_id"), ("commit", "sha"), ("pr", "number"), ("diff", "a", "b"), ("search", "query"), ("releases",)):
        q = sub.add_parser(name)
        q.add_argument("artifact")
        for x in extra:
            q.add_argument(x)
        for x in ("--only", "--at", "--since", "--namespace", "--term", "--predicate"):
            q.add_argument(x)
        q.add_argument("--limit", type=int)
        q.add_argument("--pr-link")
        q.add_argument("--former", action="append")
        for x in ("--regex", "--ignore-case", "--full", "--commits"):
            q.add_argument(x, action="store_true")
    a = p.parse_args(argv)
    if a.command == "repack":
        git.repack(a.clone)
        return 0
    spark = SparkSession.builder.appName("strataframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "build":
        print(build_from_git(spark, a.repo, a.path, a.out, a.limit))
        return 0
    if a.command == "sync":
        sync(spark, a.url, a.path, a.clone, a.out, a.since)
        return 0
    if a.command in ("new-releases", "new-submissions"):
        printed(fresh(spark, a.command, a.pages, a.known, a.asset))
        return 0
    try:
        h = artifact.open_history(spark, a.artifact)
    except artifact.ArtifactNotFound as e:
        print(e)
        return 1
    since = h.resolve(a.since) if a.since else None
    shown = {"cap": None if a.full else 200, "show_commits": a.commits, "pr_link": a.pr_link}
    if a.command == "term" and a.at:
        printed(h.states_at(h.resolve(a.at), a.term_id))
        return 0
    if a.command == "releases":
        printed(h.releases())
        return 0
    if a.command == "term":
        view = views.term_view(h, a.term_id, a.only, since, a.limit, tuple(a.former or ()), **shown)
    elif a.command == "commit":
        if h.commit(a.sha).first() is None:
            print(f"no commit {a.sha}")
            return 0
        view = views.commit_view(h, a.sha, a.namespace, **shown)
    elif a.command == "pr":
        view = views.pr_view(h, int(a.number), a.namespace, **shown)
    elif a.command == "diff":
        view = views.diff_view(h, a.a, a.b, a.term, a.namespace, **shown)
    else:
        view = views.search_view(h, a.query, a.term, a.predicate, since, a.regex, a.ignore_case, a.namespace, **shown)
    for row in view.select("line").toLocalIterator():
        print(row.line)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
