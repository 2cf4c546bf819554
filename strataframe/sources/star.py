"""A history view of star-schema tables: users as entities, days as commits, events as clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.changes import change_tables, number_readable, presence_of_state
from strataframe.operators.commits import derive, releases_asof
from strataframe.operators.history import History
from strataframe.operators.keyframes import Keyframes
from strataframe.schemas import BRANCH_COMMIT
from strataframe.sources.artifact import delete, no_shuffles_left, open_history, shared_folder, write_history
from strataframe.sources.search_index import index_events

#: What stands for the name and the obsolete flag in these tables.
NAME, OBSOLETE = "signup", ("error", "100")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts) -> F.Column:
    return F.datediff(ts.cast("date"), F.lit("2024-01-01").cast("date")).cast("int")


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("USER:"), F.lpad(F.col("user_id").cast("string"), 7, "0")).alias("term_id"),
        day(F.col("ts")).alias("commit_seq"),
        F.col("event_type").alias("predicate"),
        F.floor("value").cast("int").cast("string").alias("value"),
    )


def supplier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    month = lambda c: F.year(c) * 12 + F.month(c)
    first = items.agg(F.min(month(F.col("l_shipdate")))).scalar()
    return items.select(
        F.concat(F.lit("SUPP:"), F.lpad(F.col("l_suppkey").cast("string"), 7, "0")).alias("term_id"),
        (month(F.col("l_shipdate")) - first).cast("int").alias("commit_seq"),
        F.concat("l_returnflag", "l_linestatus").alias("predicate"),
        F.col("l_quantity").cast("int").cast("string").alias("value"),
    )


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.col("commit_seq")
    text = lambda c: c.cast("string")
    days = table(spark, sf_dir, "events").groupBy(day(F.col("ts")).alias("commit_seq")).agg(F.min("ts").alias("committed_date"))
    message = (
        F.when(seq % 3 == 0, F.concat(F.lit("daily load (#"), text(1000 + seq), F.lit(")")))
        .when(seq % 3 == 1, F.concat(F.lit("Merge pull request #"), text(2000 + seq), F.lit(" from u/b\n\nTitle "), text(seq), F.lit(" (#7)")))
        .otherwise(F.concat(F.lit("v"), text(seq), F.lit("\n\nnotes (#9)\nRelease URL: https://example.org/r/"), text(seq)))
    )
    return derive(days.select("commit_seq", F.sha1(text(seq)).alias("sha"), F.concat(F.lit("author-"), text(seq % 5)).alias("author_name"), "committed_date", message.alias("message")))


def branch_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_seq, branch_commits): what merges brought in, newest first."""
    parts = table(spark, sf_dir, "events").groupBy(day(F.col("ts")).alias("commit_seq"), "event_type").agg(F.max("ts").alias("at"))
    parts = parts.filter("commit_seq % 3 = 1")
    one = F.struct(F.col("at").alias("committed_date"), F.sha1(F.concat_ws("/", "commit_seq", "event_type")).alias("sha"), F.concat(F.lit("author-"), F.length("event_type").cast("string")).alias("author_name"), F.col("event_type").alias("message"))
    newest = F.reverse(F.array_sort(F.collect_list(one)))
    return parts.groupBy("commit_seq").agg(F.transform(newest, lambda x: F.struct(x["sha"].alias("sha"), x["author_name"].alias("author_name"), x["committed_date"].alias("committed_date"), x["message"].alias("message"))).alias("branch_commits"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commits(spark, sf_dir).filter("commit_seq % 7 = 3").select(F.concat(F.lit("v"), F.col("commit_seq").cast("string")).alias("tag"), "sha", F.col("committed_date").alias("date"))


def future_commits(rows: DataFrame) -> DataFrame:
    """The commits with the date of the fifth moved by ten days, so that dates aren't monotone."""
    return rows.withColumn("committed_date", F.when(F.col("commit_seq") == 5, F.col("committed_date") + F.expr("interval 10 days")).otherwise(F.col("committed_date")))


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return number_readable(commits(spark, sf_dir).select("commit_seq", "sha", F.lit("").alias("content")))


def history(spark: SparkSession, sf_dir: str, keep=lambda presence: presence) -> History:
    """``keep`` may write the presence of entities and give it back, so that the tables don't each work it out."""
    made = change_tables(keep(presence_of_state(state(spark, sf_dir))), numbered(spark, sf_dir), NAME, OBSOLETE)
    log = commits(spark, sf_dir)
    full = log.join(branch_commits(spark, sf_dir), "commit_seq", "left")
    return History(made["events"], full, made["term_snapshots"], releases_asof(tags(spark, sf_dir), log))


#: Where the histories of this application's driver tables have been written.
_written: dict[tuple[str, str], str] = {}


def stored_history(spark: SparkSession, sf_dir: str) -> History:
    """``history``, built and written once an application, and opened from there."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        root = shared_folder(spark, "history")
        write_history(history(spark, sf_dir, lambda presence: written(presence, f"{root}/_build/presence")), root)
        _written[key] = root
    return open_history(spark, _written[key])


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_prose(spark: SparkSession, sf_dir: str) -> str:
    """Where the history of texts has been written, with an index of its events."""
    key = (spark.sparkContext.applicationId, f"prose {sf_dir}")
    if key not in _written:
        root = shared_folder(spark, "prose")
        with no_shuffles_left(spark):
            write_history(prose_history(spark, sf_dir, lambda presence: written(presence, f"{root}/_build/presence")), root)
            delete(spark, f"{root}/_build")
            index_events(spark, root)
        _written[key] = root
    return _written[key]


EVERY = 7


def keyframes(spark: SparkSession, sf_dir: str) -> Keyframes:
    """The users' history as frames and deltas, built and written once an application."""
    key = (spark.sparkContext.applicationId, f"keyframes {sf_dir}")
    if key not in _written:
        root = shared_folder(spark, "keyframes")
        Keyframes.of(stored_history(spark, sf_dir).events, EVERY).write(root)
        _written[key] = root
    return Keyframes.open(spark, _written[key], EVERY)


def prose_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of three namespaces, with texts as values: documents, turns of conversations and pages."""
    read = lambda name, prefix, i, at, predicate, value: table(spark, sf_dir, name).select(
        F.concat(F.lit(prefix), F.col(i).cast("string")).alias("term_id"), (F.col(at) % 4).cast("int").alias("commit_seq"), predicate.alias("predicate"), F.coalesce(value, F.lit("")).alias("value")
    )
    docs = read("documents", "DOC:", "doc_id", "doc_id", F.coalesce("lang", F.lit("none")), "text")
    turns = read("conversations", "CONV:", "conv_id", "turn", F.coalesce("role", F.lit("none")), "text")
    return docs.unionByName(turns).unionByName(read("pages", "PAGE:", "page_id", "page_id", F.lit("url"), "url"))


def in_text_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a number ``n`` that begins with a digest of the text, so that equal ones follow each other."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digest = F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("long")
    return rows.withColumn("n", digest * 10_000_000_000 + F.col("doc_id"))


def prose_history(spark: SparkSession, sf_dir: str, keep=lambda presence: presence) -> History:
    made = change_tables(keep(presence_of_state(prose_state(spark, sf_dir))), numbered(spark, sf_dir).filter("vidx < 4"), NAME, OBSOLETE, long_values=True)
    log = commits(spark, sf_dir)
    return History(made["events"], log.withColumn("branch_commits", F.lit(None).cast(f"array<{BRANCH_COMMIT}>")), made["term_snapshots"], releases_asof(tags(spark, sf_dir), log))


def prose_once(spark: SparkSession, sf_dir: str) -> History:
    """``prose_history`` whose texts are gathered and written once for all that is asked of them."""
    root = shared_folder(spark, "prose-presence")

    def keep(presence: DataFrame) -> DataFrame:
        with no_shuffles_left(spark):
            return written(presence, root)

    return prose_history(spark, sf_dir, keep)


def documents(spark: SparkSession, sf_dir: str, mismatch: bool = False) -> DataFrame:
    """Versions of a document of stanzas, in parts: a user is an entity, its events of a day are clauses; a day is a version.

    A part holds one stanza, so no row grows with the number of users. Errors of value 13 are
    written so that their stanza can't be read. With ``mismatch`` every fifth user's id line has more than its id.
    """
    rows = state(spark, sf_dir)
    line = F.when((F.col("predicate") == "error") & (F.col("value") == "13"), F.lit('synonym: "y" VAGUELY [Z:9]')).otherwise(F.concat_ws(": ", "predicate", "value"))
    lines = rows.groupBy("commit_seq", "term_id", line.alias("line")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("line", "n"))), lambda x: F.repeat(F.concat(x["line"], F.lit("\n")), x["n"]))
    terms = lines.groupBy("commit_seq", "term_id").agg(F.array_join(body, "").alias("body"))
    more = F.when(F.lit(mismatch) & (F.substring_index("term_id", ":", -1).cast("int") % 5 == 0), " again").otherwise("")
    content = F.concat(F.lit("format-version: 1.2\n\n[Term]\nid: "), F.col("term_id"), more, F.lit(" ! user\n"), F.col("body"), F.lit("\n[Typedef]\nid: part_of\n"))
    return terms.select("commit_seq", F.sha1(F.col("commit_seq").cast("string")).alias("sha"), F.col("term_id").alias("part"), content.alias("content"))
