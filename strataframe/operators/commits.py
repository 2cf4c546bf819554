"""Commit rows, releases and references on the linear axis of commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.text import pr_number, release_tag, snapshot_url


def derive(commits: DataFrame) -> DataFrame:
    """commits with pr_number and snapshot_url read from the message."""
    return commits.withColumns({"pr_number": pr_number(F.col("message")), "snapshot_url": snapshot_url(F.col("message"))})


def releases_asof(tags: DataFrame, commits: DataFrame) -> DataFrame:
    """tags (tag, sha, date) -> with commit_seq: the end of the longest run of first commits none of which is later.

    A commit whose date lies in the future of a tag hides those after it, so the plain as-of by date is
    wrong; by the running maximum of dates it is right. Tags before the first commit are dropped. Both tables
    are merged on time by one sort: no pair of tag and commit is formed. Commits are metadata, a row a version.
    """
    w = Window.orderBy("commit_seq").rowsBetween(Window.unboundedPreceding, 0)
    axis = commits.select(F.max("committed_date").over(w).alias("at"), "commit_seq").groupBy("at").agg(F.max("commit_seq").alias("commit_seq"))
    marks = axis.select("at", F.lit(0).alias("side"), "commit_seq", F.lit(None).cast("string").alias("tag"), F.lit(None).cast("string").alias("sha"))
    asked = tags.select(F.col("date").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("int").alias("commit_seq"), "tag", "sha")
    both = marks.unionByName(asked)
    found = both.withColumn("seq", F.last("commit_seq", ignorenulls=True).over(Window.orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)))
    return found.filter("side = 1 and seq is not null").select("tag", "sha", F.col("at").alias("date"), F.col("seq").alias("commit_seq"))


#: Stretches that a long sequence of versions is cut into, at most.
STRETCHES = 256


def unchanged_content(versions: DataFrame, content: str, order: str, stretches: int = STRETCHES) -> DataFrame:
    """Rows whose content differs from the row before: a new version. Others only lend their tag to the last kept one.

    Adds ``kept`` and ``version``, the order value of the kept row that the row stands for. ``order`` is a number and names
    each row; null content counts as empty. Contents are hashed where they are, and only (order, digest) goes through
    windows. The sequence is cut at quantiles of ``order`` into stretches, which have a window each; what one
    needs of those before it is a row a stretch.
    """
    places = [k / stretches for k in range(1, stretches)]
    cuts = sorted(set(versions.approxQuantile(order, places, 0.5 / stretches))) if places else []
    at = F.lit(0)
    if cuts:
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col(order)))
    told = versions.select(at.alias("__part"), F.col(order).alias("__order"), F.sha1(F.coalesce(F.col(content), F.lit(""))).alias("__digest"))
    w = Window.partitionBy("__part").orderBy("__order")
    marked = told.withColumn("__new", F.lag("__digest").over(w) != F.col("__digest"))  # null: the first of its stretch
    ends = marked.groupBy("__part").agg(
        F.min("__order").alias("start"), F.min_by("__digest", "__order").alias("first"), F.max_by("__digest", "__order").alias("last"), F.max(F.when(F.col("__new"), F.col("__order"))).alias("inner")
    )
    over = Window.orderBy("__part")  # of a row a stretch
    linked = ends.withColumn("__first_kept", F.coalesce(F.lag("last").over(over) != F.col("first"), F.lit(True)))
    newest = F.coalesce("inner", F.when(F.col("__first_kept"), F.col("start")))
    carried = linked.select("__part", "__first_kept", F.max(newest).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    done = marked.join(carried, "__part").withColumn("kept", F.coalesce("__new", "__first_kept"))
    version = F.coalesce(F.max(F.when(F.col("kept"), F.col("__order"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__carried")).alias("version")
    return versions.join(done.select("__order", "kept", version), F.col(order) == F.col("__order")).drop("__order")


def submissions(pages: DataFrame) -> DataFrame:
    """pages (body string: a JSON list of submissions, or an object with one as ``collection``) -> the rows of
    ``new_submissions``'s ``listed``. Other keys are left out; a page that isn't JSON gives no rows."""
    one = "struct<submissionId:bigint,version:string,released:string,creationDate:string,hasOntologyLanguage:string,description:string,contact:array<struct<name:string,email:string>>>"
    plain = F.from_json("body", f"array<{one}>")
    paged = F.from_json("body", f"struct<collection:array<{one}>>")["collection"]
    # an object read as a list gives one row of nulls, so the first character tells which it is
    found = pages.select(F.explode(F.when(F.ltrim("body").startswith("["), plain).otherwise(paged)).alias("s")).filter("s is not null")
    return found.select(
        F.col("s.submissionId").alias("submission_id"), "s.version", "s.released", F.col("s.creationDate").alias("creation_date"),
        F.col("s.hasOntologyLanguage").alias("language"), "s.description", "s.contact",
    )


def releases_listed(pages: DataFrame) -> DataFrame:
    """pages (body string: a JSON list of releases, or one alone) -> the rows of ``new_releases``'s ``listed``.

    Other keys are left out, missing ones are null, assets without a name don't count; a page that isn't JSON gives no rows.
    """
    one = "struct<tag_name:string,published_at:timestamp,body:string,html_url:string,draft:boolean,prerelease:boolean,author:struct<login:string>,assets:array<struct<name:string>>>"
    listed = F.when(F.ltrim("body").startswith("["), F.from_json("body", f"array<{one}>")).otherwise(F.array(F.from_json("body", one)))
    found = pages.select(F.explode(listed).alias("r")).filter("r.tag_name is not null")
    return found.select(
        "r.tag_name", F.to_utc_timestamp("r.published_at", F.current_timezone()).cast("timestamp_ntz").alias("published_at"), "r.body", "r.html_url", "r.draft", "r.prerelease",
        F.when(F.col("r.author.login") != "", F.col("r.author.login")).alias("author_login"), F.coalesce(F.array_compact("r.assets.name"), F.array().cast("array<string>")).alias("assets"),
    )


class NoSuchLanguage(ValueError):
    """None of the submissions is in the language that was asked for."""


def require_language(listed: DataFrame, language: str = "OBO") -> DataFrame:
    """``listed``, if any of it is in the language."""
    if listed.filter(F.col("language") == language).isEmpty():
        raise NoSuchLanguage(f"no submission in {language}")
    return listed


def new_releases(listed: DataFrame, known_tags: DataFrame, asset: str) -> DataFrame:
    """Published, final releases that have the asset and no tag yet, oldest first.

    listed: tag_name, published_at, body, html_url, draft, prerelease, author_login, assets array<string>.
    """
    good = listed.filter(~F.coalesce("draft", F.lit(False)) & ~F.coalesce("prerelease", F.lit(False)) & F.array_contains("assets", asset))
    fresh = good.join(known_tags.select(F.col("tag").alias("tag_name")), "tag_name", "left_anti")
    author = F.coalesce("author_login", F.lit("unknown"))
    body = F.when(F.trim("body") != "", F.trim("body"))
    return fresh.select(
        F.col("tag_name").alias("tag"), F.col("published_at").alias("date"), author.alias("author_name"),
        F.concat(author, F.lit("@users.noreply.github.com")).alias("author_email"),
        F.concat_ws("\n\n", "tag_name", body, F.concat(F.lit("Release URL: "), F.col("html_url"))).alias("message"),
    ).orderBy("date", "tag")


def new_submissions(listed: DataFrame, known_tags: DataFrame, language: str = "OBO") -> DataFrame:
    """Submissions of a language, one for each new tag (the earliest), by date as text.

    listed: submission_id, version, released, creation_date, language, description, contact array<struct<name,email>>.
    """
    date = F.coalesce(F.when(F.col("released") != "", F.col("released")), F.col("creation_date"))
    tag = release_tag(F.col("version"), F.col("submission_id"))
    rows = listed.filter(F.col("language") == language).select("submission_id", tag.alias("tag"), date.alias("date"), "contact")
    fresh = rows.join(known_tags.select("tag"), "tag", "left_anti")
    first = fresh.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("date", "submission_id"))).filter("n = 1")
    who = F.try_element_at("contact", F.lit(1))
    named = F.when(F.col("tag").startswith("sub-"), F.concat(F.lit("Submission #"), F.col("submission_id").cast("string"))).otherwise(F.col("tag"))
    # What stands for a missing contact.
    return first.select(
        "tag", "date", "submission_id", named.alias("subject"),
        F.coalesce(F.when(who["name"] != "", who["name"]), F.lit("BioPortal")).alias("author_name"),
        F.coalesce(F.when(who["email"] != "", who["email"]), F.lit("bioportal@bioontology.org")).alias("author_email"),
    ).orderBy("date", "tag")
