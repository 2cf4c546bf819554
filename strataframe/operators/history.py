"""Questions to a change history. Every method returns a DataFrame and runs nothing by itself but ``resolve``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.patterns import java_pattern
from strataframe.functions.text import MERGE_SUBJECT, date_prefix, first_line, short_sha, subject

COMMIT = ["commit_seq", "committed_date", "sha", "author_name", "pr_number", "message", "branch_commits", "snapshot_url"]
ROW = ["commit_seq", "committed_date", "sha", "author_name", "pr_number", "message", "operation", "predicate", "value", "branch_commits", "snapshot_url"]


def text_match(c: Column, query: str, regex: bool = False, ignore_case: bool = False) -> Column:
    """Whether ``query`` is in the text; patterns are those of linear-time engines (see ``patterns``), folding case beyond ASCII too."""
    if regex:
        return c.rlike(java_pattern(query, ignore_case))
    return F.lower(c).contains(query.lower()) if ignore_case else c.contains(query)


class History:
    """The tables of one history: events, commits, term_snapshots, releases.

    Joins carry no hints: commits are small and Spark broadcasts them where their size, as measured, allows it.
    """

    def __init__(self, events: DataFrame, commits: DataFrame, term_snapshots: DataFrame, releases: DataFrame | None = None):
        self.events, self.commits, self.snapshots, self._releases = events, commits, term_snapshots, releases

    @property
    def releases_table(self) -> DataFrame | None:
        return self._releases

    def _with_commits(self, events: DataFrame) -> DataFrame:
        return events.drop("sha").join(self.commits.select(*COMMIT), "commit_seq")

    def _with_names(self, events: DataFrame) -> DataFrame:
        return events.join(self.snapshots.select("term_id", "commit_seq", "name"), ["term_id", "commit_seq"], "left")

    @staticmethod
    def _in(namespace: str | None) -> Column:
        return F.lit(True) if namespace is None else F.col("term_id").startswith(f"{namespace}:")

    def timeline(self, term_id: str, predicate: str | None = None, since: int | None = None, last_commits: int | None = None, former: tuple[str, ...] = ()) -> DataFrame:
        """Changes of an entity, oldest first; from a commit on, or of its last so many commits.

        ``former`` are prefixes that its id had before the present one: changes under those ids are its own too.
        """
        ids = [term_id, *(f"{prefix}:{term_id.partition(':')[2]}" for prefix in former)]
        own = self.events.filter(F.col("term_id").isin(ids))
        if predicate is not None:
            own = own.filter(F.col("predicate") == predicate)
        if since is not None:
            own = own.filter(F.col("commit_seq") >= since)
        if last_commits is not None:
            own = own.withColumn("__id", F.lit(term_id))  # one entity, under whichever id
            rank = F.dense_rank().over(Window.partitionBy("__id").orderBy(F.desc("commit_seq")))
            own = own.withColumn("__rank", rank).filter(F.col("__rank") <= last_commits).drop("__rank", "__id")
        return self._with_commits(own).select(*ROW).orderBy("commit_seq", "operation", "predicate", "value")

    def predicate_counts(self, term_id: str, numbered: bool = False) -> DataFrame:
        """How many changes each predicate has, most first; ties as they first occur, where additions of a commit stand before its removals.

        ``numbered``: with the place in this order, from 1.
        """
        first = F.min(F.struct("commit_seq", "operation", "predicate", "value"))
        counts = self.events.filter(F.col("term_id") == term_id).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), first.alias("first"))
        order = [F.desc("n"), F.col("first")]
        if numbered:  # a row a predicate of one entity
            counts = counts.withColumn("place", F.row_number().over(Window.orderBy(*order)))
        return counts.orderBy(*order).select("predicate", "n", "first.commit_seq", *["place"] * numbered).withColumnRenamed("commit_seq", "first_seq")

    def headers(self, term_id: str | None = None) -> DataFrame:
        """First and last change, number of changes and latest name, of one entity or of all."""
        events, names = self.events, self.snapshots.filter("name is not null")
        if term_id is not None:
            events, names = (x.filter(F.col("term_id") == term_id) for x in (events, names))
        span = events.groupBy("term_id").agg(F.count(F.lit(1)).alias("event_count"), F.min("commit_seq").alias("lo"), F.max("commit_seq").alias("hi"))
        name = names.groupBy("term_id").agg(F.max_by("name", "commit_seq").alias("current_name"))
        first = self.commits.select(F.col("commit_seq").alias("lo"), F.col("sha").alias("first_sha"), F.col("committed_date").alias("first_date"))
        last = self.commits.select(F.col("commit_seq").alias("hi"), F.col("sha").alias("last_sha"), F.col("committed_date").alias("last_date"), F.col("pr_number").alias("last_pr"))
        joined = span.join(name, "term_id", "left").join(first, "lo").join(last, "hi")
        return joined.select("term_id", "current_name", "event_count", "first_sha", "first_date", "last_sha", "last_date", "last_pr")

    def states_at(self, seq: int, term_id: str | None = None, strict: bool = False) -> DataFrame:
        """(term_id, predicate, value) of the latest snapshot at or before a commit, of one entity or of all.

        A removed entity keeps its last state, as removal writes no snapshot; ``strict`` leaves it out.
        """
        shots = self.snapshots.filter(F.col("commit_seq") <= seq)
        if term_id is not None:
            shots = shots.filter(F.col("term_id") == term_id)
        latest = shots.groupBy("term_id").agg(F.max("commit_seq").alias("at"))
        if strict:
            # after the snapshot an entity only loses clauses by being removed
            lost = self.events.filter((F.col("commit_seq") <= seq) & (F.col("operation") == "remove")).groupBy("term_id").agg(F.max("commit_seq").alias("lost"))
            latest = latest.join(lost, "term_id", "left").filter("lost is null or lost <= at")
        latest = latest.join(shots.select("term_id", F.col("commit_seq").alias("at"), "clauses"), ["term_id", "at"])
        return latest.select("term_id", F.explode("clauses").alias("c")).select("term_id", "c.predicate", "c.value").orderBy("term_id", "predicate", "value")

    def milestones(self, obsolete: tuple[str, str] = ("is_obsolete", "true"), replaced: str = "replaced_by") -> DataFrame:
        """(term_id, commit_seq, kind, target): when entities were created, removed, obsoleted, restored or merged into a target.

        Read off the events: an entity is created where it had no clause before, removed where none is left. An
        entity that is removed isn't restored by that. ``target`` is null for all kinds but merged.
        """
        flag = (F.col("predicate") == obsolete[0]) & (F.col("value") == obsolete[1])
        sign = F.when(F.col("operation") == "add", 1).otherwise(-1)
        target = F.when((F.col("operation") == "add") & (F.col("predicate") == replaced), F.col("value"))
        steps = self.events.groupBy("term_id", "commit_seq").agg(F.sum(sign).alias("net"), F.sum(F.when(flag, sign)).alias("flagged"), F.collect_set(target).alias("targets"))
        left = F.sum("net").over(Window.partitionBy("term_id").orderBy("commit_seq"))
        one = lambda name: F.struct(F.lit(name).alias("kind"), F.lit(None).cast("string").alias("target"))
        kinds = F.array_compact(
            F.array(
                F.when(F.col("left") == F.col("net"), one("created")),
                F.when(F.col("left") == 0, one("removed")),
                F.when(F.col("flagged") > 0, one("obsoleted")),
                F.when((F.col("flagged") < 0) & (F.col("left") > 0), one("restored")),
            )
        )
        merged = F.transform("targets", lambda t: F.struct(F.lit("merged").alias("kind"), t.alias("target")))
        told = steps.withColumn("left", left).select("term_id", "commit_seq", F.explode(F.concat(kinds, merged)).alias("k"))
        return told.select("term_id", "commit_seq", "k.kind", "k.target").orderBy("term_id", "commit_seq", "kind", "target")

    def commit(self, sha_prefix: str) -> DataFrame:
        """The first commit whose sha starts so."""
        return self.commits.filter(F.col("sha").startswith(sha_prefix)).orderBy("commit_seq").limit(1).select(*COMMIT)

    def commit_headers(self, pr_link: str | None = None, show_commits: bool = False, hide_sha: bool = False, prefix: str = "") -> DataFrame:
        """(commit_seq, header) of every commit: sha, day, author and subject, then lines for what belongs to it.

        A merge that brings a title is headed by that, with its own subject below and its branch commits only on demand;
        others show their branch commits. ``pr_link``: what a pull request's number is appended to. ``prefix`` stands
        before the subject.
        """
        message = F.coalesce("message", F.lit(""))
        promoted = message.rlike(MERGE_SUBJECT) & (subject(message) != first_line(message))
        lead = F.concat(*([] if hide_sha else [short_sha(F.col("sha")), F.lit("  ")]), date_prefix(F.col("committed_date")), F.lit("  "), F.when(F.col("author_name") != "", F.concat("author_name", F.lit("  "))).otherwise(""))
        branch = F.transform("branch_commits", lambda c: F.concat(F.lit("    ⤷ "), short_sha(c["sha"]), F.lit("  "), first_line(F.coalesce(c["message"], F.lit("")))))
        shown = F.when(F.lit(True) if show_commits else ~promoted, branch)
        lines = F.concat(
            F.array(
                F.concat(lead, F.lit(prefix), F.when(promoted, subject(message)).otherwise(first_line(message))),
                F.when(promoted, F.concat(F.lit("      "), first_line(message))),
                F.concat(F.lit(f"      {pr_link}" if pr_link else "      PR #"), F.col("pr_number").cast("string")),
                F.concat(F.lit("      "), F.col("snapshot_url")),
            ),
            F.coalesce(shown, F.array().cast("array<string>")),
        )
        return self.commits.select("commit_seq", F.array_join(F.array_compact(lines), "\n").alias("header")).orderBy("commit_seq")

    def commit_events(self, sha_prefix: str, namespace: str | None = None) -> DataFrame:
        own = self.events.join(self.commit(sha_prefix).select("commit_seq"), "commit_seq", "left_semi").filter(self._in(namespace))
        return self._with_names(own).select("term_id", "name", "operation", "predicate", "value").orderBy("term_id", "operation", "predicate", "value")

    def pr_terms(self, number: int) -> DataFrame:
        """Entities that a pull request changed; an entity with two names is listed with each."""
        own = self.events.join(self.commits.filter(F.col("pr_number") == number).select("commit_seq"), "commit_seq", "left_semi")
        return self._with_names(own).select("term_id", "name").distinct().orderBy("term_id", "name")

    def references(self, ref: str) -> DataFrame:
        """(priority, commit_seq) of what a reference can mean; the lowest priority counts."""
        head = self.commits.agg(F.max("commit_seq").alias("commit_seq")).filter(F.lit(ref.upper() == "HEAD")).select(F.lit(0).alias("priority"), "commit_seq")
        out = head
        if self._releases is not None:
            tag = self._releases.filter(F.col("tag") == ref).agg(F.min("commit_seq").alias("commit_seq"))
            out = out.unionByName(tag.select(F.lit(1).alias("priority"), "commit_seq"))
        number = self.commits.sparkSession.range(1).filter(F.lit(ref.isdigit())).select(F.lit(2).alias("priority"), F.lit(int(ref) if ref.isdigit() else None).cast("int").alias("commit_seq"))
        sha = self.commits.filter(F.col("sha").startswith(ref)).agg(F.min("commit_seq").alias("commit_seq")).select(F.lit(3).alias("priority"), "commit_seq")
        return out.unionByName(number).unionByName(sha).filter("commit_seq is not null")

    def resolved(self, ref: str) -> DataFrame:
        """One row (commit_seq), or none where the reference is unknown."""
        return self.references(ref).agg(F.min_by("commit_seq", "priority").alias("commit_seq")).filter("commit_seq is not null")

    def resolve(self, ref: str) -> int:
        row = self.resolved(ref).first()
        if row is None:
            raise KeyError(ref)
        return row.commit_seq

    def range_events(self, a: str | int, b: str | int, term_id: str | None = None, namespace: str | None = None) -> DataFrame:
        """Changes after the earlier and up to the later of two commits, in whichever order they are given."""
        low, high = sorted(x if isinstance(x, int) else self.resolve(x) for x in (a, b))
        own = self.events.filter((F.col("commit_seq") > low) & (F.col("commit_seq") <= high)).filter(self._in(namespace))
        return self._detailed(own if term_id is None else own.filter(F.col("term_id") == term_id))

    def search(self, query: str, term_id: str | None = None, predicate: str | None = None, since: int | None = None, regex: bool = False, ignore_case: bool = False, namespace: str | None = None) -> DataFrame:
        """Changes whose value matches, from a commit on."""
        own = self.events.filter(text_match(F.col("value"), query, regex, ignore_case)).filter(self._in(namespace))
        for column, value in (("term_id", term_id), ("predicate", predicate)):
            if value is not None:
                own = own.filter(F.col(column) == value)
        return self._detailed(own if since is None else own.filter(F.col("commit_seq") >= since))

    def _detailed(self, events: DataFrame) -> DataFrame:
        named = self._with_names(self._with_commits(events))
        return named.select("term_id", "name", *ROW).orderBy("term_id", "commit_seq", "operation", "predicate", "value")

    def releases(self) -> DataFrame:
        if self._releases is None:
            return self.commits.select(F.lit("").alias("tag"), "commit_seq", F.col("committed_date").alias("date")).limit(0)
        return self._releases.select("tag", "commit_seq", "date").orderBy("commit_seq", "tag")

    @staticmethod
    def summary(changes: DataFrame) -> DataFrame:
        """Numbers of changes, entities and commits of a view."""
        return changes.agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("term_id").alias("n_terms"), F.count_distinct("commit_seq").alias("n_commits"))

    @staticmethod
    def section_names(changes: DataFrame) -> DataFrame:
        """The latest name of each entity within a view."""
        return changes.groupBy("term_id").agg(F.max_by("name", F.when(F.col("name").isNotNull(), F.col("commit_seq"))).alias("name"))
