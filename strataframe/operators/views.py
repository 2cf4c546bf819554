"""Histories as lines of text, in order: what the command line prints.

A view is a DataFrame of (section, term_id, commit_seq, step, line) that is sorted by these; a line may hold several. Sections are headers
first. Nothing is gathered: every line is a row, and edits come from the same jobs as elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataframe.functions.text import date_prefix, short_sha
from strataframe.operators.history import History
from strataframe.operators.pairing import pair_changes, rendered, search_hits

ORDER = ("section", "term_id", "commit_seq", "step", "place")
# What stands before a commit and between the parts of a line.
BULLET, BETWEEN, DASH = "● ", "  ·  ", " — "


def _line(df: DataFrame, section: int, step: int, line: Column, place: Column | None = None) -> DataFrame:
    text = F.col("term_id") if "term_id" in df.columns else F.lit("")
    seq = F.col("commit_seq") if "commit_seq" in df.columns else F.lit(-1)
    where = F.struct(F.lit(0).alias("rank"), F.lit("").alias("a"), F.lit("").alias("b")) if place is None else place
    return df.select(F.lit(section).alias("section"), text.alias("term_id"), seq.cast("int").alias("commit_seq"), F.lit(step).alias("step"), where.alias("place"), line.alias("line"))


def _together(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*ORDER).drop("place")


def _ops(ops: DataFrame, cap: int | None) -> DataFrame:
    """A line an edit, removal or addition, in the order of ``pairing.in_order``."""
    rank = F.when(F.col("kind") == "edit", 0).when(F.col("kind") == "remove", 1).otherwise(2)
    place = F.struct(rank.alias("rank"), F.concat_ws("\0", "predicate", F.coalesce("before", "after")).alias("a"), F.coalesce("after", F.lit("")).alias("b"))
    by_predicate = F.struct(F.lit(0).alias("rank"), F.concat(F.col("predicate"), F.lit("\0"), place["rank"].cast("string"), F.lit("\0"), F.coalesce("before", "after")).alias("a"), place["b"].alias("b"))
    return _line(rendered(ops, cap), 1, 3, F.col("lines"), by_predicate)


def _named(term: Column, name: Column) -> Column:
    return F.concat(term, F.when(name.isNotNull() & (name != ""), F.concat(F.lit(DASH), name)).otherwise(""))


def _commits(h: History, shown: DataFrame, show_commits: bool, pr_link: str | None, by_term: bool) -> DataFrame:
    heads = h.commit_headers(pr_link, show_commits).withColumn("header", F.concat(F.lit(BULLET), "header"))
    keys = ["term_id", "commit_seq"] if by_term else ["commit_seq"]
    return _line(shown.select(*keys).distinct().join(heads, "commit_seq"), 1, 2, F.col("header"))


def term_header(h: History, term_id: str, shown: DataFrame, every: DataFrame) -> DataFrame:
    """Title, how much is shown, span and predicates of an entity's changes, a line each."""
    seen = shown.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("commit_seq").alias("k"))
    total = every.agg(F.count(F.lit(1)).alias("m"))
    n, m, k = (F.col(c).cast("string") for c in "nmk")
    summary = F.when(F.col("n") != F.col("m"), F.concat(F.lit("showing "), n, F.lit(" of "), m, F.lit(" events across "), k, F.lit(" commits"))).otherwise(F.concat(m, F.lit(" events across "), k, F.lit(" commits")))
    head = h.headers(term_id)
    last = F.concat(F.lit("last "), date_prefix(F.col("last_date")), F.lit(" ("), short_sha(F.col("last_sha")), F.when(F.col("last_pr").isNotNull(), F.concat(F.lit(", PR #"), F.col("last_pr").cast("string"))).otherwise(""), F.lit(")"))
    span = F.concat(F.lit("first "), date_prefix(F.col("first_date")), F.lit(" ("), short_sha(F.col("first_sha")), F.lit(")" + BETWEEN), last)
    first = F.min(F.struct("commit_seq", "operation", "predicate", "value"))
    # a row a predicate of one entity
    counts = shown.groupBy("predicate").agg(F.count(F.lit(1)).alias("c"), first.alias("first")).groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("order"), "first", "predicate", "c"))).alias("all"))
    listed = F.concat(F.lit("by predicate: "), F.array_join(F.transform("all", lambda x: F.concat(x["predicate"], F.lit(" "), x["c"].cast("string"))), ", "))
    return _line(head, 0, 0, _named(F.col("term_id"), F.col("current_name"))).unionByName(_line(seen.join(total).withColumn("term_id", F.lit(term_id)), 0, 1, summary)).unionByName(_line(head, 0, 2, span)).unionByName(
        _line(counts.filter("size(all) > 0").withColumn("term_id", F.lit(term_id)), 0, 3, listed)
    )


def term_view(h: History, term_id: str, predicate: str | None = None, since: int | None = None, last_commits: int | None = None, former: tuple[str, ...] = (), cap: int | None = 200, show_commits: bool = False, pr_link: str | None = None) -> DataFrame:
    """An entity's header, then its commits with their edits."""
    every = h.timeline(term_id, predicate, former=former)
    shown = h.timeline(term_id, predicate, since, last_commits, former)
    changed = shown.withColumn("term_id", F.lit(term_id))
    return _together(term_header(h, term_id, shown, every), _commits(h, changed, show_commits, pr_link, True), _ops(pair_changes(changed), cap))


def commit_view(h: History, sha_prefix: str, namespace: str | None = None, cap: int | None = 200, show_commits: bool = False, pr_link: str | None = None) -> DataFrame:
    """A commit's header and how many entities it changed, then each with its name and edits."""
    seq = h.commit(sha_prefix).select("commit_seq")
    return _commits_view(h, seq, namespace, cap, show_commits, pr_link)


def pr_view(h: History, number: int, namespace: str | None = None, cap: int | None = 200, show_commits: bool = False, pr_link: str | None = None) -> DataFrame:
    """The commits of a pull request, each as ``commit_view`` has it."""
    return _commits_view(h, h.commits.filter(F.col("pr_number") == number).select("commit_seq"), namespace, cap, show_commits, pr_link)


def _commits_view(h, seqs, namespace, cap, show_commits, pr_link) -> DataFrame:
    changed = h.events.join(seqs, "commit_seq", "left_semi").filter(h._in(namespace))
    heads = h.commit_headers(pr_link, show_commits).withColumn("header", F.concat(F.lit(BULLET), "header")).join(seqs, "commit_seq", "left_semi")
    count = changed.groupBy("commit_seq").agg(F.count_distinct("term_id").alias("n"))
    told = heads.join(count, "commit_seq", "left").select("commit_seq", "header", F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" terms changed")).alias("said"))
    titles = h._with_names(changed.select("term_id", "commit_seq").distinct()).groupBy("term_id", "commit_seq").agg(F.min("name").alias("name"))
    parts = (_line(told, 1, 0, F.col("header")), _line(told, 1, 1, F.col("said")), _line(titles, 1, 2, _named(F.col("term_id"), F.col("name"))), _ops(pair_changes(changed), cap))
    # a commit's entities follow it
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.orderBy("commit_seq", "section", "term_id", "step", "place").drop("place")


def _sections(h: History, changed: DataFrame, ops: DataFrame, said: Column, cap: int | None, show_commits: bool, pr_link: str | None) -> DataFrame:
    """Per entity its latest name, then its commits with their edits; before all a line on how much there is."""
    total = ops.agg(F.count(F.lit(1)).alias("ops"), F.sum(F.when(F.col("kind") == "edit", 2).otherwise(1)).alias("n_events"), F.count_distinct("term_id").alias("n_terms"), F.count_distinct("commit_seq").alias("n_commits")).select(F.coalesce("n_events", F.lit(0)).alias("n_events"), "n_terms", "n_commits")
    left = ops.select("term_id", "commit_seq").distinct()
    titles = h.section_names(changed).join(left.select("term_id").distinct(), "term_id", "left_semi").withColumn("commit_seq", F.lit(-1))
    return _together(_line(total, 0, 0, said), _line(titles, 1, 0, _named(F.col("term_id"), F.col("name"))), _commits(h, left, show_commits, pr_link, True), _ops(ops, cap))


def _counted(of: str, what: str) -> Column:
    return F.concat(F.lit(of), F.col("n_events").cast("string"), F.lit(f" events {what}across "), F.col("n_terms").cast("string"), F.lit(" terms and "), F.col("n_commits").cast("string"), F.lit(" commits"))


def diff_view(h: History, a: str | int, b: str | int, term_id: str | None = None, namespace: str | None = None, cap: int | None = 200, show_commits: bool = False, pr_link: str | None = None) -> DataFrame:
    changed = h.range_events(a, b, term_id, namespace)
    return _sections(h, changed, pair_changes(changed), F.concat(_counted("", ""), F.lit(f" between {a} and {b}")), cap, show_commits, pr_link)


def search_view(h: History, query: str, term_id: str | None = None, predicate: str | None = None, since: int | None = None, regex: bool = False, ignore_case: bool = False, namespace: str | None = None, cap: int | None = 200, show_commits: bool = False, pr_link: str | None = None) -> DataFrame:
    changed = h.search(query, term_id, predicate, since, regex, ignore_case, namespace)
    said = F.when(F.col("n_events") == 0, F.lit(f'No events matching "{query}"')).otherwise(_counted("Found ", f'matching "{query}" '))
    return _sections(h, changed, search_hits(changed, query, regex, ignore_case), said, cap, show_commits, pr_link)


def numbered_lines(view: DataFrame) -> DataFrame:
    """(place, line) of a short view, such as a header."""
    order = Window.orderBy("section", "term_id", "commit_seq", "step")
    return view.select(F.row_number().over(order).alias("place"), "line")
