"""The registered queries over the driver tables and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.functions import text
from strataframe.operators import asof, changes, commits, pairing, stanzas, views
from strataframe.operators.history import History
from strataframe.sources import artifact, star, triples
from strataframe.sources.search_index import indexed_search
from strataframe.streaming.append import append_batch
from strataframe.streaming.entities import keyed_stream

TERM, PREDICATE, SINCE, AT = "USER:0000003", "click", 20, 17
#: SHA-1 prefixes of the commits 12 and 7.
SHA_12, SHA_7 = "7b52009b64", "902ba3cda1"

STATE = """state AS (
  SELECT concat('USER:', lpad(CAST(user_id AS VARCHAR), 7, '0')) AS term_id,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS commit_seq,
         event_type AS predicate, CAST(CAST(floor(value) AS INT) AS VARCHAR) AS value
  FROM events)"""
PROSE = """state AS (
  SELECT concat('DOC:', CAST(doc_id AS VARCHAR)) AS term_id, CAST(doc_id % 4 AS INT) AS commit_seq, coalesce(lang, 'none') AS predicate, coalesce(text, '') AS value FROM documents
  UNION ALL SELECT concat('CONV:', CAST(conv_id AS VARCHAR)), CAST(turn % 4 AS INT), coalesce(role, 'none'), coalesce(text, '') FROM conversations
  UNION ALL SELECT concat('PAGE:', CAST(page_id AS VARCHAR)), CAST(page_id % 4 AS INT), 'url', coalesce(url, '') FROM pages)"""
EVENTS = """ev AS (
  SELECT *, 'add' AS operation FROM (
    SELECT term_id, commit_seq, predicate, value FROM state EXCEPT ALL SELECT term_id, commit_seq + 1, predicate, value FROM state)
  UNION ALL
  SELECT *, 'remove' AS operation FROM (
    SELECT term_id, commit_seq + 1 AS commit_seq, predicate, value FROM state WHERE commit_seq < (SELECT max(commit_seq) FROM state)
    EXCEPT ALL SELECT term_id, commit_seq, predicate, value FROM state))"""
COMMITS = r"""raw_commits AS (
  SELECT commit_seq, sha1(CAST(commit_seq AS VARCHAR)) AS sha, concat('author-', CAST(commit_seq % 5 AS VARCHAR)) AS author_name, first_ts AS committed_date,
         CASE commit_seq % 3
           WHEN 0 THEN concat('daily load (#', CAST(1000 + commit_seq AS VARCHAR), ')')
           WHEN 1 THEN concat('Merge pull request #', CAST(2000 + commit_seq AS VARCHAR), ' from u/b', chr(10), chr(10), 'Title ', CAST(commit_seq AS VARCHAR), ' (#7)')
           ELSE concat('v', CAST(commit_seq AS VARCHAR), chr(10), chr(10), 'notes (#9)', chr(10), 'Release URL: https://example.org/r/', CAST(commit_seq AS VARCHAR)) END AS message
  FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS commit_seq, min(ts) AS first_ts FROM events GROUP BY 1) x),
com AS (
  SELECT *, nullif(regexp_extract(message, '(?m)^Release URL: (\S+)', 1), '') AS snapshot_url,
         CASE WHEN message LIKE '%Release URL: %' THEN NULL
              ELSE CAST(coalesce(nullif(regexp_extract(message, '^Merge pull request #(\d+) from ', 1), ''), nullif(regexp_extract(message, '\(#(\d+)\)', 1), '')) AS INT) END AS pr_number
  FROM raw_commits)"""
SNAPS = """pres AS (
  SELECT term_id, commit_seq, sha1(string_agg(predicate || chr(0) || value || chr(0), '' ORDER BY predicate, value)) AS content_hash,
         min(value) FILTER (WHERE predicate = 'signup') AS name, coalesce(bool_or(predicate = 'error' AND value = '100'), FALSE) AS is_obsolete
  FROM state GROUP BY 1, 2),
snap AS (
  SELECT * FROM pres QUALIFY lag(commit_seq) OVER (PARTITION BY term_id ORDER BY commit_seq) IS NULL
    OR lag(commit_seq) OVER (PARTITION BY term_id ORDER BY commit_seq) <> commit_seq - 1
    OR lag(content_hash) OVER (PARTITION BY term_id ORDER BY commit_seq) <> content_hash)"""
RELEASES = """rel AS (
  SELECT t.tag, t.sha, t.date, max(c.commit_seq) AS commit_seq
  FROM (SELECT concat('v', CAST(commit_seq AS VARCHAR)) AS tag, sha, committed_date AS date FROM com WHERE commit_seq % 7 = 3) t
  JOIN (SELECT commit_seq, max(committed_date) OVER (ORDER BY commit_seq) AS runmax FROM com) c ON c.runmax <= t.date GROUP BY 1, 2, 3)"""
ALL = f"WITH {STATE}, {EVENTS}, {COMMITS}, {SNAPS}, {RELEASES}"
DETAIL_COLUMNS = "e.term_id, s.name, e.commit_seq, c.committed_date, c.sha, c.author_name, c.pr_number, c.message, e.operation, e.predicate, e.value, c.snapshot_url"
DETAIL = f"SELECT {DETAIL_COLUMNS} FROM ev e JOIN com c USING (commit_seq) LEFT JOIN snap s ON s.term_id = e.term_id AND s.commit_seq = e.commit_seq"
TIMELINE = "SELECT e.commit_seq, c.committed_date, c.sha, c.author_name, c.pr_number, c.message, e.operation, e.predicate, e.value, c.snapshot_url FROM ev e JOIN com c USING (commit_seq)"

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return keep


#: Questions that are put to the written tables too.
STORED = (
    "term_timeline", "term_timeline_predicate", "timeline_last_n_commits", "term_header", "term_headers", "term_at", "all_terms_at", "commit_view", "commit_events", "pr_terms",
    "resolve_ref_tag", "resolve_ref_sha", "range_events", "range_events_term", "search_substring", "search_regex", "search_predicate", "releases", "milestones",
)


def asked(name: str, oracle: str | None, f) -> None:
    """A query to the history of the users: worked out from their events, and for some also from tables written once."""
    sql = oracle and f"{ALL} {oracle}"
    query(name, sql)(lambda spark, sf_dir: flat(f(star.history(spark, sf_dir))))
    if name in STORED:
        query(f"stored_{name}", sql)(lambda spark, sf_dir: flat(f(star.stored_history(spark, sf_dir))))


def asked_prose(name: str, oracle: str, f, history=star.prose_history) -> None:
    """A query to the history of texts, whose entities have several namespaces."""
    query(name, f"{ALL.replace(STATE, PROSE)} {oracle}")(lambda spark, sf_dir: flat(f(history(spark, sf_dir))))


def flat(df: DataFrame) -> DataFrame:
    """Without the nested column, which SQL engines print each in its own way."""
    return df.drop("branch_commits", "clauses")


# Build: deltas, snapshots, derived columns.
query("events_delta", f"WITH {STATE}, {EVENTS} SELECT * FROM ev")(lambda spark, d: changes.state_delta(star.state(spark, d)))
query(
    "events_delta_suppliers",
    "WITH state AS (SELECT concat('SUPP:', lpad(CAST(l_suppkey AS VARCHAR), 7, '0')) AS term_id, CAST((year(l_shipdate) * 12 + month(l_shipdate)) - (SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) FROM lineitem) AS INT) AS commit_seq, "
    f"concat(l_returnflag, l_linestatus) AS predicate, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS value FROM lineitem), {EVENTS} SELECT * FROM ev",
)(lambda spark, d: changes.state_delta(star.supplier_state(spark, d)))
asked("events_by_content", "SELECT e.*, c.sha FROM ev e JOIN com c USING (commit_seq)", lambda h: h.events)
asked("snapshots_changed", "SELECT s.*, c.sha FROM snap s JOIN com c USING (commit_seq)", lambda h: h.snapshots)
asked("derived_name_obsolete", "SELECT term_id, commit_seq, name, is_obsolete FROM snap WHERE name IS NOT NULL OR is_obsolete", lambda h: h.snapshots.filter("name is not null or is_obsolete").select("term_id", "commit_seq", "name", "is_obsolete"))
query("content_hash", f"WITH {STATE}, {SNAPS} SELECT term_id, commit_seq, content_hash FROM pres")(
    lambda spark, d: changes.presence_of_state(star.state(spark, d)).select("term_id", F.col("vidx").alias("commit_seq"), "content_hash")
)
query(
    "term_removed",
    f"WITH {STATE}, {SNAPS} SELECT term_id, commit_seq + 1 AS commit_seq FROM pres QUALIFY commit_seq < (SELECT max(commit_seq) FROM pres) AND coalesce(lead(commit_seq) OVER (PARTITION BY term_id ORDER BY commit_seq), -1) <> commit_seq + 1",
)(lambda spark, d: changes.removals(changes.episodes(changes.presence_of_state(star.state(spark, d))), star.numbered(spark, d)).select("term_id", F.col("vidx").alias("commit_seq")))
query("term_born", f"WITH {STATE} SELECT term_id, min(commit_seq) AS commit_seq, count(*) AS n_clauses FROM (SELECT *, min(commit_seq) OVER (PARTITION BY term_id) AS b FROM state) WHERE commit_seq = b GROUP BY term_id")(
    lambda spark, d: changes.good_changes(changes.episodes(changes.presence_of_state(star.state(spark, d)).withColumn("n_clauses", F.expr("aggregate(clauses, 0L, (a, x) -> a + x.n)")).drop("clauses"))).filter("before is null and ep = 1").select("term_id", F.col("vidx").alias("commit_seq"), "n_clauses")
)
query("build_window", f"WITH {STATE} SELECT commit_seq, count(*) AS n FROM state WHERE commit_seq > (SELECT max(commit_seq) FROM state) - 10 GROUP BY 1")(
    lambda spark, d: changes.last_versions(star.commits(spark, d), 10).select("commit_seq").join(star.state(spark, d), "commit_seq").groupBy("commit_seq").agg(F.count(F.lit(1)).alias("n"))
)

# Entities.
asked("term_timeline", f"{TIMELINE} WHERE e.term_id = '{TERM}'", lambda h: h.timeline(TERM))
asked("term_timeline_predicate", f"{TIMELINE} WHERE e.term_id = '{TERM}' AND e.predicate = '{PREDICATE}'", lambda h: h.timeline(TERM, PREDICATE))
asked("timeline_since", f"{TIMELINE} WHERE e.term_id = '{TERM}' AND e.commit_seq >= {SINCE}", lambda h: h.timeline(TERM, since=SINCE))
asked("timeline_last_n_commits", f"SELECT * FROM ({TIMELINE} WHERE e.term_id = '{TERM}') QUALIFY dense_rank() OVER (ORDER BY commit_seq DESC) <= 3", lambda h: h.timeline(TERM, last_commits=3))
asked("timeline_predicate_counts", f"SELECT predicate, count(*) AS n, min(commit_seq) AS first_seq FROM ev WHERE term_id = '{TERM}' GROUP BY 1", lambda h: h.predicate_counts(TERM))


asked(
    "timeline_predicate_order",
    f"SELECT predicate, count(*) AS n, min(commit_seq) AS first_seq, CAST(row_number() OVER (ORDER BY count(*) DESC, min((commit_seq, operation, predicate, value))) AS INT) AS place FROM ev WHERE term_id = '{TERM}' GROUP BY 1",
    lambda h: h.predicate_counts(TERM, numbered=True),
)


def under_former_ids(h: History) -> History:
    """The history with the ids of the commits before the fifteenth under another prefix."""
    old = F.when(F.col("commit_seq") < 15, F.concat(F.lit("OLD:"), F.substring_index("term_id", ":", -1))).otherwise(F.col("term_id"))
    return History(h.events.withColumn("term_id", old), h.commits, h.snapshots)


asked("timeline_former_prefix", f"{TIMELINE} WHERE e.term_id = '{TERM}'", lambda h: under_former_ids(h).timeline(TERM, former=("OLD",)))
asked("timeline_former_prefix_last", f"SELECT * FROM ({TIMELINE} WHERE e.term_id = '{TERM}') QUALIFY dense_rank() OVER (ORDER BY commit_seq DESC) <= 20", lambda h: under_former_ids(h).timeline(TERM, last_commits=20, former=("OLD",)))
asked(
    "milestones",
    """, net AS (
  SELECT term_id, commit_seq, sum(CASE operation WHEN 'add' THEN 1 ELSE -1 END) AS n,
         sum(CASE operation WHEN 'add' THEN 1 ELSE -1 END) FILTER (WHERE predicate = 'error' AND value = '100') AS flagged
  FROM ev GROUP BY 1, 2),
run AS (SELECT *, sum(n) OVER (PARTITION BY term_id ORDER BY commit_seq) AS rest FROM net)
SELECT term_id, commit_seq, 'created' AS kind, NULL AS target FROM run WHERE rest = n
UNION ALL SELECT term_id, commit_seq, 'removed', NULL FROM run WHERE rest = 0
UNION ALL SELECT term_id, commit_seq, 'obsoleted', NULL FROM run WHERE flagged > 0
UNION ALL SELECT term_id, commit_seq, 'restored', NULL FROM run WHERE flagged < 0 AND rest > 0
UNION ALL SELECT DISTINCT term_id, commit_seq, 'merged', value FROM ev WHERE predicate = 'signup' AND operation = 'add'""",
    lambda h: h.milestones(star.OBSOLETE, star.NAME),
)
HEADERS = """SELECT x.term_id, n.name AS current_name, x.event_count, a.sha AS first_sha, a.committed_date AS first_date, b.sha AS last_sha, b.committed_date AS last_date, b.pr_number AS last_pr
FROM (SELECT term_id, count(*) AS event_count, min(commit_seq) AS lo, max(commit_seq) AS hi FROM ev GROUP BY 1) x
JOIN com a ON a.commit_seq = x.lo JOIN com b ON b.commit_seq = x.hi
LEFT JOIN (SELECT term_id, max_by(name, commit_seq) AS name FROM snap WHERE name IS NOT NULL GROUP BY 1) n ON n.term_id = x.term_id"""
asked("term_headers", HEADERS, lambda h: h.headers())
asked("term_header", f"{HEADERS} WHERE x.term_id = '{TERM}'", lambda h: h.headers(TERM))
STATES = f"SELECT s.term_id, s.predicate, s.value FROM state s JOIN (SELECT term_id, max(commit_seq) AS commit_seq FROM snap WHERE commit_seq <= {AT} GROUP BY 1) m ON m.term_id = s.term_id AND m.commit_seq = s.commit_seq"
asked("term_at", f"{STATES} WHERE s.term_id = '{TERM}'", lambda h: h.states_at(AT, TERM))
asked("all_terms_at", STATES, lambda h: h.states_at(AT))
asked("all_terms_at_strict", f"SELECT term_id, predicate, value FROM state WHERE commit_seq = {AT}", lambda h: h.states_at(AT, strict=True))

# Commits, pull requests, references.
asked("commit_view", f"SELECT commit_seq, committed_date, sha, author_name, pr_number, message, snapshot_url FROM com WHERE sha LIKE '{SHA_12}%' ORDER BY commit_seq LIMIT 1", lambda h: h.commit(SHA_12))
COMMIT_EVENTS = f"SELECT e.term_id, s.name, e.operation, e.predicate, e.value FROM ev e LEFT JOIN snap s ON s.term_id = e.term_id AND s.commit_seq = e.commit_seq WHERE e.commit_seq = (SELECT min(commit_seq) FROM com WHERE sha LIKE '{SHA_12}%')"
asked("commit_events", COMMIT_EVENTS, lambda h: h.commit_events(SHA_12))
asked("commit_events_namespace", f"{COMMIT_EVENTS} AND starts_with(e.term_id, 'USER:')", lambda h: h.commit_events(SHA_12, "USER"))
asked("pr_terms", "SELECT DISTINCT e.term_id, s.name FROM ev e JOIN com c USING (commit_seq) LEFT JOIN snap s ON s.term_id = e.term_id AND s.commit_seq = e.commit_seq WHERE c.pr_number = 2010", lambda h: h.pr_terms(2010))
for kind, ref, sql in (("head", "head", "SELECT max(commit_seq) AS commit_seq FROM com"), ("tag", "v17", "SELECT commit_seq FROM rel WHERE tag = 'v17'"), ("seq", "9", "SELECT 9 AS commit_seq"), ("sha", SHA_7, f"SELECT min(commit_seq) AS commit_seq FROM com WHERE sha LIKE '{SHA_7}%'")):
    asked(f"resolve_ref_{kind}", sql, lambda h, ref=ref: h.resolved(ref))
asked("releases", "SELECT tag, commit_seq, date FROM rel", lambda h: h.releases())
query("release_asof", f"WITH {COMMITS}, moved AS (SELECT * REPLACE (CASE WHEN commit_seq = 5 THEN committed_date + INTERVAL 10 DAY ELSE committed_date END AS committed_date) FROM com), t AS (SELECT concat('v', CAST(commit_seq AS VARCHAR)) AS tag, sha, committed_date AS date FROM com WHERE commit_seq % 7 = 3) SELECT t.tag, t.sha, t.date, max(c.commit_seq) AS commit_seq FROM t JOIN (SELECT commit_seq, max(committed_date) OVER (ORDER BY commit_seq) AS runmax FROM moved) c ON c.runmax <= t.date GROUP BY 1, 2, 3")(
    lambda spark, d: commits.releases_asof(star.tags(spark, d), star.future_commits(star.commits(spark, d)))
)
asked("commit_pr_number", "SELECT commit_seq, pr_number FROM com", lambda h: h.commits.select("commit_seq", "pr_number"))
asked("commit_snapshot_url", "SELECT commit_seq, snapshot_url FROM com", lambda h: h.commits.select("commit_seq", "snapshot_url"))
asked("commit_subject", "SELECT commit_seq, CASE WHEN commit_seq % 3 = 1 THEN concat('Title ', CAST(commit_seq AS VARCHAR), ' (#7)') ELSE string_split(message, chr(10))[1] END AS subject FROM com", lambda h: h.commits.select("commit_seq", text.subject(F.col("message")).alias("subject")))
query(
    "branch_commits_nested",
    "SELECT commit_seq, string_agg(concat(message, '/', sha1(concat(CAST(commit_seq AS VARCHAR), '/', message))), ',' ORDER BY newest DESC, sha1(concat(CAST(commit_seq AS VARCHAR), '/', message)) DESC) AS nested "
    "FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS commit_seq, event_type AS message, max(ts) AS newest FROM events GROUP BY 1, 2) WHERE commit_seq % 3 = 1 GROUP BY 1",
)(lambda spark, d: star.branch_commits(spark, d).select("commit_seq", F.array_join(F.transform("branch_commits", lambda x: F.concat_ws("/", x["message"], x["sha"])), ",").alias("nested")))

# Ranges and search.
asked("range_events", f"{DETAIL} WHERE e.commit_seq > 3 AND e.commit_seq <= 10", lambda h: h.range_events("v10", "v3"))
asked("range_events_term", f"{DETAIL} WHERE e.commit_seq > 3 AND e.commit_seq <= 24 AND e.term_id = '{TERM}'", lambda h: h.range_events("v3", "v24", term_id=TERM))
asked("range_events_namespace", f"{DETAIL} WHERE e.commit_seq > 26 AND starts_with(e.term_id, 'USER:')", lambda h: h.range_events(26, "HEAD", namespace="USER"))
asked("range_summary", "SELECT count(*) AS n_events, count(DISTINCT term_id) AS n_terms, count(DISTINCT commit_seq) AS n_commits FROM ev WHERE commit_seq > 3 AND commit_seq <= 10", lambda h: h.summary(h.range_events(3, 10)))
asked("section_names", f"SELECT term_id, max_by(name, commit_seq) FILTER (WHERE name IS NOT NULL) AS name FROM ({DETAIL} WHERE e.commit_seq > 3 AND e.commit_seq <= 10) GROUP BY 1", lambda h: h.section_names(h.range_events(3, 10)))
asked("search_substring", f"{DETAIL} WHERE contains(e.value, '13')", lambda h: h.search("13"))
asked("search_icase", f"{DETAIL} WHERE contains(lower(e.value), lower('7E')) OR contains(lower(e.value), '17')", lambda h: h.search("17", ignore_case=True))
asked("search_regex", f"{DETAIL} WHERE regexp_matches(e.value, '^1[0-3]$')", lambda h: h.search("^1[0-3]$", regex=True))
asked("search_regex_icase", f"{DETAIL} WHERE regexp_matches(e.value, '^(2|3)1$', 'i')", lambda h: h.search("^(2|3)1$", regex=True, ignore_case=True))
asked("search_since", f"{DETAIL} WHERE contains(e.value, '4') AND e.commit_seq >= {SINCE}", lambda h: h.search("4", since=SINCE))
asked("search_predicate", f"{DETAIL} WHERE contains(e.value, '3') AND e.predicate = '{PREDICATE}' AND e.term_id = '{TERM}'", lambda h: h.search("3", term_id=TERM, predicate=PREDICATE))
asked("search_namespace", f"{DETAIL} WHERE contains(e.value, '99') AND starts_with(e.term_id, 'USER:')", lambda h: h.search("99", namespace="USER"))
query("commit_count", f"WITH {COMMITS} SELECT count(*) AS n_commits, CASE WHEN count(*) > 0 THEN 'built' ELSE 'not built' END AS status FROM com")(
    lambda spark, d: star.commits(spark, d).agg(F.count(F.lit(1)).alias("n_commits"), F.when(F.count(F.lit(1)) > 0, "built").otherwise("not built").alias("status"))
)

# Text kernels.
TOKENS = r"[\p{L}\p{N}_][\p{L}\p{N}_:/.\-]*|\s+|[^\p{L}\p{N}_\s]"
query("tokenize", f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, '|')) AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '{TOKENS}') AS t FROM documents)")(
    lambda spark, d: star.table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", "|")).alias("tokens"))
)
query("clause_partition", "SELECT conv_id, turn, substr(x, 1, instr(x, ': ') - 1) AS predicate, substr(x, instr(x, ': ') + 2) AS value FROM (SELECT conv_id, turn, concat(role, ': ', text) AS x FROM conversations)")(
    lambda spark, d: star.table(spark, d, "conversations").select("conv_id", "turn", text.clause(F.concat("role", F.lit(": "), "text")).alias("c")).select("conv_id", "turn", "c.predicate", "c.value")
)
query("first_lines", "SELECT conv_id, turn, string_split(text, chr(10))[1] AS first_line, CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 199), '…') ELSE text END AS short FROM conversations")(
    lambda spark, d: star.table(spark, d, "conversations").select("conv_id", "turn", text.first_line(F.col("text")).alias("first_line"), text.truncated(F.col("text")).alias("short"))
)
query("url_repository", r"SELECT page_id, nullif(regexp_extract(u, '^https?://github\.com/([^/]+/[^/]+?)(?:\.git)?/?$', 1), '') AS repository FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('https://github.com/p', CAST(page_id AS VARCHAR), '/r.git') ELSE url END AS u FROM pages)")(
    lambda spark, d: star.table(spark, d, "pages").select("page_id", text.repository(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://github.com/p"), F.col("page_id").cast("string"), F.lit("/r.git"))).otherwise(F.col("url"))).alias("repository"))
)
SUBMISSIONS = "SELECT doc_id AS submission_id, CASE doc_id % 4 WHEN 0 THEN concat('v', CAST(doc_id % 50 AS VARCHAR)) WHEN 1 THEN 'Unknown' WHEN 2 THEN 'not a tag!' ELSE NULL END AS version, source AS released, lang FROM documents"


def submissions(spark, d: str) -> DataFrame:
    i = F.col("doc_id")
    version = F.when(i % 4 == 0, F.concat(F.lit("v"), (i % 50).cast("string"))).when(i % 4 == 1, "Unknown").when(i % 4 == 2, "not a tag!")
    return star.table(spark, d, "documents").select(
        i.alias("submission_id"), version.alias("version"), F.col("source").alias("released"), F.lit("").alias("creation_date"),
        F.when(F.col("lang") == "en", "OBO").otherwise("OWL").alias("language"), F.array(F.struct(F.when(i % 7 != 0, F.col("lang")).alias("name"), F.lit("").alias("email"))).alias("contact"),
    )


TAG_SQL = "CASE WHEN regexp_matches(version, '^[A-Za-z0-9._/-]+$') AND lower(trim(version)) <> 'unknown' THEN version ELSE concat('sub-', CAST(submission_id AS VARCHAR)) END"
query("pick_tag", f"SELECT submission_id, {TAG_SQL} AS tag FROM ({SUBMISSIONS})")(lambda spark, d: submissions(spark, d).select("submission_id", text.release_tag(F.col("version"), F.col("submission_id")).alias("tag")))
query(
    "dedup_submissions",
    f"SELECT tag, released AS date, submission_id, CASE WHEN starts_with(tag, 'sub-') THEN concat('Submission #', CAST(submission_id AS VARCHAR)) ELSE tag END AS subject, CASE WHEN submission_id % 7 = 0 THEN 'BioPortal' ELSE lang END AS author_name, 'bioportal@bioontology.org' AS author_email "
    f"FROM (SELECT *, {TAG_SQL} AS tag FROM ({SUBMISSIONS}) WHERE lang = 'en') WHERE tag <> 'v8' QUALIFY row_number() OVER (PARTITION BY tag ORDER BY released, submission_id) = 1",
)(lambda spark, d: commits.new_submissions(submissions(spark, d), spark.range(1).select(F.lit("v8").alias("tag"))))
query(
    "new_releases",
    "SELECT concat('t', CAST(o_orderkey AS VARCHAR)) AS tag, o_orderdate AS date, concat('u', CAST(o_custkey AS VARCHAR)) AS author_name, concat('u', CAST(o_custkey AS VARCHAR), '@users.noreply.github.com') AS author_email, "
    "concat('t', CAST(o_orderkey AS VARCHAR), chr(10), chr(10), o_orderpriority, chr(10), chr(10), 'Release URL: https://example.org/', CAST(o_orderkey AS VARCHAR)) AS message FROM orders WHERE o_orderstatus <> 'O' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0",
)(
    lambda spark, d: commits.new_releases(
        star.table(spark, d, "orders").select(
            F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tag_name"), F.col("o_orderdate").alias("published_at"), F.col("o_orderpriority").alias("body"),
            F.concat(F.lit("https://example.org/"), F.col("o_orderkey").cast("string")).alias("html_url"), (F.col("o_orderstatus") == "O").alias("draft"), (F.col("o_orderkey") % 3 == 0).alias("prerelease"),
            F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("author_login"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit("other.zip"))).otherwise(F.array(F.lit("onto.obo"))).alias("assets"),
        ),
        star.table(spark, d, "orders").filter("o_orderkey % 7 = 0").select(F.concat(F.lit("t"), F.col("o_orderkey").cast("string")).alias("tag")),
        "onto.obo",
    )
)
query(
    "unchanged_content_dedup",
    "SELECT commit_seq, kept, max(CASE WHEN kept THEN commit_seq END) OVER (ORDER BY commit_seq) AS version FROM (SELECT commit_seq, coalesce(lag(n) OVER (ORDER BY commit_seq) <> n, TRUE) AS kept FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS commit_seq, count(*) // 20 AS n FROM events GROUP BY 1))",
)(
    lambda spark, d: commits.unchanged_content(
        star.state(spark, d).groupBy("commit_seq").agg(F.floor(F.count(F.lit(1)) / 20).cast("string").alias("content")), "content", "commit_seq"
    ).select("commit_seq", "kept", "version")
)
query(
    "unchanged_content_texts",
    "WITH v AS (SELECT CAST(concat('0x', substr(md5(coalesce(text, '')), 1, 7)) AS BIGINT) * 10000000000 + doc_id AS n, doc_id, coalesce(text, '') AS t FROM documents) "
    "SELECT n, doc_id, kept, max(CASE WHEN kept THEN n END) OVER (ORDER BY n) AS version FROM (SELECT n, doc_id, coalesce(lag(t) OVER (ORDER BY n) <> t, TRUE) AS kept FROM v)",
)(lambda spark, d: commits.unchanged_content(star.in_text_order(spark, d), "text", "n").select("n", "doc_id", "kept", "version"))
query("build_meta", f"WITH {COMMITS} SELECT '1' AS schema_version, '0' AS generator_version, 'events' AS source_path, min(commit_seq) AS first_commit_seq, max(commit_seq) AS last_commit_seq, CAST(count(*) AS INT) AS n_commits FROM com")(
    lambda spark, d: artifact.build_meta(star.commits(spark, d), "events", "0")
)

# Documents of stanzas, from text on.
BAD = "predicate = 'error' AND value = '13'"
query("stanza_split", f"WITH {STATE} SELECT term_id, commit_seq, count(*) AS n_lines FROM state GROUP BY 1, 2")(
    lambda spark, d: stanzas.stanzas(star.documents(spark, d)).select("term_id", "commit_seq", F.size(stanzas.lines_of(F.col("stanza"))).cast("long").alias("n_lines"))
)
# Carried over failures and gaps: a stretch of versions, what is good in it, and what it had last.
CARRIED = f"""WITH {STATE}, lines AS (SELECT term_id, commit_seq AS v, CASE WHEN {BAD} THEN 'synonym' ELSE predicate END AS p, CASE WHEN {BAD} THEN '"y" VAGUELY [Z:9]' ELSE value END AS x, {BAD} AS bad FROM state),
here AS (SELECT term_id, v, string_agg(p || ': ' || x, chr(10) ORDER BY p || ': ' || x) AS b, NOT bool_or(bad) AS ok FROM lines GROUP BY 1, 2),
a AS (SELECT *, lag(v) OVER w AS pv, lag(b) OVER w AS pb FROM here WINDOW w AS (PARTITION BY term_id ORDER BY v)),
e AS (SELECT *, sum(CASE WHEN pv IS NULL OR v <> pv + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY term_id ORDER BY v) AS ep, (pv IS NULL OR v <> pv + 1 OR b <> pb) AS ch FROM a),
g AS (SELECT term_id, ep, v, b, lag(v) OVER w AS gv, lag(b) OVER w AS gb FROM e WHERE ok AND ch WINDOW w AS (PARTITION BY term_id, ep ORDER BY v)),
good AS (SELECT * FROM g WHERE gv IS NULL OR b <> gb),
over AS (SELECT e.term_id, max(v) + 1 AS v, max(CASE WHEN ok AND ch THEN v END) AS gv FROM e GROUP BY e.term_id, ep HAVING max(v) < (SELECT max(v) FROM here)),
now AS (SELECT l.term_id, g.v, l.p, l.x FROM good g JOIN lines l ON l.term_id = g.term_id AND l.v = g.v),
old AS (SELECT l.term_id, g.v, l.p, l.x FROM (SELECT term_id, v, gv FROM good UNION ALL SELECT * FROM over) g JOIN lines l ON l.term_id = g.term_id AND l.v = g.gv)"""
query("skipped_rows", f"{CARRIED} SELECT v AS commit_seq, sha1(CAST(v AS VARCHAR)) AS sha, term_id, 'ParseError' AS error FROM e WHERE ch AND NOT ok")(lambda spark, d: changes.build(star.documents(spark, d))["skipped"])
query(
    "build_events",
    f"{CARRIED} SELECT term_id, v AS commit_seq, sha1(CAST(v AS VARCHAR)) AS sha, p AS predicate, x AS value, operation FROM (SELECT *, 'add' AS operation FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM old) UNION ALL SELECT *, 'remove' AS operation FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM now))",
)(lambda spark, d: changes.build(star.documents(spark, d))["events"])

def without_content(spark, d: str) -> DataFrame:
    """The documents of stanzas, with those of every ninth day missing."""
    return star.documents(spark, d).withColumn("content", F.when(F.col("commit_seq") % 9 != 4, F.col("content")))


# The same over the readable versions, which are numbered without gaps; a missing one ends no stretch.
READABLE = f"""raw_{STATE}, axis AS (SELECT commit_seq, CAST(row_number() OVER (ORDER BY commit_seq) - 1 AS INT) AS v FROM (SELECT DISTINCT commit_seq FROM raw_state WHERE commit_seq % 9 <> 4)),
state AS (SELECT term_id, v AS commit_seq, predicate, value FROM raw_state JOIN axis USING (commit_seq))"""
CARRIED_OVER = CARRIED.replace(STATE, READABLE)
query(
    "missing_content_skipped",
    f"{CARRIED_OVER} SELECT commit_seq, sha1(CAST(commit_seq AS VARCHAR)) AS sha, term_id, 'ParseError' AS error FROM e JOIN axis USING (v) WHERE ch AND NOT ok "
    "UNION ALL SELECT DISTINCT commit_seq, sha1(CAST(commit_seq AS VARCHAR)), NULL, 'BlobMissing' FROM raw_state WHERE commit_seq % 9 = 4",
)(lambda spark, d: changes.build(without_content(spark, d))["skipped"])
query(
    "missing_content_events",
    f"{CARRIED_OVER} SELECT term_id, commit_seq, sha1(CAST(commit_seq AS VARCHAR)) AS sha, p AS predicate, x AS value, operation FROM (SELECT *, 'add' AS operation FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM old) UNION ALL SELECT *, 'remove' AS operation FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM now)) JOIN axis USING (v)",
)(lambda spark, d: changes.build(without_content(spark, d))["events"])
query(
    "id_mismatch",
    f"{CARRIED} SELECT v AS commit_seq, sha1(CAST(v AS VARCHAR)) AS sha, term_id, CASE WHEN ok THEN 'IdMismatch' ELSE 'ParseError' END AS error FROM e WHERE ch AND (NOT ok OR CAST(substr(term_id, 6) AS INT) % 5 = 0)",
)(lambda spark, d: changes.build(star.documents(spark, d, mismatch=True))["skipped"])


def appended(spark, d: str) -> DataFrame:
    """The events of two batches, the second built on what the first left."""
    root, versions = artifact.shared_folder(spark, "appended"), star.documents(spark, d)
    for n, (low, high) in enumerate(((0, 15), (15, 1 << 30))):
        append_batch(versions.filter(F.col("commit_seq").between(low, high - 1)), root, n)
    return spark.read.parquet(f"{root}/events").drop("batch")


query("appended_events", ORACLES["build_events"])(appended)


# The same tables from what changed between versions alone, and from a stream with a state for each entity.
query("build_events_from_changes", ORACLES["build_events"])(lambda spark, d: changes.tables_of_changes(changes.change_rows(star.documents(spark, d)))["events"])
query("missing_content_from_changes", ORACLES["missing_content_skipped"])(lambda spark, d: changes.tables_of_changes(changes.change_rows(without_content(spark, d)))["skipped"])


def keyed(spark, d: str) -> DataFrame:
    """The events that a stream builds out of the changes, which come as files of ten days each, one stretch after the other."""
    root = artifact.shared_folder(spark, "keyed")
    changes.change_rows(star.documents(spark, d)).write.parquet(f"{root}/all")
    rows = spark.read.parquet(f"{root}/all")
    for part in range(3):
        # an entity's changes of a stretch are in one file, so files of a stretch may come in any order
        rows.filter(F.floor(F.col("commit_seq") / 10) == part).repartition("term_id").write.mode("append").parquet(f"{root}/changes")
    keyed_stream(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/changes"), root, f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/events").drop("batch")


query("keyed_state_events", ORACLES["build_events"])(keyed)

# Frames and deltas: the same questions as to snapshots.
query("keyframe_all_terms_at", ORACLES["all_terms_at"])(lambda spark, d: star.keyframes(spark, d).states_at(AT))
query("keyframe_all_terms_at_strict", ORACLES["all_terms_at_strict"])(lambda spark, d: star.keyframes(spark, d).states_at(AT, strict=True))
query("keyframe_term_at", ORACLES["term_at"])(lambda spark, d: star.keyframes(spark, d).states_at(AT, TERM))

# States at many points at once.
asked(
    "states_at_releases", "SELECT r.tag, s.term_id, s.commit_seq, s.content_hash FROM rel r JOIN snap s ON s.commit_seq <= r.commit_seq QUALIFY row_number() OVER (PARTITION BY r.tag, s.term_id ORDER BY s.commit_seq DESC) = 1",
    lambda h: asof.states_at_releases(h.snapshots, h.commits, h._releases),
)


def probes(spark, d: str) -> DataFrame:
    """Each event of a user and the day before it, as a question for the user's state then."""
    return star.state(spark, d).select("term_id", (F.col("commit_seq") - 1).alias("commit_seq"), "predicate", "value")


query("states_before_events", f"{ALL} SELECT p.term_id, p.commit_seq - 1 AS commit_seq, p.predicate, p.value, s.commit_seq AS state_at FROM state p ASOF LEFT JOIN snap s ON s.term_id = p.term_id AND s.commit_seq <= p.commit_seq - 1")(
    lambda spark, d: asof.asof(probes(spark, d), star.stored_history(spark, d).snapshots, "term_id", "commit_seq")
)

# What lists of releases and submissions bring.
query(
    "content_sniff",
    r"SELECT doc_id, regexp_matches(CASE doc_id % 4 WHEN 0 THEN concat('format-version: 1.2', chr(10), coalesce(text, '')) WHEN 1 THEN concat(' ', chr(10), 'format-version:2', coalesce(text, '')) WHEN 2 THEN concat('x', chr(10), 'format-version: 1') ELSE coalesce(text, '') END, '^\s*format-version:\s*\d') AS is_document FROM documents",
)(
    lambda spark, d: star.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).select(
        "doc_id",
        text.looks_like_document(
            F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("format-version: 1.2\n"), "t")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit(" \nformat-version:2"), "t")).when(F.col("doc_id") % 4 == 2, "x\nformat-version: 1").otherwise(F.col("t"))
        ).alias("is_document"),
    )
)


def listing(spark, d: str) -> DataFrame:
    """Pages of submissions: lists, and objects that hold one."""
    name = F.struct(F.col("source").alias("name"), F.lit("x@example.org").alias("email"))
    one = F.struct(
        F.col("doc_id").alias("submissionId"), F.concat(F.lit("v"), F.col("doc_id").cast("string")).alias("version"), F.lit("").alias("released"), F.lit("2020-01-01").alias("creationDate"),
        F.when(F.col("lang") == "en", "OBO").otherwise("OWL").alias("hasOntologyLanguage"), F.col("text").alias("description"), F.array(name).alias("contact"), F.lit(1).alias("other"),
    )
    return star.table(spark, d, "documents").select(F.when(F.col("doc_id") % 2 == 0, F.to_json(F.array(one))).otherwise(F.to_json(F.struct(F.array(one).alias("collection"), F.lit("next").alias("nextPage")))).alias("body"))


query(
    "submission_listing",
    "SELECT doc_id AS submission_id, concat('v', CAST(doc_id AS VARCHAR)) AS version, '' AS released, '2020-01-01' AS creation_date, CASE WHEN lang = 'en' THEN 'OBO' ELSE 'OWL' END AS language, text AS description, source AS contact_name FROM documents",
)(lambda spark, d: commits.submissions(listing(spark, d)).withColumn("contact_name", F.col("contact")[0]["name"]).drop("contact"))


def release_pages(spark, d: str) -> DataFrame:
    """Pages of releases: lists, and single ones."""
    rows = star.table(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    one = F.struct(
        F.concat(F.lit("t"), key).alias("tag_name"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.col("o_orderpriority").alias("body"), F.concat(F.lit("https://example.org/"), key).alias("html_url"),
        (F.col("o_orderstatus") == "O").alias("draft"), (F.col("o_orderkey") % 3 == 0).alias("prerelease"), F.when(F.col("o_orderkey") % 11 != 0, F.struct(F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("login"))).alias("author"),
        F.array(F.struct(F.lit("notes.txt").alias("name"), F.lit(5).alias("size")), F.struct(F.when(F.col("o_orderkey") % 5 != 0, "onto.obo").alias("name"), F.lit(7).alias("size"))).alias("assets"), F.lit(3).alias("id"),
    )
    return rows.select(F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.array(one))).otherwise(F.to_json(one)).alias("body"))


query(
    "release_listing",
    "SELECT concat('t', CAST(o_orderkey AS VARCHAR)) AS tag_name, o_orderdate AS published_at, o_orderpriority AS body, concat('https://example.org/', CAST(o_orderkey AS VARCHAR)) AS html_url, o_orderstatus = 'O' AS draft, o_orderkey % 3 = 0 AS prerelease, "
    "CASE WHEN o_orderkey % 11 <> 0 THEN concat('u', CAST(o_custkey AS VARCHAR)) END AS author_login, CASE WHEN o_orderkey % 5 <> 0 THEN 'notes.txt,onto.obo' ELSE 'notes.txt' END AS assets FROM orders",
)(lambda spark, d: commits.releases_listed(release_pages(spark, d)).withColumn("assets", F.array_join("assets", ",")))

# The same histories, written as N-Triples.
PREFIXES = {"https://example.org/entity/": "", "https://example.org/predicate#": ""}


def as_triples(state: DataFrame) -> DataFrame:
    """(commit_seq, line): each clause as a triple, with a comment line and a blank one for some."""
    text = F.col("value")
    for char, name in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\u000D")):
        text = F.replace(text, F.lit(char), F.lit(name))
    line = F.concat(F.lit("<https://example.org/entity/"), "term_id", F.lit(">\t<https://example.org/predicate#"), "predicate", F.lit('> "'), text, F.lit('" .'))
    return state.select("commit_seq", F.explode(F.when(F.hash("term_id") % 5 == 0, F.array(F.lit("# a comment . "), F.lit("  "), F.concat(line, F.lit(" # said")))).otherwise(F.array(line))).alias("line"))


def triple_events(state: DataFrame, numbered: DataFrame) -> DataFrame:
    found = triples.state_of(triples.triples(as_triples(state), PREFIXES))
    return changes.change_tables(changes.presence_of_state(found), numbered, star.NAME, star.OBSOLETE)["events"]


query("triples_events", ORACLES["events_by_content"])(lambda spark, d: triple_events(star.state(spark, d), star.numbered(spark, d)))
query("triples_prose_events", f"{ALL.replace(STATE, PROSE)} SELECT e.*, c.sha FROM ev e JOIN com c USING (commit_seq)")(lambda spark, d: triple_events(star.prose_state(spark, d), star.numbered(spark, d).filter("vidx < 4")))

# Texts as values: letters of several alphabets, and three namespaces.
asked_prose("prose_search_icase", f"{DETAIL} WHERE contains(lower(e.value), 'ichä')", lambda h: h.search("ICHÄ", ignore_case=True))
asked_prose("prose_search_case", f"{DETAIL} WHERE contains(e.value, 'Der ')", lambda h: h.search("Der "))
asked_prose("prose_search_regex_icase", f"{DETAIL} WHERE regexp_matches(e.value, '[^ ]Ä( |,)', 'i')", lambda h: h.search("[^ ]Ä( |,)", regex=True, ignore_case=True))
asked_prose("prose_search_regex", f"{DETAIL} WHERE regexp_matches(e.value, '^[A-Z][a-zé]+ ')", lambda h: h.search("^[A-Z][a-zé]+ ", regex=True))
asked_prose("prose_search_namespace", f"{DETAIL} WHERE contains(lower(e.value), 'the') AND starts_with(e.term_id, 'CONV:')", lambda h: h.search("THE", ignore_case=True, namespace="CONV"))
asked_prose("prose_range_namespace", f"{DETAIL} WHERE e.commit_seq > 0 AND e.commit_seq <= 2 AND starts_with(e.term_id, 'PAGE:')", lambda h: h.range_events(2, 0, namespace="PAGE"))
for name, text_, flags in (("prose_search_icase", "ICHÄ", {"ignore_case": True}), ("prose_search_case", "Der ", {}), ("prose_search_regex_icase", "[^ ]Ä( |,)", {"regex": True, "ignore_case": True}), ("prose_search_namespace", "THE", {"ignore_case": True, "namespace": "CONV"})):
    query(f"indexed_{name}", ORACLES[name])(lambda spark, d, text_=text_, flags=flags: flat(indexed_search(spark, star.stored_prose(spark, d), text_, **flags)))
for name, text_, sql in (("substring", "@mail7.example", "contains(e.value, '@mail7.example')"), ("regex", "[0-9]+@mail[78].example", "regexp_matches(e.value, '[0-9]+@mail[78].example')")):
    query(f"indexed_search_{name}", f"{ALL.replace(STATE, PROSE)} {DETAIL} WHERE {sql}")(lambda spark, d, text_=text_, name=name: flat(indexed_search(spark, star.stored_prose(spark, d), text_, regex=name == "regex")))
SHA_2 = "da4b9237ba"
asked_prose("prose_commit_events_namespace", "SELECT e.term_id, s.name, e.operation, e.predicate, e.value FROM ev e LEFT JOIN snap s ON s.term_id = e.term_id AND s.commit_seq = e.commit_seq WHERE e.commit_seq = 2 AND starts_with(e.term_id, 'DOC:')", lambda h: h.commit_events(SHA_2, "DOC"), star.prose_once)
asked_prose("prose_timeline", f"{TIMELINE} WHERE e.term_id = 'DOC:6'", lambda h: h.timeline("DOC:6"))

# Commits as a reader sees them.
NESTED = "(SELECT commit_seq, string_agg(concat('    ⤷ ', substr(sha1(concat(CAST(commit_seq AS VARCHAR), '/', message)), 1, 7), '  ', message), chr(10) ORDER BY newest DESC, sha1(concat(CAST(commit_seq AS VARCHAR), '/', message)) DESC) AS nested FROM (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS commit_seq, event_type AS message, max(ts) AS newest FROM events GROUP BY 1, 2) WHERE commit_seq % 3 = 1 GROUP BY 1)"
HEADER = "concat_ws(chr(10), concat(substr(sha, 1, 7), '  ', strftime(committed_date, '%Y-%m-%d'), '  ', author_name, '  ', CASE WHEN commit_seq % 3 = 1 THEN concat('Title ', CAST(commit_seq AS VARCHAR), ' (#7)') ELSE string_split(message, chr(10))[1] END), CASE WHEN commit_seq % 3 = 1 THEN concat('      ', string_split(message, chr(10))[1]) END, '      PR #' || CAST(pr_number AS VARCHAR), '      ' || snapshot_url"
asked("commit_header", f"SELECT commit_seq, {HEADER}) AS header FROM com", lambda h: h.commit_headers())
asked("commit_header_commits", f"SELECT commit_seq, {HEADER}, nested) AS header FROM com LEFT JOIN {NESTED} USING (commit_seq)", lambda h: h.commit_headers(show_commits=True))
asked(
    "timeline_branch_commits", f"SELECT DISTINCT commit_seq, nested FROM ev LEFT JOIN {NESTED} USING (commit_seq) WHERE term_id = '{TERM}'",
    lambda h: h.timeline(TERM).select("commit_seq", F.array_join(F.transform("branch_commits", lambda c: F.concat(F.lit("    ⤷ "), F.substring(c["sha"], 1, 7), F.lit("  "), c["message"])), "\n").alias("nested")).distinct(),
)


def messy(spark, d: str) -> DataFrame:
    """Clause lines that are spaced at random, and what they say."""
    i = F.col("doc_id").cast("string")
    word = F.regexp_extract("text", r"([a-z]+)", 1)
    return star.table(spark, d, "documents").select("doc_id", F.explode(F.array(
        F.concat(F.lit('synonym:   "'), word, F.lit(',  {x}"   EXACT  [A:1,B:'), i, F.lit('  , C:2 ]   {note = "a,b",source="S:'), i, F.lit('"}   !   label  here ')),
        F.concat(F.lit("is_a: X:"), i, F.lit('{source="q",k="1"} ! '), word),
        F.concat(F.lit("name:  "), word, F.lit("  and, more")),
        F.concat(F.lit('def: "It ends. [no] '), word, F.lit('"[R:'), i, F.lit("]")),
    )).alias("line"))


CANONICAL = r"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, regexp_extract(text, '([a-z]+)', 1) AS w FROM documents)
SELECT doc_id, 'synonym' AS predicate, concat('"', w, ',  {x}" EXACT [A:1, B:', i, ', C:2] {note="a,b", source="S:', i, '"} ! label  here') AS value FROM d
UNION ALL SELECT doc_id, 'is_a', concat('X:', i, ' {source="q", k="1"}', CASE WHEN w <> '' THEN concat(' ! ', w) ELSE '' END) FROM d
UNION ALL SELECT doc_id, 'name', trim(concat(w, '  and, more')) FROM d
UNION ALL SELECT doc_id, 'def', concat('"It ends. [no] ', w, '" [R:', i, ']') FROM d"""
query("canonical_clauses", CANONICAL)(lambda spark, d: messy(spark, d).select("doc_id", stanzas.canonical(F.col("line")).alias("c")).select("doc_id", "c.predicate", "c.value"))



def long_clauses(spark, d: str) -> DataFrame:
    """Whole texts as quoted definitions, and as lists of as many escaped and quoted items as they have words, each in a stanza of its own."""
    i, blank = F.col("doc_id").cast("string"), "[ \\x09-\\x0d]+"
    said = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " "), r'(["\\])', r"\\$1")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r'["\\{}!\[\],=:]', ""), blank, " "))
    words = lambda mark: F.array_join(F.split(bare, " "), mark)
    stanza = F.concat(F.lit("[Term]\nid: X:"), i, F.lit('\ndef:  "'), said, F.lit('"   [R:'), i, F.lit(']\nsubset: '), words("\\,  "), F.lit("\nnote: "), words('!b{ "q, {" '), F.lit('\nname: x  {a = "'), words('\\"'), F.lit('",b="2"}\n'))
    return star.table(spark, d, "documents").select("doc_id", stanza.alias("stanza"))


LONG_CLAUSES = r"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, regexp_replace(replace(coalesce(text, ''), chr(10), ' '), '(["\\])', '\\\1', 'g') AS said,
  trim(regexp_replace(regexp_replace(coalesce(text, ''), '["\\{}!\[\],=:]', '', 'g'), '[ \x09-\x0d]+', ' ', 'g')) AS bare FROM documents)
SELECT doc_id, predicate, md5(value) AS value, length(value) AS n_chars FROM (
  SELECT doc_id, 'def' AS predicate, concat('"', said, '" [R:', i, ']') AS value FROM d
  UNION ALL SELECT doc_id, 'subset', replace(bare, ' ', '\, ') FROM d
  UNION ALL SELECT doc_id, 'note', replace(bare, ' ', '!b{ "q, {" ') FROM d
  UNION ALL SELECT doc_id, 'name', concat('x {a="', replace(bare, ' ', '\"'), '", b="2"}') FROM d)"""
query("long_clauses", LONG_CLAUSES)(
    lambda spark, d: long_clauses(spark, d).select("doc_id", F.explode(stanzas.clauses_of(F.col("stanza"))).alias("c")).select("doc_id", "c.predicate", F.md5("c.value").alias("value"), F.length("c.value").cast("long").alias("n_chars"))
)
query("long_clauses_unread", r"""SELECT doc_id, CAST(NULL AS VARCHAR) AS error FROM documents""")(lambda spark, d: long_clauses(spark, d).select("doc_id", stanzas.parse_error(F.col("stanza"), F.concat(F.lit("X:"), F.col("doc_id").cast("string"))).alias("error")))

# Clause-aware views: no SQL can pair greedily; tests compare them with small worked cases.
query("pair_events", None)(lambda spark, d: pairing.pair_changes(changes.state_delta(star.state(spark, d))))
query("edit_kind", None)(lambda spark, d: pairing.edit_kinds(pairing.pair_changes(changes.state_delta(star.state(spark, d)))))
query("word_diff", None)(lambda spark, d: pairing.edit_texts(pairing.pair_changes(changes.state_delta(star.state(spark, d)))))


def qualified(spark, d: str) -> DataFrame:
    """The delta with values that have qualifiers and a comment, so that edits of every kind occur."""
    v = F.col("value").cast("int")
    value = F.concat(F.lit("X:"), (v % 7).cast("string"), F.lit(' {source="S:'), (v % 5).cast("string"), F.lit('", note="n'), (v % 3).cast("string"), F.lit('"} ! name '), (v % 2).cast("string"))
    return changes.state_delta(star.state(spark, d)).withColumn("value", value)


query("qualifier_block", None)(lambda spark, d: pairing.edit_texts(pairing.pair_changes(qualified(spark, d))))
query("search_delta_filtered", None)(lambda spark, d: pairing.search_hits(qualified(spark, d).filter(F.col("value").contains("S:3")), "S:3"))


def with_sides(changed: DataFrame, of) -> DataFrame:
    """The changes of the groups for whose numbers of removals and additions ``of`` holds."""
    n = changed.groupBy("term_id", "commit_seq", "predicate").agg(F.count_if(F.col("operation") == "remove").alias("r"), F.count_if(F.col("operation") == "add").alias("a"))
    return changed.join(n.filter(of(F.col("r"), F.col("a"))).drop("r", "a"), ["term_id", "commit_seq", "predicate"], "left_semi")


# Of pairing, what SQL can say: changes without a partner, and single partners of one body.
query(
    "render_unpaired",
    f"WITH {STATE}, {EVENTS} SELECT term_id, commit_seq, predicate, operation AS kind, concat(CASE operation WHEN 'add' THEN '+ ' ELSE '- ' END, predicate, ': ', value) AS lines FROM ev QUALIFY min(operation) OVER (PARTITION BY term_id, commit_seq, predicate) = max(operation) OVER (PARTITION BY term_id, commit_seq, predicate)",
)(lambda spark, d: pairing.rendered(pairing.pair_changes(with_sides(changes.state_delta(star.state(spark, d)), lambda r, a: (r == 0) | (a == 0)))).select("term_id", "commit_seq", "predicate", "kind", "lines"))
QUALIFIED = f"""WITH {STATE}, {EVENTS}, q AS (SELECT term_id, commit_seq, predicate, operation, CAST(value AS INT) % 7 AS body,
  concat('X:', CAST(CAST(value AS INT) % 7 AS VARCHAR), ' {{source="S:', CAST(CAST(value AS INT) % 5 AS VARCHAR), '", note="n', CAST(CAST(value AS INT) % 3 AS VARCHAR), '"}} ! name ', CAST(CAST(value AS INT) % 2 AS VARCHAR)) AS value FROM ev),
g AS (SELECT term_id, commit_seq, predicate, min(value) FILTER (WHERE operation = 'remove') AS before, min(value) FILTER (WHERE operation = 'add') AS after, min(body) AS lo, max(body) AS hi FROM q GROUP BY 1, 2, 3
  HAVING count(*) = 2 AND count(*) FILTER (WHERE operation = 'add') = 1)"""
query("pair_same_body", f"{QUALIFIED} SELECT term_id, commit_seq, predicate, 'edit' AS kind, before, after FROM g WHERE lo = hi")(
    lambda spark, d: pairing.pair_changes(with_sides(qualified(spark, d), lambda r, a: (r == 1) & (a == 1))).filter("kind = 'edit' and split(before, ' ')[0] = split(after, ' ')[0]")
)

# All clauses of one body on both sides as one edit.
query(
    "pair_bodies",
    f"""WITH {STATE}, {EVENTS}, q AS (SELECT term_id, commit_seq, predicate, CASE operation WHEN 'add' THEN 1 ELSE -1 END AS sign, concat('X:', CAST(CAST(value AS INT) % 7 AS VARCHAR)) AS body,
  concat('source="S:', CAST(CAST(value AS INT) % 5 AS VARCHAR), '"') AS q1, concat('note="n', CAST(CAST(value AS INT) % 3 AS VARCHAR), '"') AS q2 FROM ev),
g AS (SELECT term_id, commit_seq, predicate, body, count(*) FILTER (sign < 0) AS n_before, count(*) FILTER (sign > 0) AS n_after FROM q GROUP BY ALL HAVING n_before > 0 AND n_after > 0),
net AS (SELECT term_id, commit_seq, predicate, body, k, sum(sign) AS n FROM (SELECT * EXCLUDE (q1, q2), q1 AS k FROM q UNION ALL SELECT * EXCLUDE (q1, q2), q2 FROM q) GROUP BY ALL HAVING sum(sign) <> 0),
d AS (SELECT term_id, commit_seq, predicate, body, string_agg(concat(k, '*', CAST(-n AS BIGINT)), '; ' ORDER BY k) FILTER (n < 0) AS removed, string_agg(concat(k, '*', CAST(n AS BIGINT)), '; ' ORDER BY k) FILTER (n > 0) AS added FROM net GROUP BY ALL)
SELECT g.*, 'group' AS kind, coalesce(removed, '') AS removed, coalesce(added, '') AS added FROM g LEFT JOIN d USING (term_id, commit_seq, predicate, body)""",
)(
    lambda spark, d: pairing.pair_bodies(qualified(spark, d)).withColumns({c: F.array_join(F.transform(c, lambda x: F.concat(x["qualifier"], F.lit("*"), x["n"].cast("string"))), "; ") for c in ("removed", "added")})
)

# Views as lines.
TERM_HEADER = f"""h AS ({HEADERS} WHERE x.term_id = '{TERM}'), mine AS (SELECT * FROM ev WHERE term_id = '{TERM}'), shown AS (SELECT * FROM mine QUALIFY dense_rank() OVER (ORDER BY commit_seq DESC) <= 3)
SELECT 1 AS place, concat(term_id, CASE WHEN coalesce(current_name, '') <> '' THEN concat(' — ', current_name) ELSE '' END) AS line FROM h
UNION ALL SELECT 2, concat('showing ', CAST((SELECT count(*) FROM shown) AS VARCHAR), ' of ', CAST((SELECT count(*) FROM mine) AS VARCHAR), ' events across 3 commits')
UNION ALL SELECT 3, concat('first ', strftime(first_date, '%Y-%m-%d'), ' (', substr(first_sha, 1, 7), ')  ·  last ', strftime(last_date, '%Y-%m-%d'), ' (', substr(last_sha, 1, 7), CASE WHEN last_pr IS NOT NULL THEN concat(', PR #', CAST(last_pr AS VARCHAR)) ELSE '' END, ')') FROM h
UNION ALL SELECT 4, concat('by predicate: ', string_agg(concat(predicate, ' ', CAST(n AS VARCHAR)), ', ' ORDER BY n DESC, first)) FROM (SELECT predicate, count(*) AS n, min((commit_seq, operation, predicate, value)) AS first FROM shown GROUP BY 1)"""
query("term_view_header", f"{ALL}, {TERM_HEADER}")(lambda spark, d: views.numbered_lines((lambda h: views.term_header(h, TERM, h.timeline(TERM, last_commits=3), h.timeline(TERM)))(star.history(spark, d))))
query("diff_view_titles", f"{ALL}, part AS ({DETAIL} WHERE e.commit_seq > 3 AND e.commit_seq <= 10) SELECT term_id, concat(term_id, CASE WHEN coalesce(max_by(name, commit_seq) FILTER (WHERE name IS NOT NULL), '') <> '' THEN concat(' — ', max_by(name, commit_seq) FILTER (WHERE name IS NOT NULL)) ELSE '' END) AS line FROM part GROUP BY 1 "
      "UNION ALL SELECT '', concat(CAST(count(*) AS VARCHAR), ' events across ', CAST(count(DISTINCT term_id) AS VARCHAR), ' terms and ', CAST(count(DISTINCT commit_seq) AS VARCHAR), ' commits between 3 and 10') FROM part")(
    lambda spark, d: views.diff_view(star.history(spark, d), 3, 10).filter("step = 0").select("term_id", "line")
)
query("commit_view_titles", f"{ALL}, part AS ({COMMIT_EVENTS}) SELECT term_id, concat(term_id, CASE WHEN coalesce(name, '') <> '' THEN concat(' — ', name) ELSE '' END) AS line FROM (SELECT DISTINCT term_id, name FROM part) UNION ALL SELECT '', concat(CAST(count(DISTINCT term_id) AS VARCHAR), ' terms changed') FROM part")(
    lambda spark, d: views.commit_view(star.history(spark, d), SHA_12).filter("step = 1 or step = 2").select("term_id", "line")
)
query("term_view", None)(lambda spark, d: views.term_view(star.stored_history(spark, d), TERM, last_commits=5).drop("place"))
