"""Schemas of the history tables. Timestamps have no zone and hold UTC."""

CLAUSE = "struct<predicate:string,value:string>"
BRANCH_COMMIT = "struct<sha:string,author_name:string,committed_date:timestamp_ntz,message:string>"

TABLES = {
    "commits": (
        "commit_seq int, sha string, author_name string, author_email string, committed_date timestamp_ntz, message string, "
        f"pr_number int, parent_sha string, branch_commits array<{BRANCH_COMMIT}>, snapshot_url string"
    ),
    "term_snapshots": f"term_id string, commit_seq int, sha string, name string, is_obsolete boolean, content_hash string, clauses array<{CLAUSE}>",
    "events": "term_id string, commit_seq int, sha string, predicate string, value string, operation string",
    "releases": "tag string, sha string, date timestamp_ntz, commit_seq int",
    "skipped": "commit_seq int, sha string, term_id string, error string",
    "build_meta": "schema_version string, generator_version string, source_path string, first_commit_seq int, last_commit_seq int, n_commits int",
}
REQUIRED = ("commits", "term_snapshots", "events")
SCHEMA_VERSION = "1"
#: What changes from version to version: a stanza with other bytes; without ``raw`` one that is gone; without ``term_id`` a version whose
#: content is missing. Of rows of one entity and version the greatest ``pos`` counts.
CHANGES = "commit_seq int, sha string, term_id string, pos int, raw string, stanza string"
