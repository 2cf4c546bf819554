"""Column expressions for clauses, messages, tags and URLs. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns whose matches are part of the results.
TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_:/.\-]*|\s+|[^\p{L}\p{N}_\s]"
MERGE_SUBJECT = r"^Merge pull request #(\d+) from "
SQUASH_MARK = r"\(#(\d+)\)"
RELEASE_URL = r"(?m)^Release URL: (\S+)"
REPOSITORY_URL = r"^https?://github\.com/([^/]+/[^/]+?)(?:\.git)?/?$"
TAG = r"^[A-Za-z0-9._/-]+$"
FORMAT_HEADER = r"^\s*format-version:\s*\d"
ELLIPSIS = "…"


def or_null(c: Column) -> Column:
    """Null for an empty string."""
    return F.when(c != "", c)


def tokens(c: Column) -> Column:
    """Identifiers kept whole, runs of blanks, single marks."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def clause(line: Column) -> Column:
    """predicate and value on both sides of the first ``": "``; without one the value is empty."""
    at = F.instr(line, ": ")
    return F.struct(
        F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line).alias("predicate"),
        F.when(at > 0, F.substring(line, at + 2, F.length(line))).otherwise(F.lit("")).alias("value"),
    )


def snapshot_url(message: Column) -> Column:
    return or_null(F.regexp_extract(message, RELEASE_URL, 1))


def pr_number(message: Column) -> Column:
    """Of a merge subject, else the first squash mark; none where the message names a release."""
    found = F.coalesce(or_null(F.regexp_extract(message, MERGE_SUBJECT, 1)), or_null(F.regexp_extract(message, SQUASH_MARK, 1)))
    return F.when(snapshot_url(message).isNull(), found.try_cast("int"))


def first_line(message: Column) -> Column:
    return F.element_at(F.split(message, "\n"), 1)


def subject(message: Column) -> Column:
    """The first line, but of a classic merge the first body line that isn't blank, where there is one."""
    lines = F.split(message, "\n")
    body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "")
    return F.when(message.rlike(MERGE_SUBJECT), F.coalesce(F.trim(F.try_element_at(body, F.lit(1))), first_line(message))).otherwise(first_line(message))


def repository(url: Column) -> Column:
    """owner/name of a repository's address."""
    return or_null(F.regexp_extract(url, REPOSITORY_URL, 1))


def short_sha(sha: Column) -> Column:
    return F.substring(sha, 1, 7)


def date_prefix(at: Column) -> Column:
    """The day, as ten characters."""
    return F.date_format(at, "yyyy-MM-dd")


def truncated(c: Column, cap: int = 200) -> Column:
    return F.when(F.length(c) > cap, F.concat(F.substring(c, 1, cap - 1), F.lit(ELLIPSIS))).otherwise(c)


def release_tag(version: Column, submission: Column) -> Column:
    """The version where it can be a tag, else ``sub-<id>``."""
    good = version.rlike(TAG) & (F.lower(F.trim(version)) != "unknown")
    return F.when(good, version).otherwise(F.concat(F.lit("sub-"), submission.cast("string")))


def looks_like_document(content: Column) -> Column:
    """Whether the first 2048 bytes start, blanks aside, with a format version."""
    # byte by byte: a cut may fall within a character
    return F.decode(F.substring(content.cast("binary"), 1, 2048), "ISO-8859-1").rlike(FORMAT_HEADER)


def human_size(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):  # noqa: B007
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{int(size)} B" if unit == "B" else f"{size:.1f} {unit}"
