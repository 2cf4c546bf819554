"""Versions of a file out of a git repository.

The history is listed once on the driver (metadata, a line a commit); contents are read where they are
needed, by one ``git cat-file`` per partition, from a clone that all executors see.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
import subprocess
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

FIELD, RECORD, NO_BLOB = "\x1f", "\x1e", "0" * 40
VERSIONS = "commit_seq int, sha string, path string, blob string"


def git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def clone(url: str, to: str, ref: str | None = None, since: str | None = None, depth: int | None = None) -> None:
    """Without contents; ``since`` goes before ``depth``."""
    cut = ["--shallow-since", since] if since else ["--depth", str(depth)] if depth else []
    subprocess.run(["git", "clone", "--filter=blob:none", "--no-checkout", *(["--branch", ref] if ref else []), *cut, url, to], check=True)


def synced(url: str, to: str, path: str, ref: str | None = None, since: str | None = None) -> str:
    """A clone with all contents of ``path``; doing it again fetches what is new and moves the branch to it. ``since`` counts for the first time only."""
    if os.path.isdir(os.path.join(to, ".git")):
        git(to, "fetch", "--tags")
        if git(to, "branch", "--show-current").strip():
            git(to, "update-ref", "HEAD", "@{upstream}")  # nothing is checked out, so the branch may simply move
    else:
        clone(url, to, ref, since)
    backfill(to, path)
    return to


def backfill(repo: str, path: str) -> None:
    """Fetch the contents of one path at once; where git has no ``backfill`` yet, those that its history names and the clone lacks."""
    try:
        git(repo, "backfill", "-h")
    except subprocess.CalledProcessError as e:
        known = e.returncode == 129  # what git says after printing how a command is used
    else:
        known = True
    if known:
        git(repo, "sparse-checkout", "set", "--no-cone", path)
        git(repo, "backfill", "--sparse")
        return
    names = {v[2] for v in file_history(repo, path)[1]} | {path}
    lacking = [x[1:] for x in git(repo, "rev-list", "--objects", "--missing=print", "HEAD", "--", *sorted(names)).splitlines() if x.startswith("?")]
    if lacking:
        fetch = ["git", "-C", repo, "-c", "fetch.negotiationAlgorithm=noop", "fetch", "origin", "--no-tags", "--no-write-fetch-head", "--recurse-submodules=no", "--filter=blob:none", "--stdin"]
        subprocess.run(fetch, input="\n".join(lacking) + "\n", check=True, capture_output=True, text=True)


def repack(repo: str, window_memory: str = "1g") -> None:
    git(repo, "-c", f"pack.windowMemory={window_memory}", "repack", "-a", "-d", "-f")


def when(text: str) -> datetime:
    """ISO date with a zone -> UTC without one."""
    return datetime.fromisoformat(text).astimezone(timezone.utc).replace(tzinfo=None)


def brought_in(repo: str, ref: str = "HEAD") -> dict[str, list[tuple]]:
    """For each merge on the first-parent line of ``ref`` the commits that its second parent brought in, newest first, without merges.

    One listing of the commit graph, and one walk along the line from its oldest commit on: what a merge reaches
    and no earlier one did is its own. Each commit is looked at once, whatever the number of merges.
    """
    out = git(repo, "log", f"--format=%H{FIELD}%P{FIELD}%an{FIELD}%aI{FIELD}%s{RECORD}", ref)
    rows = [r.strip("\n").split(FIELD, 4) for r in out.split(RECORD) if r.strip()]
    parents = {r[0]: r[1].split() for r in rows}
    place = {r[0]: i for i, r in enumerate(rows)}
    line, at = [], rows[0][0] if rows else None
    while at in parents:  # a shallow clone ends where parents aren't listed
        line.append(at)
        at = parents[at][0] if parents[at] else None
    seen, found = set(), {}

    def walk(start: str) -> list[str]:
        reached, todo = [], [start]
        while todo:
            at = todo.pop()
            if at in parents and at not in seen:
                seen.add(at)
                reached.append(at)
                todo += parents[at]
        return reached

    for sha in reversed(line):
        seen.add(sha)
        second, *others = parents[sha][1:] or [None]
        if second:
            own = sorted(place[x] for x in walk(second) if len(parents[x]) < 2)
            found[sha] = [(rows[i][0], rows[i][2], when(rows[i][3]), rows[i][4].strip()) for i in own]
        for x in others:
            walk(x)
    return found


def file_history(repo: str, path: str, ref: str = "HEAD") -> tuple[list[tuple], list[tuple]]:
    """(commit rows, version rows), oldest first, following renames along first parents.

    Commits without content of the path (deletions) are left out; numbers are dense over the others.
    """
    fields = FIELD.join(["%H", "%an", "%ae", "%aI", "%P", "%B"])
    out = git(repo, "log", ref, "--follow", "--first-parent", "-m", "--raw", "--no-abbrev", f"--format={RECORD}{fields}{FIELD}", "--", path)
    commits, versions, merged = [], [], None
    for record in reversed([r for r in out.split(RECORD) if r.strip()]):
        sha, author, email, date, parents, message, raw = record.split(FIELD, 6)
        lines = [x for x in raw.splitlines() if x.startswith(":")]
        if not lines:
            continue
        head, *names = lines[0].split("\t")
        blob = head.split()[3]
        if blob == NO_BLOB:
            continue
        seq, above = len(commits), parents.split()
        if len(above) > 1 and merged is None:
            merged = brought_in(repo, ref)
        commits.append((seq, sha, author, email, when(date), message.strip(), above[0] if above else None, merged.get(sha, []) if len(above) > 1 else []))
        versions.append((seq, sha, names[-1], blob))
    return commits, versions


def tags(repo: str) -> list[tuple[str, str, datetime]]:
    """(name, commit, author date) of each tag that leads to a commit, through annotated tags; one listing for all."""
    kinds = ["objecttype", "objectname", "authordate:iso-strict"]
    fields = FIELD.join(["%(refname:short)", *(f"%({k})" for k in kinds), *(f"%(*{k})" for k in kinds)])
    out = []
    for line in git(repo, "for-each-ref", "refs/tags", f"--format={fields}").splitlines():
        tag, *own = line.split(FIELD)
        kind, sha, date = own[3:] if own[3] else own[:3]
        if kind == "commit":
            out.append((tag, sha, when(date)))
    return out


def versions_frame(spark: SparkSession, repo: str, rows: list[tuple], per_task: int = 32) -> DataFrame:
    """commit_seq, sha, content of each version; null content where the blob is missing."""
    listed = spark.createDataFrame(rows, VERSIONS)
    listed = listed.repartitionByRange(max(1, -(-len(rows) // per_task)), "commit_seq")

    def read(batches):
        with subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
            for batch in batches:
                for seq, sha, blob in zip(batch["commit_seq"], batch["sha"], batch["blob"]):
                    p.stdin.write(f"{blob}\n".encode())
                    p.stdin.flush()
                    size = p.stdout.readline().split()
                    text = None  # "<name> missing"
                    if len(size) == 3:
                        text = p.stdout.read(int(size[2])).decode("utf-8", "replace")
                        p.stdout.read(1)
                    yield pd.DataFrame({"commit_seq": [seq], "sha": [sha], "content": [text]})  # one at a time: they are large
            p.stdin.close()

    return listed.mapInPandas(read, "commit_seq int, sha string, content string")


class Blobs:
    """Contents from one ``git cat-file``, a piece at a time."""

    PIECE = 1 << 20

    def __init__(self, repo: str):
        self.process = subprocess.Popen(["git", "-C", repo, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.process.stdin.close()
        self.process.stdout.close()
        self.process.wait()

    def lines(self, blob: str):
        """An iterator of (piece, whether it begins a line), or None where the blob is missing. To be read to its end."""
        self.process.stdin.write(f"{blob}\n".encode())
        self.process.stdin.flush()
        told = self.process.stdout.readline().split()
        return self._lines(int(told[2])) if len(told) == 3 else None

    def _lines(self, left: int):
        begins = True
        while left:
            piece = self.process.stdout.readline(min(left, self.PIECE))
            if not piece:
                raise OSError("git cat-file ended early")
            left -= len(piece)
            yield piece, begins
            begins = piece.endswith(b"\n")
        self.process.stdout.read(1)


_HEAD = re.compile(rb"\[[^\]\n]+\]\n")
_ID = re.compile(r"^id: [^\S\n]*(\S+)", re.M | re.A)


def entity_stanzas(lines):
    """(pos, id, stanza) of the entities of a document that comes in pieces of lines; only one stanza is held."""
    held, pos = [], 0
    for piece, begins in itertools.chain(lines, [(None, True)]):
        if piece is None or begins and _HEAD.fullmatch(piece):
            text = b"".join(held)
            if text.startswith(b"[Term]\n"):
                text = text.decode("utf-8", "replace")
                if m := _ID.search(text):
                    yield pos, m[1], text
            held, pos = [], pos + 1
        if piece is not None:
            held.append(piece)


def changed_stanzas(blobs: Blobs, versions: list[tuple[int, str, str]], before: list[str]):
    """CHANGES of consecutive versions (commit_seq, sha, blob), after the first readable one of the blobs ``before``.

    Of a version only the digests of its stanzas are kept, for the next one: a row for each entity that is new, has other
    bytes or is gone, and one without an entity for a version whose content is missing. An id that occurs again in a
    version gives further rows; the last counts.
    """
    digest = lambda text: hashlib.sha1(text.encode()).digest()
    known: dict[str, bytes] = {}
    for blob in before:
        lines = blobs.lines(blob)
        if lines is not None:
            known = {i: digest(text) for _, i, text in entity_stanzas(lines)}
            break
    for seq, sha, blob in versions:
        lines = blobs.lines(blob)
        if lines is None:
            yield seq, sha, None, None, None, None
            continue
        now: dict[str, bytes] = {}
        for pos, i, text in entity_stanzas(lines):
            d = digest(text)
            if known.get(i) != d or i in now:
                yield seq, sha, i, pos, d.hex(), text
            now[i] = d
        for i in known.keys() - now.keys():
            yield seq, sha, i, None, None, None
        known = now
