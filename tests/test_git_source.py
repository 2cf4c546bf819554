"""The git data source, the stanza stream and the keyed state, on repositories made here; nothing is replaced by stubs."""

import os
import random
import subprocess
import tracemalloc

import pytest
from pyspark.sql import functions as F

from strataframe.jobs import build
from strataframe.operators import changes
from strataframe.sources import artifact, git, git_source
from strataframe.streaming.entities import keyed_stream
from tests.test_changes import EVENT, document, frame, random_history, rows

SHOT = ("term_id", "commit_seq", "name", "is_obsolete", "content_hash", "clauses")
SKIP = ("commit_seq", "term_id", "error")


def run(root, *args, at=0, text=None):
    env = os.environ | {"GIT_AUTHOR_DATE": f"{1_600_000_000 + 60 * at} +0000", "GIT_COMMITTER_DATE": f"{1_600_000_000 + 60 * at} +0000", "GIT_CONFIG_GLOBAL": "/dev/null"}
    return subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.org", *args], check=True, capture_output=True, env=env, input=text, text=True).stdout.strip()


class Repo:
    def __init__(self, root):
        self.root, self.at = root, 0
        root.mkdir()
        run(root, "init", "-q", "-b", "main")
        for option in ("allowFilter", "allowAnySHA1InWant"):
            run(root, "config", f"uploadpack.{option}", "true")

    def save(self, text, file="birds.obo"):
        (self.root / file).write_text(text)
        run(self.root, "add", "-A")
        self.at += 1
        run(self.root, "commit", "-q", "--allow-empty", "-m", f"version {self.at} (#{self.at})", at=self.at)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    """A history of random documents, then a move."""
    r = Repo(tmp_path_factory.mktemp("git") / "origin")
    for n, d in enumerate(x for x in random_history(33, 16) if x is not None):
        r.save(document(d | {"N:1": [f"name: {n}"]}))
    run(r.root, "tag", "early", "HEAD~3")
    run(r.root, "mv", "birds.obo", "aves.obo")
    r.at += 1
    run(r.root, "commit", "-q", "-m", "move", at=r.at)
    return r


def test_merges_bring_in_what_ranges_list(tmp_path):
    """Against ``a..b`` for each merge of the first-parent line, with cross merges and merges of three parents."""
    for seed in range(3):
        root, r = tmp_path / str(seed), random.Random(seed)
        root.mkdir()
        run(root, "init", "-q", "-b", "main")
        tree = run(root, "mktree", text="")
        made = [run(root, "commit-tree", tree, "-m", "c0")]
        tips = [0]
        for n in range(1, 60):
            parents = dict.fromkeys(r.sample(tips[-6:], min(len(tips[-6:]), r.choice([1, 1, 1, 2, 2, 3]))))
            made.append(run(root, "commit-tree", tree, *(x for p in parents for x in ("-p", made[p])), "-m", f"c{n}\n\nbody", at=n))
            tips.append(n)
        run(root, "update-ref", "refs/heads/main", made[-1])
        found = git.brought_in(str(root))
        line = run(root, "log", "--first-parent", "--merges", "--format=%H %P").splitlines()
        assert set(found) == {x.split()[0] for x in line} and found
        for sha, first, second, *_ in map(str.split, line):
            want = run(root, "log", "--no-merges", "--format=%H %s", f"{first}..{second}").splitlines()
            assert [f"{c[0]} {c[3]}" for c in found[sha]] == want


def test_changes_are_those_of_whole_versions(spark, repo):
    versions = git.file_history(str(repo.root), "aves.obo")[1]
    whole = changes.change_rows(git.versions_frame(spark, str(repo.root), versions))
    columns = ("commit_seq", "sha", "term_id", "raw", "stanza")
    for per_task in ("1", "4", "100"):
        got = git_source.git_table(spark, str(repo.root), "aves.obo", "changes", versionsPerTask=per_task)
        assert rows(got, *columns) == rows(whole, *columns)
    assert got.filter("term_id = 'N:1'").count() == len(versions) - 1  # the move changes nothing


def test_filters_choose_commits_before_reading(spark, repo):
    df = git_source.git_table(spark, str(repo.root), "aves.obo", "changes", versionsPerTask="1")
    every = rows(df, "commit_seq", "term_id", "raw")
    for condition, keep in (("commit_seq = 3", lambda n: n == 3), ("commit_seq > 2 and commit_seq <= 5", lambda n: 2 < n <= 5), ("commit_seq in (1, 2, 7)", lambda n: n in (1, 2, 7)), ("commit_seq >= 4 and term_id = 'X:1'", None)):
        some = df.filter(condition)
        if keep:
            assert rows(some, "commit_seq", "term_id", "raw") == [x for x in every if keep(x[0])]
            assert some.rdd.getNumPartitions() == len({x[0] for x in every if keep(x[0])})
        else:
            assert rows(some, "commit_seq", "term_id", "raw") == [x for x in every if x[0] >= 4 and x[1] == "X:1"]
    assert git_source.git_table(spark, str(repo.root), "aves.obo", "commits").filter("commit_seq < 2").count() == 2
    assert [r.tag for r in git_source.git_table(spark, str(repo.root), "aves.obo", "tags").collect()] == ["early"]


def test_a_window_counts_from_its_first_version(spark, repo):
    versions = git.file_history(str(repo.root), "aves.obo")[1]
    whole = changes.build(git.versions_frame(spark, str(repo.root), versions[-5:]))
    made = changes.tables_of_changes(git_source.git_table(spark, str(repo.root), "aves.obo", "changes", window="5", versionsPerTask="2"))
    assert rows(made["events"], *EVENT) == rows(whole["events"], *EVENT) and rows(made["skipped"], *SKIP) == rows(whole["skipped"], *SKIP)


def test_missing_blobs_end_no_stretch(spark, repo, tmp_path):
    versions = [(seq, sha, path, "1" * 40 if seq in (0, 3, 4, 5) else blob) for seq, sha, path, blob in git.file_history(str(repo.root), "aves.obo")[1]]
    whole = changes.change_rows(git.versions_frame(spark, str(repo.root), versions))
    with git.Blobs(str(repo.root)) as blobs:
        got = list(git.changed_stanzas(blobs, [(v[0], v[1], v[3]) for v in versions[:6]], []))
        got += git.changed_stanzas(blobs, [(v[0], v[1], v[3]) for v in versions[6:]], [v[3] for v in versions[:6]][::-1])
    assert sorted(((s, sha, t, raw, x) for s, sha, t, _, raw, x in got), key=str) == rows(whole, "commit_seq", "sha", "term_id", "raw", "stanza")


def test_change_tables_follow_the_full_build(spark):
    for seed in range(3):
        versions = frame(spark, [d if d is None else document(d) for d in random_history(seed)])
        full, made = changes.build(versions), changes.tables_of_changes(changes.change_rows(versions))
        for name, columns in (("events", EVENT), ("term_snapshots", SHOT), ("skipped", SKIP)):
            assert rows(made[name], *columns) == rows(full[name], *columns)


def test_keyed_state_gives_the_full_build(spark, tmp_path):
    history = random_history(21, 15)
    versions = frame(spark, [d if d is None else document(d) for d in history])
    full, given = changes.build(versions), changes.change_rows(versions).persist()
    source = tmp_path / "in"
    for k in range(3):
        given.filter(F.floor(F.col("commit_seq") / 5) == k).coalesce(1).write.mode("append").parquet(str(source))
        keyed_stream(spark.readStream.schema(given.schema).parquet(str(source)), str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    for name, columns in (("events", EVENT), ("term_snapshots", SHOT), ("skipped", SKIP)):
        assert rows(spark.read.parquet(str(tmp_path / "h" / name)), *columns) == rows(full[name], *columns)


def test_sync_from_the_command_line(spark, tmp_path):
    """Clone without contents, fetch those of the file, build; then fetch and append what is new."""
    r = Repo(tmp_path / "origin")
    r.save(document({"B:1": ["name: wren"], "B:2": ["name: owl"]}))
    r.save(document({"B:1": ["name: jenny"], "B:2": ["name: owl"]}))
    call = lambda: build.main(["sync", f"file://{r.root}", "birds.obo", str(tmp_path / "clone"), str(tmp_path / "out")])
    assert call() == 0
    touched = lambda n: spark.read.parquet(str(tmp_path / "out" / "events" / f"batch={n}")).count()
    assert touched(0) == 4
    r.save(document({"B:1": ["name: jenny"], "B:3": ["name: kite"], "B:4": ['synonym: "y" VAGUELY [Z:9]']}))
    assert call() == 0 and touched(1) == 2
    assert call() == 0  # nothing new
    full = str(tmp_path / "full")
    build.build_from_git(spark, str(r.root), "birds.obo", full)
    for name, columns in (("events", EVENT), ("term_snapshots", SHOT), ("skipped", SKIP), ("commits", ("commit_seq", "sha", "pr_number")), ("build_meta", ("last_commit_seq", "n_commits"))):
        assert rows(artifact.read_table(spark, str(tmp_path / "out"), name), *columns) == rows(artifact.read_table(spark, full, name), *columns)
    assert [x.value for x in artifact.open_history(spark, str(tmp_path / "out")).timeline("B:2").collect()] == ["owl", "owl"]
    run(tmp_path / "clone", "cat-file", "-e", "HEAD:birds.obo")


def test_a_rewritten_history_is_refused(repo):
    reader = git_source.GitHistoryStream({"path": str(repo.root), "file": "aves.obo"}, "changes")
    end = reader.latestOffset()
    assert reader.partitions({"versions": 1, "sha": git.file_history(str(repo.root), "aves.obo")[1][0][1]}, end)
    with pytest.raises(git_source.HistoryRewritten):
        reader.partitions({"versions": 1, "sha": "0" * 40}, end)


def test_memory_follows_a_stanza_and_not_a_version():
    def lines(n):
        for i in range(n):
            yield f"[Term]\nid: A:{i % 50}\n".encode()[:7], True
            yield f"id: A:{i % 50}\n".encode(), True
            for _ in range(200):
                yield b"x: " + b"y" * 1000 + b"\n", True

    peaks = []
    for n in (20, 200):
        tracemalloc.start()
        assert sum(1 for _ in git.entity_stanzas(lines(n))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 5_000_000


def test_stanzas_may_come_in_pieces():
    text = b"header\n[Term]\nid: A:1\nname: a\n[Typedef]\nid: t\n[Term]\nid:  A:2 ! b\nx: " + b"[Term]\n[not a head] y\n" + b"z: " + b"q" * 50
    want = [("A:1", "[Term]\nid: A:1\nname: a\n"), ("A:2", "[Term]\nid:  A:2 ! b\nx: [Term]\n[not a head] y\nz: " + "q" * 50)]
    for most in (8, 10_000):  # no line's head is longer
        pieces = [(line[i : i + most], i == 0) for line in text.splitlines(True) for i in range(0, len(line), most)]
        if most < len("[Typedef]\n"):
            pieces = [p for line in text.splitlines(True) for p in ([(line, True)] if line.startswith(b"[") else [(line[i : i + most], i == 0) for i in range(0, len(line), most)])]
        assert [(i, t) for _, i, t in git.entity_stanzas(pieces)] == want
