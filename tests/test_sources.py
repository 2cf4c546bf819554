import os
import subprocess

import pytest

from strataframe.jobs.build import build_from_git
from strataframe.operators.commits import releases_asof, unchanged_content
from strataframe.sources import artifact, git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def run(*args, day="2021-01-01"):
        env = os.environ | {"GIT_AUTHOR_DATE": f"{day}T00:00:00+00:00", "GIT_COMMITTER_DATE": f"{day}T00:00:00+00:00", "GIT_CONFIG_GLOBAL": "/dev/null"}
        subprocess.run(["git", "-C", str(root), "-c", "user.name=A", "-c", "user.email=a@example.org", *args], check=True, capture_output=True, env=env)

    def save(file: str, *stanzas: str):
        (root / file).parent.mkdir(exist_ok=True)
        (root / file).write_text("format-version: 1.4\nontology: birds\n\n" + "\n".join(stanzas))
        run("add", "-A")

    wren, heron = "[Term]\nid: B:17\nname: wren\n", "[Term]\nid: B:40\nname: heron\n"
    run("init", "-b", "trunk")
    save("lists/birds.obo", wren, heron)
    run("commit", "-m", "Two birds (#3)", day="2022-05-01")
    run("checkout", "-b", "names", day="2022-05-02")
    save("lists/birds.obo", wren + 'synonym: "jenny" RELATED []\n', heron)
    run("commit", "-m", "Jenny is a wren\n\nAsked for on the list.", day="2022-05-02")
    save("lists/birds.obo", wren + 'synonym: "jenny" RELATED []\nis_a: B:9 ! songbird\n', heron)
    run("commit", "-m", "Wrens sing", day="2022-05-03")
    run("checkout", "trunk")
    run("merge", "--no-ff", "-m", "Merge pull request #8 from names\n\nMore on wrens", "names", day="2022-05-04")
    run("tag", "-a", "spring", "-m", "first list", day="2022-05-05")
    save("lists/birds.obo", wren + 'synonym: "jenny" RELATED []\nis_a: B:9 ! songbird\n')
    run("commit", "-m", "No heron here", day="2022-05-06")
    run("mv", "lists/birds.obo", "aves.obo")
    run("commit", "-m", "Move", day="2022-05-07")
    return str(root)


def test_history_follows_renames_and_merges(repo):
    commits, versions = git.file_history(repo, "aves.obo")
    assert [c[5].split("\n")[0] for c in commits] == ["Two birds (#3)", "Merge pull request #8 from names", "No heron here", "Move"]
    assert [v[2] for v in versions] == ["lists/birds.obo"] * 3 + ["aves.obo"] and versions[2][3] == versions[3][3]
    # subjects alone, newest first
    assert [m[3] for m in commits[1][7]] == ["Wrens sing", "Jenny is a wren"] and commits[0][7] == []
    # an annotated tag leads to its commit and that one's date
    assert [(t, sha, str(at)) for t, sha, at in git.tags(repo)] == [("spring", commits[1][1], "2022-05-04 00:00:00")]


def test_build_from_git_and_questions(spark, repo, tmp_path, capsys):
    out = str(tmp_path / "a")
    counts = build_from_git(spark, repo, "aves.obo", out)
    assert counts == {"term_snapshots": 3, "events": 5, "skipped": 0, "commits": 4, "releases": 1, "build_meta": 1}
    h = artifact.open_history(spark, out, views=True)
    assert [(r.predicate, r.commit_seq, r.pr_number) for r in h.timeline("B:17").collect()] == [("name", 0, 3), ("is_a", 1, 8), ("synonym", 1, 8)]
    assert [r.commit_seq for r in h.releases().collect()] == [1]
    for a, b in (("spring", "HEAD"), ("head", "spring")):
        assert [(r.term_id, r.operation) for r in h.range_events(a, b).collect()] == [("B:40", "remove")]
    assert h.pr_terms(42).count() == 0 and [r.term_id for r in h.pr_terms(8).collect()] == ["B:17"]
    assert [r.value for r in h.states_at(0, "B:17").collect()] == ["wren"] and h.states_at(3, "B:40", strict=True).count() == 0
    assert h.resolve("spring") == 1 and h.resolve("2") == 2 and h.resolve(h.commits.filter("commit_seq = 3").first().sha[:9]) == 3
    with pytest.raises(KeyError):
        h.resolve("nothing")
    header = h.headers("B:17").first()
    assert (header.current_name, header.event_count, header.last_pr) == ("wren", 3, 8)
    assert spark.sql("select count(*) from events").first()[0] == 5
    artifact.compact(spark, out, "events", str(tmp_path / "b"))
    assert artifact.read_table(spark, str(tmp_path / "b"), "events").count() == 5
    heads = {r.commit_seq: r.header.split("\n") for r in h.commit_headers(pr_link="https://example.org/pull/").collect()}
    assert [x[9:] for x in heads[1][:1]] == ["2022-05-04  A  More on wrens"] and heads[1][1:] == ["      Merge pull request #8 from names", "      https://example.org/pull/8"]
    shown = h.commit_headers(show_commits=True).filter("commit_seq = 1").first().header.split("\n")
    assert [x.split("  ")[-1] for x in shown[3:]] == ["Wrens sing", "Jenny is a wren"]


def test_command_line_prints_every_row(spark, repo, tmp_path, capsys, monkeypatch):
    from strataframe.jobs import build

    df = spark.range(2500).selectExpr("id", "repeat('x', 300) as long")
    build.printed(df)
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 2501 and len(lines[-1]) > 300


def test_a_clone_is_made_once_and_then_fetched(repo, tmp_path, monkeypatch):
    done = []
    monkeypatch.setattr(git, "clone", lambda url, to, ref, since: (done.append("clone"), subprocess.run(["git", "clone", "-q", url, to], check=True)))
    monkeypatch.setattr(git, "backfill", lambda to, path: done.append(f"backfill {path}"))
    for _ in range(2):
        git.synced(repo, str(tmp_path / "c"), "aves.obo")
    assert done == ["clone", "backfill aves.obo", "backfill aves.obo"] and git.tags(str(tmp_path / "c"))[0][0] == "spring"


def test_missing_blobs_have_no_content(spark, repo):
    _, versions = git.file_history(repo, "aves.obo")
    lost = [(9, "s", "aves.obo", "1" * 40)]
    got = {r.commit_seq: r.content for r in git.versions_frame(spark, repo, versions + lost).collect()}
    assert got[9] is None and got[0].startswith("format-version: 1.4")


def test_submissions_of_another_language_alone_are_an_error(spark):
    from strataframe.operators.commits import NoSuchLanguage, require_language, submissions

    pages = spark.createDataFrame([('[{"submissionId": 1, "hasOntologyLanguage": "OWL"}]',), ('{"collection": [], "nextPage": null}',), ("not json",)], "body string")
    listed = submissions(pages)
    assert [r.submission_id for r in listed.collect()] == [1]
    with pytest.raises(NoSuchLanguage):
        require_language(listed)
    assert require_language(listed, "OWL").count() == 1


def test_missing_tables_are_named(spark, tmp_path):
    with pytest.raises(artifact.ArtifactNotFound, match="commits, term_snapshots, events"):
        artifact.open_history(spark, str(tmp_path))


def test_older_tables_lack_columns(spark, tmp_path):
    spark.sql("select 1 as commit_seq, 'x' as sha").write.parquet(str(tmp_path / "commits"))
    row = artifact.read_table(spark, str(tmp_path), "commits").first()
    assert row.sha == "x" and row.snapshot_url is None


def test_releases_stop_at_the_first_later_commit(spark):
    commits = spark.sql("select * from values (0, timestamp_ntz'2021-01-01 00:00:00'), (1, timestamp_ntz'2021-03-01 00:00:00'), (2, timestamp_ntz'2021-01-03 00:00:00') as t(commit_seq, committed_date)")
    tags = spark.sql("select * from values ('a', 's', timestamp_ntz'2021-01-05 00:00:00'), ('b', 's', timestamp_ntz'2021-03-01 00:00:00'), ('c', 's', timestamp_ntz'2020-01-01 00:00:00') as t(tag, sha, date)")
    assert sorted((r.tag, r.commit_seq) for r in releases_asof(tags, commits).collect()) == [("a", 0), ("b", 2)]


@pytest.mark.parametrize("stretches", [1, 3, 50])
def test_unchanged_content_over_stretches(spark, stretches):
    import random

    rng = random.Random(stretches)
    rows = [(n, rng.choice(["a", "a", "b", "", None])) for n in sorted(rng.sample(range(-100, 500), 60))]
    want, before, version = {}, None, None
    for n, text in rows:
        kept = before is None or before != (text or "")
        before, version = text or "", n if kept else version
        want[n] = kept, version
    rng.shuffle(rows)
    versions = spark.createDataFrame(rows, "n long, text string")
    got = {r.n: (r.kept, r.version) for r in unchanged_content(versions, "text", "n", stretches).collect()}
    assert got == want
    assert unchanged_content(versions.filter("n > 1000"), "text", "n").count() == 0
