"""What the command line prints, over a small history in git, and lists of releases and submissions."""

import json

import pytest

from strataframe.jobs import build
from strataframe.operators import commits, views
from strataframe.operators.history import History
from strataframe.sources import artifact
from tests.test_changes import document
from tests.test_git_source import Repo, run


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("views")
    r = Repo(root / "origin")
    r.save(document({"B:1": ["name: wren", 'xref: W:1 {source="a"} ! one'], "B:2": ["name: owl"]}))
    r.save(document({"B:1": ["name: wrens", 'xref: W:1 {source="b"} ! one'], "B:2": ["name: owl"]}))
    r.save(document({"B:1": ["name: wrens", 'xref: W:1 {source="b"} ! one', "xref: W:9"]}))
    run(r.root, "tag", "v1", "HEAD~1")
    out = str(root / "out")
    build.build_from_git(spark, str(r.root), "birds.obo", out)
    return out


def printed(capsys, *args):
    assert build.main(list(args)) == 0
    return [x for x in capsys.readouterr().out.split("\n") if x]


def test_term(spark, built, capsys):
    lines = printed(capsys, "term", built, "B:1")
    assert lines[0] == "B:1 — wrens" and lines[1] == "7 events across 3 commits" and lines[2].startswith("first 2020-09-13 (") and lines[2].endswith("PR #3)")
    assert lines[3] == "by predicate: xref 4, name 3"
    at = [i for i, x in enumerate(lines) if x.startswith("● ")]
    assert len(at) == 3 and lines[at[0]].endswith("version 1 (#1)") and lines[at[0] + 1] == "      PR #1"
    edits = lines[at[1] + 2 : at[2]]
    assert edits[0] == "~ name: [-wren-]{+wrens+}" and edits[1].startswith("~ xref: W:1") and any('source="' in x for x in edits[2:])
    assert lines[-1] == "+ xref: W:9"
    few = printed(capsys, "term", built, "B:1", "--limit", "1", "--pr-link", "https://example.org/pull/")
    assert few[1] == "showing 1 of 7 events across 1 commits" and "      https://example.org/pull/3" in few
    assert printed(capsys, "term", built, "B:2", "--at", "0")[1].split("\t") == ["B:2", "name", "owl"]


def test_commit_and_pull_request(spark, built, capsys):
    sha = artifact.open_history(spark, built).commits.filter("commit_seq = 2").first().sha
    lines = printed(capsys, "commit", built, sha[:9])
    assert lines[0].startswith(f"● {sha[:7]}  2020-09-13  A  version 3") and lines[2:] == ["2 terms changed", "B:1 — wrens", "+ xref: W:9", "B:2", "- name: owl"]
    assert printed(capsys, "pr", built, "3") == lines
    assert printed(capsys, "commit", built, "zz") == ["no commit zz"] and printed(capsys, "pr", built, "77") == []


def test_diff_and_search(spark, built, capsys):
    lines = printed(capsys, "diff", built, "0", "v1")
    assert lines[0] == "4 events across 1 terms and 1 commits between 0 and v1" and lines[1] == "B:1 — wrens" and lines[4].startswith("~ name")
    # the body is kept by the edit of its qualifiers, so a search for it leaves that out
    found = printed(capsys, "search", built, "W:1")
    assert found[0] == 'Found 1 events matching "W:1" across 1 terms and 1 commits' and found[-1] == '+ xref: W:1 {source="a"} ! one'
    assert printed(capsys, "search", built, "nothing") == ['No events matching "nothing"']
    assert printed(capsys, "search", built, "^W:[0-9]$", "--regex")[-1] == "+ xref: W:9"
    assert printed(capsys, "releases", built)[1].split("\t")[:2] == ["v1", "1"]


def test_empty_views(spark, built):
    h = artifact.open_history(spark, built)
    none = History(h.events.limit(0), h.commits, h.snapshots.limit(0), h._releases)
    assert views.term_view(none, "B:1").filter("step <> 1").count() == 0 and views.diff_view(none, 0, 2).count() == 1


def test_pages_of_releases(spark, tmp_path, capsys):
    one = lambda tag, at, **more: {"tag_name": tag, "published_at": at, "body": "Notes", "html_url": f"https://example.org/{tag}", "draft": False, "prerelease": False, "author": {"login": "ann"}, "assets": [{"name": "b.obo"}], "other": [1]} | more
    pages = [[one("t3", "2024-03-01T01:00:00Z"), one("t1", "2024-01-01T23:30:00Z", author=None, body=None)], [one("t2", "2024-02-01T00:00:00Z", draft=True), one("t4", "2024-04-01T00:00:00Z", assets=[{"name": "c"}, {}])], one("t5", "2024-05-01T00:00:00Z", prerelease=None), [], "text"]
    for i, p in enumerate([*map(json.dumps, pages), "not json", ""]):
        (tmp_path / f"{i}.json").write_text(p)
    df = spark.read.text(str(tmp_path), wholetext=True).withColumnRenamed("value", "body")
    listed = {r.tag_name: r for r in commits.releases_listed(df).collect()}
    assert set(listed) == {"t1", "t2", "t3", "t4", "t5"} and str(listed["t1"].published_at) == "2024-01-01 23:30:00" and listed["t1"].author_login is None and listed["t4"].assets == ["c"]
    assert build.main(["new-releases", str(tmp_path), "--asset", "b.obo"]) == 0
    lines = capsys.readouterr().out.split("\n")
    assert [x.split("\t")[0] for x in lines if "\t2024" in x] == ["t1", "t3", "t5"]


def test_a_list_of_another_language_stops_the_job(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps([{"submissionId": 4, "hasOntologyLanguage": "OWL"}]))
    with pytest.raises(commits.NoSuchLanguage):
        build.main(["new-submissions", str(tmp_path)])
