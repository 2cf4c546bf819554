import os
import random

from pyspark.sql import functions as F

from strataframe.operators.history import History
from strataframe.sources import artifact, star
from strataframe.sources.search_index import candidates, index_events, indexed_search, literals, needed

EVENTS = "term_id string, commit_seq int, sha string, predicate string, value string, operation string"


def test_pieces_that_a_hit_needs():
    assert literals("abcd", False) == ["abcd"] and literals("abc?def", False) == ["def"] and literals("abcd*e", False) == ["abc"] and literals("x{2}abc", False) == ["abc"]
    assert literals("abc|def", False) == [] and literals("(abc)+def", False) == ["def"] and literals("(?i)abc", False) == [] and literals("ab[cd]efg", False) == ["efg"]
    assert literals(r"abc\.defg", False) == ["abc", "defg"] and literals("[a\\]b]cde", False) == [] and literals("gabesk", True) == ["gabe"] and literals("übel", True) == ["bel"]
    assert needed("ab") == set() and needed("ABCD", ignore_case=True) == {"abc", "bcd"}


def test_searches_find_what_a_scan_finds(spark, tmp_path):
    r, root = random.Random(3), str(tmp_path / "h")
    word = lambda: "".join(r.choice("abSKxé İſ") for _ in range(r.randrange(9)))
    rows = [(f"T:{i:03}", i % 7, "s", "p", f"{word()} {word()} file{i // 40}", r.choice(["add", "remove"])) for i in range(400)]
    commits = spark.createDataFrame([(i, "s") for i in range(7)], "commit_seq int, sha string")
    shots = spark.createDataFrame([], "term_id string, commit_seq int")
    artifact.write_table(commits, root, "commits"), artifact.write_table(shots, root, "term_snapshots")
    for part in range(2):
        own = spark.createDataFrame([x for i, x in enumerate(rows) if i % 2 == part], EVENTS)
        own.repartitionByRange(5, "term_id").write.mode("append").parquet(f"{root}/events")
        if not part:
            assert index_events(spark, root) == 5 and index_events(spark, root) == 0
    h = artifact.open_history(spark, root)
    plain = History(h.events.persist(), h.commits, h.snapshots)
    hits = lambda df: sorted((x.term_id, x.value) for x in df.collect())
    for step in range(2):
        queries = [(word(), regex, fold) for _ in range(6) for regex in (False,) for fold in (False, True)]
        queries += [(q, True, fold) for q in ("ab+x", "file[37]", "S ?K", "x file5$", "bab|file1") for fold in (False, True)] + [("file6", False, False), ("FILE6", False, True)]
        for q, regex, fold in queries:
            assert hits(indexed_search(spark, root, q, regex, fold)) == hits(plain.search(q, regex=regex, ignore_case=fold)), (q, regex, fold)
        # files that aren't indexed yet are read too
        assert len(candidates(spark, root, "file6")) <= (2 if step else 6) and len(candidates(spark, root, "fi")) == 10
        index_events(spark, root)
    few = indexed_search(spark, root, "file6")
    assert 0 < len([f for f in few.inputFiles() if "/events/" in f]) <= 2 and few.count() == 40
    assert indexed_search(spark, root, "nowhere to be found").count() == 0
    assert few.agg(F.min("commit_seq")).first()[0] == 0


def test_building_leaves_no_shuffle_files(spark, tmp_path):
    root = f"{tmp_path}/sf0.001"
    os.symlink("/root/testdata/sf0.001", root)

    def shuffled() -> set[str]:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(found.size()) if (name := found.apply(i).getName()).startswith("shuffle_")}

    before = shuffled()
    at = star.stored_prose(spark, root)
    presence = star.prose_once(spark, root)
    assert not shuffled() - before and not os.path.exists(f"{at}/_build")
    assert artifact.open_history(spark, at).events.count() == presence.events.count() > 0
    assert spark.conf.get(artifact.CLEANUP) == "false"
