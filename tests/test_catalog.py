import os

import pytest

from strataframe.jobs import catalog
from strataframe.operators.history import History
from strataframe.sources import star
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
#: Worked out once for all questions here: what is asked of a history is tested by many queries, how it comes about by those of the build.
_held = {}


@pytest.fixture(autouse=True)
def shared(monkeypatch):
    def once(name):
        made = getattr(star, name)

        def history(spark, sf_dir, *keep):
            if keep:
                return made(spark, sf_dir, *keep)
            if (name, sf_dir) not in _held:
                h = made(spark, sf_dir)
                _held[name, sf_dir] = History(*(x if x is None else x.persist() for x in (h.events, h.commits, h.snapshots, h.releases_table)))
            return _held[name, sf_dir]

        monkeypatch.setattr(star, name, history)

    once("history")
    once("prose_history")


@pytest.mark.parametrize("name", ["events_by_content", "snapshots_changed", "prose_timeline"])
def test_a_history_worked_out_for_one_query(spark, name, monkeypatch):
    monkeypatch.undo()
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_a_question_to_stored_tables_reads_its_entity_alone(spark):
    plan = catalog.QUERIES["stored_term_timeline"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert f"EqualTo(term_id,{catalog.TERM})" in plan and "RoundRobin" not in plan
    # nothing of the history is worked out anew: two scans, each named in the tree and below it
    assert plan.count("Scan parquet") == 4 and "Window" not in plan


def test_the_entry_hides_only_missing_parts(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/strataframe", tmp_path / "strataframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    run = lambda: subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert run().stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))]
    (tmp_path / "corpus_pipeline.py").write_text("import strataframe.no_such_part\n")
    assert "no_such_part" in run().stderr


def test_delta_takes_one_shuffle(spark):
    plan = catalog.QUERIES["events_delta"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan.split("Subquery")[0]
