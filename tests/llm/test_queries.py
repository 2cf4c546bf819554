import itertools

import pytest

from strataframe.llm import exact, quality
from strataframe.llm.common import table
from strataframe.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_similar import shingles
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_its_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = table(spark, SF, "documents")
    columns, before, kept = docs.columns, docs, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, SF).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        kept[name] = before, after
        before = after
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert all(kept[n][1].columns == columns for n in ("quality", "exact", "near", "decontamination"))
    model = quality.train(docs, table(spark, SF, "labels"))
    assert ids(kept["quality"][1]) == {r.doc_id for r in quality.scores(docs, model).collect() if r.score >= 0.5}
    assert ids(kept["exact"][1]) == {r.doc_id for r in exact.op10_exact(kept["exact"][0]).collect() if r.kept}
    # no pair that stays is similar, and what goes has a similar text in the stage's input
    given, stays = {r.doc_id: shingles(r.text) for r in kept["near"][0].collect()}, ids(kept["near"][1])
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert stays <= set(given) and not any(jaccard(given[a], given[b]) >= 0.8 for a, b in itertools.combinations(stays, 2))
    assert all(max(jaccard(given[d], t) for e, t in given.items() if e != d) >= 0.65 for d in set(given) - stays)
    texts, items = ([(r[0], r.text) for r in df.collect()] for df in (kept["decontamination"][0], table(spark, SF, "benchmark")))
    assert ids(kept["decontamination"][1]) == ids(kept["decontamination"][0]) - {d for d, _ in brute.leaks(texts, items)}
    mixed = kept["mixing"][1].collect()
    assert mixed and {r.doc_id for r in mixed} <= ids(kept["mixing"][0]) and all(0 < r.taken <= 2 * r.size for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, mixed))


@pytest.mark.parametrize("none", [False, True])
def test_pipeline_of_odd_tables(spark, tmp_path, none):
    """Nulls, repeats, very long and empty texts, clashing names; and no rows at all."""
    import corpus_pipeline
    from tests.llm.cases import frame

    sf = str(tmp_path)
    frame(spark, [] if none else None).write.parquet(f"{sf}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{sf}/{name}.parquet")
    docs = table(spark, sf, "documents")
    given, columns = docs, docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, given, sf).write.parquet(f"{sf}/{name}")
        given = spark.read.parquet(f"{sf}/{name}")
        assert i == 4 or given.columns == columns
    whole = corpus_pipeline.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, given.collect()))
    assert (given.count() == 0) == none
