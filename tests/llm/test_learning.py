import zlib

import numpy as np
import pytest

from strataframe.llm import quality, toxicity
from tests.llm.cases import frame, prose

SF = "/root/testdata/sf0.01"


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    yes = np.asarray(truth, bool)
    return (ranks[yes].sum() - yes.sum() * (yes.sum() + 1) / 2) / (yes.sum() * (~yes).sum())


def test_quality_on_held_out_rows(spark):
    got = quality.op5_quality(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.collect()
    assert len(rows) == n and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = got.join(labels, "doc_id").filter("held_out").collect()
    assert auc([r.score for r in held], [r.quality for r in held]) > 0.95
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95


def test_toxicity_on_held_out_rows(spark):
    got = toxicity.op8_toxicity(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id", "toxic as truth")
    held = [r for r in got.join(labels, "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert auc([r.score for r in held], [r.truth for r in held]) > 0.9
    assert sum(r.toxic and not r.truth for r in held) <= 3
    # some toxic documents have none of the words, nor beginnings of words, that mark the others
    assert sum(r.toxic and r.truth for r in held) >= 0.75 * sum(r.truth for r in held)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "if(crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    a, b = quality.train(docs, labels), quality.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias


def test_the_risk_is_that_of_its_definition():
    """Against the two expectations written out row by row, and their differences."""
    r = np.random.default_rng(4)
    p, u = (np.hstack([r.normal(m, 1, (n, 3)), np.ones((n, 1))]) for m, n in ((1, 7), (0, 11)))
    w, prior = r.normal(0, 1, 4), 0.3

    def by_hand(w):
        loss = lambda rows, sign: sum(float(np.log(1 + np.exp(-sign * (x @ w)))) for x in rows) / len(rows)
        return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)

    positive, gain, negative, part = quality.pu_risk(w, p, u, prior)
    assert (positive, negative) == pytest.approx(by_hand(w))
    for k in range(4):
        step = np.eye(4)[k] * 1e-5
        slopes = [(a - b) / 2e-5 for a, b in zip(by_hand(w + step), by_hand(w - step))]
        assert (gain[k], part[k]) == pytest.approx(slopes, abs=1e-6)


def test_the_prior_comes_from_positives_and_unlabelled_rows_alone(spark):
    r = np.random.default_rng(5)
    for prior in (0.2, 0.5, 0.8):
        n = int(4000 * prior)
        unlabelled = r.permutation(np.vstack([r.normal(3, 1, (n, 4)), r.normal(-3, 1, (4000 - n, 4))]))
        assert quality.estimate_prior(r.normal(3, 1, (1500, 4)), unlabelled) == pytest.approx(prior, abs=0.06)
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    known = np.mean([r.quality for r in labels.collect()])
    model = quality.train(docs, labels)
    assert model.prior == pytest.approx(known, abs=0.08)
    only_ones = quality.train(docs, labels.filter("quality = 1"))
    assert only_ones.prior == model.prior and np.array_equal(only_ones.weights, model.weights)


def test_samples_are_bounded_and_the_same_each_time(spark):
    from strataframe.llm.learning import sample

    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one, two = (sorted(r.doc_id for r in sample(x, 500, 3).collect()) for x in (rows, rows.repartition(7).orderBy("doc_id")))
    assert one == two and len(one) == 500 and len(sample(rows.limit(30), 500).collect()) == 30


def test_a_link_sees_earlier_probabilities_of_models_that_did_not_see_the_row(monkeypatch):
    r = np.random.default_rng(6)
    x = (r.random((60, 4)) < 0.5).astype(float)
    y, folds = (r.random((60, 2)) < 0.5).astype(int), np.arange(60) % toxicity.INNER
    fitted, real = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda a, b: fitted.append(a) or real(a, b))
    toxicity.fit_chain([b"a", b"b", b"c", b"d"], x, y, ["one", "two"], folds)
    second = next(a for a in fitted if a.shape == (60, 5))
    for f in range(toxicity.INNER):
        w = real(x[folds != f], y[folds != f, 0])
        assert second[folds == f, 4] == pytest.approx(toxicity.probability(x[folds == f], w))


def test_held_out_toxicity_labels_are_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(encode(cast(doc_id as string), 'UTF-8')) % 3 = 1, 1 - toxic, toxic) as toxic")
    a, b = toxicity.train(docs, labels), toxicity.train(docs, turned)
    assert a.words == b.words and a.thresholds == b.thresholds and all(np.array_equal(x[1], y[1]) for x, y in zip(a.links, b.links))


def test_the_risk_never_goes_below_zero_for_long():
    r = np.random.default_rng(0)
    good, bad = r.normal(2, 1, (400, 2)), r.normal(-2, 1, (100, 2))
    model = quality.fit_nnpu(good[:200], np.vstack([good[200:], bad]), 2 / 3)
    assert (model.score(good) > 0.5).mean() > 0.95 and (model.score(bad) < 0.5).mean() > 0.95


def test_later_links_use_earlier_ones():
    r = np.random.default_rng(1)
    x = (r.random((600, 3)) < 0.4).astype(float)
    first = (x[:, 0] + x[:, 1] > 1).astype(int)  # no linear model of the words alone says the second label as well
    y = np.stack([first, first], 1)
    chain = toxicity.fit_chain([b"a", b"b", b"c"], x, y, ["one", "two"], np.arange(600) % 5)
    assert len(chain.links[1][1]) == len(chain.links[0][1]) + 1 and chain.links[1][1][3] > 1
    p = chain.predict([[0, 1], [2]])
    assert p.shape == (2, 2) and p[0, 1] > 0.5 > p[1, 1]


@pytest.mark.parametrize("labels", [[], [(1, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1)]])
def test_odd_labels_and_texts(spark, labels):
    docs = frame(spark, [(1, None, "a"), (2, "", "a"), (3, prose(1, 50), None), (None, "x", "a"), (3, prose(1, 50), None)])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.scores(docs, quality.train(docs, table)).count() == 5
    assert toxicity.probabilities(docs, toxicity.train(docs, table)).count() == 5
    assert quality.keep_good(docs, table).columns == docs.columns
    empty = frame(spark, [])
    assert quality.scores(empty, quality.train(empty, table)).count() == 0 == toxicity.probabilities(empty, toxicity.train(empty, table)).count()


def test_a_repeated_id_takes_one_place_in_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "estimate_prior", lambda p, u: 0.5)
    monkeypatch.setattr(quality, "fit_nnpu", lambda p, u, prior: seen.append((len(p), len(u))))
    docs = [(5, f"{prose(5, 20)} {i}", "a") for i in range(60)] + [(i, prose(i, 20), "a") for i in range(100, 120)]
    labels = spark.createDataFrame([(i, 1) for i in (5, *range(100, 110))], "doc_id long, quality int")
    quality.train(frame(spark, docs), labels, max_unlabelled=21)
    assert seen[0][1] == 21 and seen[0][0] <= 11


def test_a_repeated_id_is_one_labelled_row(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(toxicity, "fit_chain", lambda words, x, y, *rest: fitted.append((x.shape, words)))
    docs = [(5, f"{prose(5, 20)} {i}", "a") for i in range(3000)] + [(i, f"{prose(i, 20)} rare", "a") for i in range(100, 104)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in (5, *range(100, 120))], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(toxicity, "FEW", 10_000)  # every word that may be chosen is
    for least, has in ((1, True), (5, False)):
        toxicity.train(frame(spark, docs), labels, max_labelled=20, least_rows=least, n_words=10_000)
        assert fitted[-1][0][0] <= 5 and (b"rare" in fitted[-1][1]) == has
