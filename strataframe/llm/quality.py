"""Quality classifier by positive-unlabelled learning.

Trusted positives are rows that are labelled 1, the unlabelled set is plain web text of any kind, and a
linear model minimises the non-negative unbiased risk (Kiryo et al., 2017)

    prior * E_P[loss(+)] + max(0, E_U[loss(-)] - prior * E_P[loss(-)]),

stepping back on the second term where it falls below zero. The class prior is estimated from the trusted positives and
the unlabelled rows alone: a set of texts that only positives fall into holds a share of the unlabelled rows that is the prior times its
share of the positives, so the prior is the least ratio of these shares over the sets that a classifier
of positives against unlabelled rows cuts off (Scott, 2015). Labels 0 are not used. Features are shares and ratios over the whole text: character
classes, single punctuation marks, repetition of words and word pairs. Fitting takes bounded samples by
hash of the id (documented parameters); scoring is a narrow map over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import table, utf8
from strataframe.llm.learning import held_out, sample

#: Rows that are fitted on, at most: trusted positives and unlabelled.
MAX_POSITIVES, MAX_UNLABELLED = 6000, 12000
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def features(text: bytes) -> np.ndarray:
    """Of one text; all zero but for the first without characters."""
    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256) / n
    words = text.split()
    k = max(1, len(words))
    pairs = max(1, len(words) - 1)
    upper, lower = c[65:91].sum(), c[97:123].sum()
    lines = text.split(b"\n")
    dense = [
        upper, lower, c[48:58].sum(), c[128:].sum(), c[9:14].sum(), c[32], c[:9].sum() + c[14:32].sum(), upper / max(upper + lower, 1e-9),
        c[list(PUNCTUATION)].sum(),
    ]
    shape = [
        len(set(words)) / k,
        len(set(zip(words, words[1:]))) / pairs,
        len(set(lines)) / len(lines),
        min(1.0, len(text) / k / 20),
        np.log1p(len(words)) / 10,
        len(set(words)) / k * np.log1p(len(words)) / 10,
    ]
    return np.concatenate([np.sqrt(dense), np.sqrt(c[list(PUNCTUATION)]), shape]).astype(np.float32)


class Model:
    def __init__(self, mean, scale, weights, bias, prior):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> Model:
    """Full-batch Adam on the non-negative risk with the logistic loss."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    w = np.zeros(p.shape[1] + 1)
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        _, gain, negative, part = pu_risk(w, p, u, prior)
        g = (gain + part if negative >= 0 else -part) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, w[:-1], w[-1], prior)


def pu_risk(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, np.ndarray, float, np.ndarray]:
    """Of a linear model on rows with a column of ones: prior * E_P[loss(+)] and its gradient, then
    E_U[loss(-)] - prior * E_P[loss(-)] and its gradient. The loss is logistic."""
    zp, zu = p @ w, u @ w
    sp, su = (1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (zp, zu))
    # log(1 + exp(-z)) of calling a row positive, log(1 + exp(z)) of calling it negative
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    return positive, prior * p.T @ (sp - 1) / len(p), negative, u.T @ su / len(u) - prior * p.T @ sp / len(p)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.2) -> float:
    """Share of positives among the unlabelled rows, from features of both sets alone.

    Half of each set fits a classifier of one against the other, the other half is scored. ``least_share``:
    of the positives that a set must hold. The least of many ratios is too small by chance, so the set is chosen by what its ratio
    may be at most, by one standard error of the two shares.
    """
    (p1, p2), (u1, u2) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    if not len(p2) or not len(u2):
        return 0.5
    model = fit_nnpu(p1, u1, 0.5, rounds=600)
    sp, su = np.sort(model.score(p2)), np.sort(model.score(u2))
    cuts = sp[: max(1, int(len(sp) * (1 - least_share)))]
    held_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    held_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    error = lambda share, n: np.sqrt(share * (1 - share) / n)
    most = (held_u + error(held_u, len(su))) / np.maximum(held_p - error(held_p, len(sp)), 1e-9)
    k = int(np.argmin(most))
    return float(np.clip(held_u[k] / held_p[k], 0.01, 0.99))


def train(docs: DataFrame, labels: DataFrame, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """None where no row of the training fold is labelled 1. Labels of a doc_id that disagree count as 0.

    Null ids and labels are left out, null texts count as empty. Of rows that repeat an id, the text of least hash counts.
    """
    seen = labels.filter(labels["doc_id"].isNotNull() & labels["quality"].isNotNull() & ~held_out(labels["doc_id"]))
    seen = seen.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs).alias("text"))
    ids = texts.select("doc_id").filter("doc_id is not null").distinct()
    # both samples are bounded by their parameters, so their ids are broadcast
    trusted = sample(seen.filter("quality = 1").select("doc_id"), max_positives, 1).withColumn("set", F.lit(1))
    plain = sample(ids, max_unlabelled, 2).withColumn("set", F.lit(0))

    def run(batches):
        for b in batches:
            x = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("set"), pa.array(x, pa.list_(pa.float32()))], names=["doc_id", "set", "x"])

    # one row an id and set: where an id repeats, the one whose text has the least hash
    own = texts.join(F.broadcast(trusted.unionByName(plain)), "doc_id").withColumn("hash", F.xxhash64("text"))
    least = own.groupBy("doc_id", "set").agg(F.min_by("text", "hash").alias("text"))
    rows = sorted(least.select("doc_id", "set", "text").mapInArrow(run, "doc_id long, set int, x array<float>").collect(), key=lambda r: r.doc_id)
    p, u = (np.array([r.x for r in rows if r.set == k], np.float64) for k in (1, 0))
    return fit_nnpu(p, u, estimate_prior(p, u)) if len(p) and len(u) else None


def scores(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score of each row; without a model 0.5."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            s = model.score(np.array([features(t) for t in texts])) if model is not None and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows that score ``least`` or more, with all their columns; a narrow filter.

    Null and empty texts are judged as empty, rows that repeat each alike. Without a model (no row of the training fold
    is labelled 1) all stay. No rows: no rows. Columns of any name ride along.
    """
    model = train(docs, labels)

    def run(batches):
        for b in batches:
            texts = b.column(b.schema.get_field_index("text")).to_pylist()
            if model is None or not texts:
                yield b
            else:
                yield b.filter(pa.array(model.score(np.array([features((t or "").encode()) for t in texts])) >= least))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored as empty; a null doc_id is scored like any other. No rows: no rows."""
    docs = table(spark, sf_dir, "documents")
    scored = scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
