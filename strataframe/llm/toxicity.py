"""Toxicity by a classifier chain.

The label columns are the links of the chain, in order; each link is a linear model over
the presence of words and of beginnings of words, and over the probabilities of the links before it. These inputs are
out-of-fold while a link is fitted: a row's earlier probabilities come from models that didn't see it, so a later
link learns how far to trust them. Words are chosen by how much oftener the labelled rows of
a category have them. Fitting takes a bounded sample of labelled rows; word counts over it are
aggregated on the cluster and only the chosen words' presence comes to the driver. Scoring is a narrow map.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import table, utf8
from strataframe.llm.decontam import words_of
from strataframe.llm.learning import held_out, sample

#: Labelled rows that are fitted on, words of a category, and inner folds.
MAX_LABELLED, WORDS, INNER = 20_000, 256, 5
#: Sampled rows that must have a word before it can be chosen: what fewer have says little of others.
LEAST_ROWS = 5
#: Standard deviations from which a word is told from chance among very many; where none is, the first few are taken.
CLEAR, FEW = 4.0, 16
#: Lengths in bytes of the beginnings of longer words that are looked at besides whole words: insults come in compounds and with endings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: The chain: name and the label column with its value that means yes.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Weights, the bias last, by Newton steps on the penalised likelihood."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (s * (1 - s))[:, None]).T @ x + np.diag(penalty), x.T @ (y - s) - penalty * w)
        step *= min(1.0, 10 / (np.abs(step).max() + 1e-12))
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def signs(text: bytes) -> set[bytes]:
    """What a link may look at in a text: its words, and the beginnings of longer ones, marked."""
    words = set(words_of(text))
    return words | {b"\0" + w[:k] for w in words for k in BEGINNINGS if len(w) > k}


class Chain:
    def __init__(self, words: list[bytes], links: list[tuple[str, np.ndarray]], thresholds: list[float]):
        self.words = {w: i for i, w in enumerate(words)}
        self.links, self.thresholds = links, thresholds

    def present(self, text: bytes) -> list[int]:
        own = self.words
        return [own[w] for w in own.keys() & signs(text)]

    def predict(self, present: list[list[int]]) -> np.ndarray:
        x = np.zeros((len(present), len(self.words)))
        for i, p in enumerate(present):
            x[i, p] = 1
        for _, w in self.links:
            x = np.hstack([x, probability(x, w)[:, None]])
        return x[:, len(self.words) :]


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from which calling a row yes has the best F-score on these out-of-fold predictions, precision
    weighing twice as much as recall (beta 1/2); 0.5 without any yes."""
    if not (y == 1).any():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order] == 1)
    f = 1.25 * hits / (np.arange(1, len(p) + 1) + 0.25 * (y == 1).sum())
    k = int(np.argmax(f))
    return float((p[order[k]] + p[order[min(k + 1, len(p) - 1)]]) / 2)


def fit_chain(words: list[bytes], x: np.ndarray, y: np.ndarray, names: list[str], folds: np.ndarray, own: list[np.ndarray] | None = None) -> Chain:
    """y: a column for each link; -1 where a row has no such label. own: which of the words each link looks at (all)."""
    links, thresholds = [], []
    for k, name in enumerate(names):
        known = y[:, k] >= 0
        used = np.ones(x.shape[1] + 1, bool)
        if own is not None:
            used[: len(words)] = own[k]

        def fit(rows, used=used, k=k):
            w = np.zeros(len(used))
            w[used] = fit_logistic(x[np.ix_(rows, used[:-1])], y[rows, k])
            return w

        w = fit(np.flatnonzero(known))
        outside = probability(x, w)
        for f in range(INNER):
            inner = np.flatnonzero(known & (folds != f))
            if len(inner) and (folds == f).any():
                outside[folds == f] = probability(x[folds == f], fit(inner))
        links.append((name, w))
        thresholds.append(best_threshold(outside[known], y[known, k]))
        x = np.hstack([x, outside[:, None]])
    return Chain(words, links, thresholds)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN, max_labelled: int = MAX_LABELLED, n_words: int = WORDS, least_rows: int = LEAST_ROWS) -> Chain | None:
    """None where the training fold has no labelled row. Of several labels of a doc_id the largest counts; of rows that repeat
    an id, the text of least hash. Only words of ``least_rows`` sampled rows or more can be chosen."""
    value = [F.max((F.col(c) == v).cast("int")).alias(name) for name, c, v in chain]
    names = [name for name, _, _ in chain]
    seen = labels.filter(labels["doc_id"].isNotNull() & ~held_out(labels["doc_id"])).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*value)
    # bounded by max_labelled, so it is broadcast
    chosen = F.broadcast(sample(seen, max_labelled))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs).alias("text")).join(chosen, "doc_id")
    # of an id one row, that whose text has the least hash, so the bound on ids is one on rows
    texts = texts.groupBy("doc_id", *names).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    # of equal texts one: many copies of a single text would make its every word look telling
    texts = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.min_by(F.struct("doc_id", "text", *names), "doc_id").alias("r")).select("r.*")

    def distinct_words(batches):
        for b in batches:
            sets = [sorted(signs(t)) for t in b.column("text").to_pylist()]
            arrays = [pa.array(sets, pa.list_(pa.binary()))] + [b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(arrays, names=["words", *names])

    types = ", ".join(f"{n} int" for n in names)
    spread = texts.select("text", *names).mapInArrow(distinct_words, f"words array<binary>, {types}").select(F.explode("words").alias("w"), *names)
    counts = spread.groupBy("w").agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).filter(F.col("n") >= least_rows)
    totals = seen.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(n), F.lit(0)) for n in names]).first()
    if not totals[0]:
        return None
    counts = counts.persist()
    chosen_words: list[set[bytes]] = []
    for k, n in enumerate(names):
        rate = totals[k + 1] / totals[0]
        # how far the word's share of yes is from the common one, in standard deviations
        z = (F.col(n) - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate) + 1.0)
        best = counts.select("w", F.abs(z).alias("z")).orderBy(F.desc("z"), "w").limit(n_words).collect()
        clear = [r for r in best if r.z >= CLEAR]
        chosen_words.append({bytes(r.w) for r in clear or best[:FEW]})
    counts.unpersist()
    words = sorted(set().union(*chosen_words))
    known = {w: i for i, w in enumerate(words)}

    def presence(batches):
        for b in batches:
            x = [[known[w] for w in known.keys() & signs(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.int32()))] + [b.column(n) for n in names], names=["doc_id", "x", *names])

    rows = texts.select("doc_id", "text", *names).mapInArrow(presence, f"doc_id long, x array<int>, {types}").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    if not rows:
        return None
    x, y = np.zeros((len(rows), len(words))), np.array([[-1 if r[n] is None else r[n] for n in names] for r in rows])
    for i, r in enumerate(rows):
        x[i, r.x] = 1
    own = [np.array([w in c for w in words], bool) for c in chosen_words]
    return fit_chain(words, x, y, names, np.arange(len(rows)) % INNER, own)


def probabilities(docs: DataFrame, model: Chain | None, chain=CHAIN) -> DataFrame:
    """doc_id and p_<name> of each link, for each row; null without a model."""
    names = [f"p_{name}" for name, _, _ in chain]

    def run(batches):
        for b in batches:
            p = model.predict([model.present(t) for t in b.column("text").to_pylist()]) if model is not None else np.full((b.num_rows, len(names)), np.nan)
            yield pa.RecordBatch.from_arrays([b.column("doc_id")] + [pa.array(p[:, k], pa.float64(), from_pandas=True) for k in range(len(names))], names=["doc_id", *names])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs).alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, p_low_quality, score, toxic (score at or above the threshold).

    Null and empty texts are scored as having no words; rows that repeat, and equal texts, score alike; a tie with the
    threshold counts as toxic. No labels: score null, toxic false. No rows: no rows. Other columns are left out.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    least = model.thresholds[-1] if model is not None else 0.5
    found = probabilities(docs, model)
    return found.select("doc_id", "p_low_quality", F.col("p_toxic").alias("score"), F.coalesce(F.col("p_toxic") >= least, F.lit(False)).alias("toxic"))
