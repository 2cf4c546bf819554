"""Groups of similar texts against Jaccard similarities of their sets of five-word shingles."""

import random

import numpy as np
import pytest

from strataframe.llm import similar
from strataframe.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else {()}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def prose(r, n):
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def edited(r, words, share):
    """Other words at random places, a shingle's worth apart on average."""
    return [f"x{r.randrange(10**6)}" if r.random() < share else w for w in words]


def groups(spark, docs, **kw):
    return {r.doc_id: r.component for r in similar.similar_groups(spark.createDataFrame(docs, SCHEMA), **kw).collect()}


def test_recall_and_precision(spark):
    r = random.Random(5)
    docs, pairs = [], []
    for k in range(400):
        base = prose(r, r.choice((60, 300, 1500)))
        other = edited(r, base, r.choice((0.01, 0.02, 0.025, 0.06, 0.1)))
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
        pairs.append((2 * k, jaccard(docs[-2][1], docs[-1][1])))
    got = groups(spark, docs)
    near = [got[d] == got[d + 1] for d, j in pairs if j >= 0.8]
    far = [got[d] == got[d + 1] for d, j in pairs if j < 0.6]
    assert len(near) > 100 and sum(near) >= 0.95 * len(near)
    assert len(far) > 80 and sum(far) <= 0.05 * len(far)
    # nothing else comes together
    assert all(len({d // 2 for d in got if got[d] == c}) == 1 for c in set(got.values()))


@pytest.mark.parametrize("chunk", [2048, 64])
def test_large_groups(spark, chunk, monkeypatch):
    monkeypatch.setattr(similar.similar_links, "__defaults__", (similar.RADIUS, chunk))
    r = random.Random(6)
    one, two = prose(r, 200), prose(r, 200)
    docs = [(d, " ".join(edited(r, (one, two)[d % 2], 0.01))) for d in range(1200)]
    got = groups(spark, docs)
    for parity in (0, 1):
        own = [got[d] for d in got if d % 2 == parity]
        most = max(own.count(c) for c in set(own))
        assert most >= 0.99 * len(own)
    assert not {got[d] for d in got if d % 2} & {got[d] for d in got if not d % 2}


def test_odd_rows(spark):
    same = "one two three four five six"
    docs = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One\ttwo"), (6, same), (6, same), (None, same.upper()), (7, "two one")]
    got = groups(spark, docs)
    assert got[1] == got[2] == got[3] and got[4] == got[5] and got[6] == got[None] and len({got[1], got[4], got[6], got[7]}) == 4
    kept = similar.near_dedup(spark.createDataFrame([(*d, "z", "k") for d in docs], SCHEMA + ", component string, fp string"))
    assert kept.columns == ["doc_id", "text", "component", "fp"]
    assert sorted(x.doc_id for x in kept.collect()) == [1, 4, 6, 7]
    assert similar.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_slices_of_long_texts(monkeypatch):
    words = [w.encode() for w in prose(random.Random(8), 3000)] * 2
    whole = similar.sketch(b" ".join(words))
    monkeypatch.setattr(similar, "SLICE", 700)
    cut = similar.sketch(b" ".join(words))
    assert whole[0] == cut[0] and (whole[1] == cut[1]).all()


def test_links_lead_to_components(spark):
    text = " ".join(prose(random.Random(9), 100))
    nodes = similar.sketches(spark.createDataFrame([(1, text), (2, text + " more"), (3, "else")], SCHEMA)).selectExpr("doc_id AS node", "fp", "bands")
    assert {(x.node, x.component) for x in connected_components(similar.similar_links(nodes)).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("chunk, cell", [(2048, 4096), (50, 4096), (50, 7), (1, 1)])
def test_a_large_band_keeps_every_link(spark, chunk, cell, monkeypatch):
    """Many texts that share one band alone: one large group, pairs, chains and single ones, against all pairs."""
    monkeypatch.setattr(similar, "CELL", cell)
    monkeypatch.setattr(similar, "PILOTS", 4)
    r = random.Random(10)
    flipped = lambda fp, n: fp ^ sum(1 << k for k in r.sample(range(512), n))
    prints = [r.getrandbits(512)]
    prints += [flipped(prints[0], 30) for _ in range(60 if cell > 1 else 10)]
    for n in (88, 89) * (20 if cell > 1 else 3):  # pairs at the radius and beyond, chains of two links
        one = r.getrandbits(512)
        prints += [one, flipped(one, n), flipped(flipped(one, 88), 60)]
    prints += [flipped(prints[0], 110) for _ in range(10)]  # links to some of the large group only
    bands = [[7 if k % 3 else 8] + [100 + k, 10000 + k] for k in range(len(prints))]
    rows = [(k, bytearray(fp.to_bytes(64, "little")), b) for k, (fp, b) in enumerate(zip(prints, bands))]
    nodes = spark.createDataFrame(rows, "node long, fp binary, bands array<long>")
    got = {x.node: x.component for x in connected_components(similar.similar_links(nodes, chunk=chunk)).collect()}
    want = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bands[a][0] == bands[b][0] and (prints[a] ^ prints[b]).bit_count() <= similar.RADIUS and want[a] != want[b]:
                low, high = sorted((want[a], want[b]))
                want = [low if w == high else w for w in want]
    assert [got.get(k, k) for k in range(len(prints))] == want
    assert len(set(want)) < len(want) - 40 * (cell > 1)


def grouped(docs):
    """The least id of each text's group, where all pairs of similarity 0.8 link."""
    sets, group = {d: shingles(t) for d, t in docs}, {d: d for d, _ in docs}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 5 * len(x & y) >= 4 * len(x | y) and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


@pytest.mark.parametrize("few, sampled", [(256, 64), (3, 1)])
def test_all_pairs_are_found_without_bands(spark, few, sampled, monkeypatch):
    """Sizes of one shingle to a hundred, pairs on either side of 0.8 and at it, and a passage that half of the texts hold."""
    monkeypatch.setattr(similar, "FEW", few)
    monkeypatch.setattr(similar, "SAMPLED", sampled)
    monkeypatch.setattr(similar, "similar_links", lambda nodes, radius: spark.createDataFrame([], "a long, b long"))
    r = random.Random(11)
    common, texts = prose(r, 30), [None, "", "a b c", "a b c d"]
    for k in range(60):
        base = prose(r, r.choice((3, 5, 8, 9, 13, 40, 100))) + common * (k % 2)
        texts += [" ".join(base), " ".join(base + ["more"]), " ".join(edited(r, base, r.choice((0.02, 0.05)))), " ".join(base[: len(base) * 4 // 5]), " ".join(base).upper()]
    docs = list(enumerate(texts))
    got = groups(spark, docs)
    least = {}
    for d in sorted(got):
        least.setdefault(got[d], d)
    want = grouped(docs)
    assert {d: least[c] for d, c in got.items()} == want and 60 < len(set(want.values())) < 250


def test_pairs_that_bands_or_fingerprints_miss(spark):
    r, docs = random.Random(12), []
    while len(docs) < 8:
        base = prose(r, 120)
        other = edited(r, base, 0.022)
        one, two = (" ".join(x) for x in (base, other))
        if jaccard(one, two) >= 0.8:
            (fp, bands), (fp2, bands2) = (similar.sketch(x.encode()) for x in (one, two))
            apart = (int.from_bytes(fp, "little") ^ int.from_bytes(fp2, "little")).bit_count()
            if apart > similar.RADIUS or not set(bands.tolist()) & set(bands2.tolist()):
                docs += [(len(docs), one), (len(docs) + 1, two)]
    got = groups(spark, docs)
    assert all(got[d] == got[d + 1] for d in range(0, 8, 2)) and len(set(got.values())) == 4
    assert [x.doc_id for x in similar.near_dedup(spark.createDataFrame(docs, SCHEMA)).orderBy("doc_id").collect()] == [0, 2, 4, 6]


def test_parities_never_say_too_much():
    draw = np.random.default_rng(13)
    for n in (4, 100, 255, 256, 900, 5000):
        one = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        for gone, more in ((0, 0), (n // 10, n // 9), (n // 2, 0), (0, 3 * n), (n, n)):
            two = np.unique(np.concatenate((one[gone:], draw.integers(0, 1 << 63, more, dtype=np.uint64))))
            apart = len(np.setxor1d(one, two))
            assert similar.bits_apart(similar.parities(one), similar.parities(two)) <= apart
            assert gone < n or similar.bits_apart(similar.parities(two), similar.parities(one)) > apart / 9
