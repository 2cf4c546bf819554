import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from strataframe.llm import decontam, exact, lines, mixing, secrets, similar, simhash, substrings, suffixes
from tests.llm import brute
from tests.llm.cases import documents, frame, prose

BLANK = re.compile(r"[\x20\x09-\x0D]+")
sha = lambda b: hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()
words = lambda t: [w for w in BLANK.split(t or "") if w]
small = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
by_id = lambda d: (d is not None, d or 0)  # noqa: E731  null is smaller than any id


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


OPS = {
    "op1": secrets.op1_secrets, "op2": simhash.op2_simhash, "op3": lines.op3_lines, "op4": substrings.op4_substrings,
    "op6": mixing.op6_mixing, "op7": suffixes.op7_suffixes, "op10": exact.op10_exact,
}


@pytest.mark.parametrize("name", OPS)
def test_no_rows_give_no_rows(spark, name):
    assert OPS[name](frame(spark, [])).count() == 0


def test_secrets(spark):
    want = sorted(((d, *brute.secrets(t)) for d, t, _ in documents()), key=str)
    assert rows(secrets.op1_secrets(frame(spark)).drop("spans")) == want
    assert any(w[1] for w in want) and any(w[2] for w in want) and any(w[3] for w in want)


def test_secrets_with_checksums(spark):
    body = "abcdefghijklmnopqrstuvwxyz0123"
    good, bad = f"ghp_{body}{secrets.base62_crc(body)}", f"ghp_{body}000000"
    got = secrets.op1_secrets(frame(spark, [(1, f"x {good} y", "a"), (2, bad, "a")])).orderBy("doc_id").collect()
    assert [r.spans for r in got] == [f"github:2:{2 + len(good)}", ""] and got[0].base_sha256 == sha("")


def simhash_by_hand(text):
    w = words(small(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in root:
        for q in root:
            if (p ^ q).bit_count() <= 3:
                root[find(p)] = find(q)
    return {p: find(p) for p in root}


def near_copies(n):
    base = prose(50, 120).split(" ")
    out = []
    for i in range(n):
        w = list(base)
        w[i % len(w)] = f"edit{i // 3}"
        out.append((1000 + i, " ".join(w), "a"))
    return out


@pytest.mark.parametrize("chunk", [2048, 3])
def test_simhash_groups(spark, chunk, monkeypatch):
    monkeypatch.setattr(simhash.near_links, "__defaults__", (3, chunk))
    docs = documents() + near_copies(60)
    prints = [simhash_by_hand(t) for _, t, _ in docs]
    group = components_by_hand(set(prints))
    least = defaultdict(list)
    for (d, _, _), p in zip(docs, prints):
        if d is not None:
            least[group[p]].append(d)
    want = [(d, f"{p:016x}", min(least[group[p]], default=None)) for (d, _, _), p in zip(docs, prints)]
    assert rows(simhash.op2_simhash(frame(spark, docs))) == sorted(want, key=str)
    assert max(map(len, least.values())) > 5


@pytest.mark.parametrize("chunk", [2048, 8])
def test_links_are_all_found(spark, chunk):
    import random

    r = random.Random(7)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(300):
        x = r.getrandbits(64)
        values.add(x)
        for _ in range(3):
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            values.add(x)
    # very many that share one key: they differ in 20 neighbouring bits alone
    values |= {(0x1234567890ABCDEF >> 20 << 20) | r.getrandbits(20) for _ in range(150)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    from strataframe.llm.components import connected_components

    got = {r.node % (1 << 64): r.component for r in connected_components(simhash.near_links(spark.createDataFrame(signed, "fp long"), chunk=chunk)).collect()}
    want = components_by_hand(values)
    sizes = Counter(want.values())
    assert set(got) == {v for v in values if sizes[want[v]] > 1}
    assert len({(want[v], got[v]) for v in got}) == len(set(got.values())) == len({want[v] for v in got})


def test_lines(spark):
    docs = documents()
    key = lambda x: small(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t, _ in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(d)
    want = []
    for d, t, _ in docs:
        own = (t or "").split("\n")
        kept = [x for x in own if len(holders[key(x)]) < 3 or max(holders[key(x)], key=by_id) == d]
        want.append((d, len(own), len(own) - len(kept), sha("\n".join(kept))))
    assert rows(lines.op3_lines(frame(spark))) == sorted(want, key=str)
    assert sum(w[2] for w in want) > 4


def test_a_hot_line_over_many_partitions(spark):
    line = "the very same line in each of all these documents"
    docs = [(i, f"{line}\n{i} only here in this one document, alone\n{line}", "a") for i in range(300)]
    got = lines.op3_lines(frame(spark, docs)).collect()
    assert {r.doc_id: r.n_dropped for r in got} == {i: 0 if i == 299 else 2 for i in range(300)}
    bits = lines.keep_bitmaps(frame(spark, docs)).filter("doc_id = 5").first()
    assert lines.kept_mask(bits.n_bits, bits.keep_bits).tolist() == [False, True, False]


def substrings_by_hand(docs):
    first = {}
    for d, t, _ in docs:
        w = words(t)
        for i in range(len(w) - 49):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d, key=by_id)
    out = []
    for d, t, _ in docs:
        w = words(t)
        keep = [True] * len(w)
        for i in range(len(w) - 49):
            if by_id(first[tuple(w[i : i + 50])]) < by_id(d):
                keep[i : i + 50] = [False] * 50
        kept = [x for x, k in zip(w, keep) if k]
        out.append((d, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [256, 1])
def test_substrings(spark, shard, monkeypatch):
    monkeypatch.setattr(substrings.duplicate_spans, "__defaults__", (50, 16, shard))
    docs = documents() + [(100 + i, f"{prose(60 + i, 30)} {prose(1, 90 - i)} {prose(70 + i, 30)} {prose(1, 90)[i:]}", "a") for i in range(8)]
    want = substrings_by_hand(docs)
    assert rows(substrings.op4_substrings(frame(spark, docs))) == want
    assert sum(0 < w[2] < w[1] for w in want) > 6


def test_suffix_automaton():
    a = substrings.SuffixAutomaton()
    taken = ["abcabxabcd", "bcdab", "xx"]
    for t in taken:
        a.add(t)
    probe = "zabcabcdabxxab"
    longest = lambda i: max(n for n in range(i + 2) if n == 0 or any(probe[i + 1 - n : i + 1] in t for t in taken))
    assert a.statistics(probe) == [longest(i) for i in range(len(probe))]


def suffixes_by_hand(docs):
    places = Counter(t.encode()[i : i + 400] for _, t, _ in docs if t for i in range(len(t.encode()) - 399))
    out = []
    for d, t, _ in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 399):
            if places[b[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [256, 1])
def test_suffixes(spark, shard, monkeypatch):
    monkeypatch.setattr(suffixes.repeated_spans, "__defaults__", (400, 128, 100, shard))
    docs = documents() + [(100 + i, f"{prose(60 + i, 30)} {prose(1, 90 - i)} {prose(70 + i, 30)} {prose(1, 90)[i:]}", "a") for i in range(8)]
    docs += [(200, "x" * 399, "a"), (201, "y" * 400, "a"), (202, "z" * 401, "a"), (203, "abcdefg" * 150, "a")]
    want = suffixes_by_hand(docs)
    assert rows(suffixes.op7_suffixes(frame(spark, docs))) == want
    assert sum(0 < w[2] < w[1] for w in want) > 6


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_texts_on_which_polynomials_collide_are_told_apart(spark):
    swap = str.maketrans("ab", "ba")
    start, word = words(prose(1, 49)), thue_morse(1024)
    docs = [(i, " ".join([*start[:25], w, *start[25:]]), "a") for i, w in enumerate((word, word.translate(swap)))]
    assert [r.n_removed for r in substrings.op4_substrings(frame(spark, docs)).collect()] == [0, 0]
    docs = [(i, "".join(chr(k % 26 + 97) + w for k in range(3)), "a") for i, w in enumerate((thue_morse(128), thue_morse(128).translate(swap)))]
    assert [r.n_removed for r in suffixes.op7_suffixes(frame(spark, docs)).collect()] == [0, 0]


def test_a_passage_of_very_many_documents_is_split(spark):
    """One passage in 300 documents, each time among other words: one anchor has 300 contexts."""
    passage = " ".join(words(prose(1, 70)))
    docs = [(i, f"{' '.join(words(prose(1000 + i, 9)))} {passage} {' '.join(words(prose(5000 + i, 9)))}", "a") for i in range(300)]
    want = substrings_by_hand(docs)
    assert rows(substrings.op4_substrings(frame(spark, docs))) == want and sum(w[2] >= 70 for w in want) == 299
    want = suffixes_by_hand(docs)
    assert rows(suffixes.op7_suffixes(frame(spark, docs))) == want and all(w[3] == 1 for w in want)


def test_scratch_tables_can_be_dropped(spark, tmp_path):
    import os

    from strataframe.llm import common

    mark = common.scratch_mark()
    scratch = common.Scratch(spark, "t")
    made = scratch.stored(spark.range(3), "a")
    scratch.stored(spark.range(3), "b")
    assert made.count() == 3 and os.path.isdir(scratch.path("a").removeprefix("file:"))
    scratch.drop("b")
    assert not os.path.isdir(scratch.path("b").removeprefix("file:"))
    common.drop_scratch(mark)
    assert not os.path.isdir(scratch.root.removeprefix("file:")) and common.scratch_mark() == mark


def test_merging_transforms_gives_the_intervals_of_a_sort():
    import numpy as np

    texts = [prose(i % 3, 40).encode()[: 300 - i] + prose(9, 20).encode() for i in range(7)]
    group = np.array([0, 0, 0, 1, 1, 2, 2])
    got = suffixes.repeated_windows(group, texts, 40, 10)
    places = Counter((g, t[i : i + 40]) for g, t in zip(group.tolist(), texts) for i in range(len(t) - 39))
    want = [(k, a, b) for k, t in enumerate(texts) for a, b in substrings.runs_of([places[group[k], t[i : i + 40]] > 1 for i in range(len(t) - 39)])]
    assert got == want and len(want) > 3


def test_mixing(spark):
    docs = documents()
    got = mixing.mix(frame(spark)).collect()
    size = Counter()
    for _, t, s in docs:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total = dict.fromkeys(order, 0.0), 1.5 * sum(size.values())
    while True:  # sharing anew what is above the caps
        free = [s for s in order if target[s] < 2 * size[s]]
        left = total - sum(target[s] for s in order if s not in free)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s]]
        if not over:
            target |= share
            break
        target |= {s: 2.0 * size[s] for s in over}
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, _ in docs)
    again = mixing.mix(frame(spark, docs[::-1]).repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_of_rows_that_repeat_very_often(spark):
    rows = [(7, "one two three", "a")] * 2600 + [(i, f"some words {i}", "a") for i in range(100, 140)] + [(None, "x y", "a")] * 1100 + [(1, "other " * 4000, "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    own = [r for r in got if r.source == "a"]
    budget, epochs = round(own[0].target), round(own[0].target) // own[0].source_size
    left, want = budget - epochs * own[0].source_size, Counter()
    name = lambda d, t: "text " + hashlib.sha256(t.encode()).hexdigest() if d is None else str(d)
    for d, t, _ in sorted((r for r in rows if r[2] == "a"), key=lambda r: hashlib.md5(f"0:{name(r[0], r[1])}".encode()).hexdigest()):
        size = len(words(t))
        extra = max(0, min(size, left))
        want[d, size, size * epochs + extra] += 1
        left -= size
    assert Counter((r.doc_id, r.size, r.taken) for r in own) == want and len({r.taken for r in own if r.doc_id == 7}) > 1
    plan = mixing.mix(frame(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rows_without_an_id_are_spread_over_ranges(spark):
    docs = frame(spark, [(None, f"text {i}", "a") for i in range(60)])
    assert mixing.sized(docs).select("mix_range").distinct().count() > 50
    got = mixing.mix(docs).collect()
    assert sum(r.taken for r in got) == 180 and all(r.taken in (2, 3, 4) for r in got)


def test_exact(spark):
    docs = documents()
    norm = [BLANK.sub(" ", t or "") for _, t, _ in docs]
    group = defaultdict(list)
    for (d, _, _), n in zip(docs, norm):
        group[n].append(d)
    seen, want = set(), []
    for (d, t, _), n in zip(docs, norm):
        ids = [x for x in group[n] if x is not None]
        keep = min(ids, default=None)
        want.append((d, keep, len(group[n]), d == keep and (d, n) not in seen, sha(n)))
        seen.add((d, n))
    assert rows(exact.op10_exact(frame(spark))) == sorted(want, key=str)
    kept = exact.exact_dedup(frame(spark))
    assert kept.columns == frame(spark).columns and kept.count() == len(group)


def test_digests_that_clash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit("00"))
    docs = [(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "b  b", "s"), (5, "b", "s")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.decisions(frame(spark, docs)).collect()}
    assert got == {1: (1, 2, True), 2: (1, 2, False), 3: (3, 2, True), 5: (3, 2, False), 4: (4, 1, True)}


def test_state_goes_on_with_later_files(spark, tmp_path):
    make = lambda part: spark.createDataFrame(part, "digest binary, doc_id long, locator long").coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    for part in ([(b"a", 5, 1), (b"b", 6, 1)], [(b"a", 3, 1), (b"a", 9, 1)]):
        make(part)
        stream = spark.readStream.schema("digest binary, doc_id long, locator long").parquet(str(tmp_path / "m"))
        state = exact.run_stream(spark, stream, str(tmp_path / "c"), str(tmp_path / "o"))
    assert {bytes(r.digest): (r.first.doc_id, r.group_size) for r in state.collect()} == {b"a": (3, 3), b"b": (6, 1)}


ITEMS = [(1, "Which of these words is the right one here\nThe second of them is right, as it says"), (2, "alone " * 3), (3, None), (4, ""), (5, prose(80, 30)), (5, prose(81, 200))]


def test_leaks(spark):
    item = {i: t for i, t in ITEMS}
    docs = documents() + [(300, f"{prose(90, 150)} {item[1].upper()} {prose(91, 150)}", "a"), (301, f"x, {item[1]}! {prose(92, 20)}", "a"), (302, item[1].split("\n")[0] + prose(93, 30), "a"), (303, ITEMS[4][1], "a"), (304, prose(94, 400) + " " + ITEMS[5][1], "a"), (None, item[1], "a")]
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, docs), benchmark).collect()}
    assert got == brute.leaks([(d, t) for d, t, _ in docs], ITEMS) and (300, 1) in got and (302, 1) not in got
    clean = decontam.decontaminate(frame(spark, docs), benchmark)
    assert clean.columns == frame(spark).columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _, _ in docs} - {300, 301, 303, 304}  # null stays: another row has it
    assert decontam.leaks(frame(spark, []), benchmark).count() == 0 == decontam.leaks(frame(spark), benchmark.limit(0)).count()


def test_index_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 2)
    docs = [(1, ITEMS[0][1], "a"), (2, ITEMS[4][1], "a"), (3, prose(99, 50), "a")]
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(frame(spark, docs), spark.createDataFrame(ITEMS, "item_id long, text string")).collect()}
    assert got == brute.leaks([(d, t) for d, t, _ in docs], ITEMS)


def test_wand_retrieves_all_above_the_threshold():
    items = [(i, prose(i, 12 + i % 20).encode()) for i in range(60)]
    df = Counter(w for _, t in items for w in set(decontam.words_of(t)))
    index = decontam.Index(items, 60, 20.0, df)
    query = sorted({index.terms[w] for i in (3, 17, 40) for w in decontam.words_of(items[i][1])})
    exactly = Counter()
    for t in query:
        for i, x in zip(index.items[t], index.impacts[t]):
            exactly[i] += x
    got = {i for b in range(15) for i, _ in index.retrieve(query, b, 0.5)}
    assert got == {i for i, s in exactly.items() if s >= 0.5 - 1e-9} >= {3, 17, 40}


def test_question_and_answer_far_apart_are_found(spark):
    question, answer = (" ".join(words(prose(k, n))) for k, n in ((80, 30), (81, 10)))
    items = [(1, f"{question}\n{answer}"), (2, prose(83, 12))]
    docs = [(1, f"{question} {prose(90, 900)} {answer}", "a"), (2, f"{answer} {prose(91, 900)} {question}", "a"), (3, f"{question} {prose(92, 900)}", "a")]
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == brute.leaks([(d, t) for d, t, _ in docs], items) == {(1, 1), (2, 1)}
    assert all((r.question_overlap, r.answer_overlap) == (1, 1) for r in got.values())


def test_scores_of_one_shard_and_of_several_are_the_same(spark, monkeypatch):
    plain = lambda k: " ".join(words(prose(k, 30)))
    items = [(i, f"{plain(200 + i)}\n{plain(300 + i)} PLAIN École") for i in range(6)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(i, t.removesuffix(" École"), "a") for i, t in items])
    get = lambda: {(r.doc_id, r.item_id): r.score for r in decontam.leaks(docs, benchmark).collect()}
    one = get()
    monkeypatch.setattr(decontam, "SHARD_ITEMS", 2)
    assert get() == pytest.approx(one, abs=1e-9) and {(i, i) for i, _ in items} <= set(one)


def test_very_long_texts_are_searched_whole(spark):
    """A million words, with items at both ends and where passages meet."""
    items = [(i, f"{' '.join(words(prose(400 + i, 25)))}\n{' '.join(words(prose(500 + i, 12)))}") for i in range(3)]
    filler = words(prose(700, 20_000)) * 50
    text = " ".join([items[0][1], *filler[:500_000], items[1][1], *filler[500_000:], items[2][1]])
    got = {r.item_id for r in decontam.leaks(frame(spark, [(1, text, "a"), (2, None, "a")]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {0, 1, 2}
    n = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.op4_substrings(frame(spark, [(1, text, "a"), (2, items[1][1] + " " + " ".join(filler[500_000:500_060]), "a")])).collect()}
    assert n == {1: (len(text.split()), 0), 2: (len(items[1][1].split()) + 60,) * 2}


def test_workers_need_no_installed_copy(tmp_path):
    """Driver and workers of a cluster: only the driver can import the package."""
    code = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {work!r}).getOrCreate()
from strataframe.llm import decontam
docs = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x")], "doc_id long, text string")
items = spark.createDataFrame([(7, "a b c d e\\nf g h i j")], "item_id long, text string")
def importable(batches):
    import importlib.util
    for b in batches:
        yield b.slice(0, 1 if importlib.util.find_spec("strataframe") else 0)
print("importable", docs.mapInArrow(importable, docs.schema).count())
print("found", [(r.doc_id, r.item_id) for r in decontam.leaks(docs, items).collect()], decontam.decontaminate(docs, items).count())
"""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code.format(root=root, work=str(tmp_path))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "importable 0" in out.stdout and "found [(1, 7)] 1" in out.stdout, out.stdout + out.stderr[-2000:]


def test_near_dedup_keeps_one_row_of_each_group(spark):
    base, other = prose(60, 300), prose(61, 300)
    docs = [(None, base, "a"), (None, base + "\n", "a"), (7, other, "a"), (7, other + "\n", "a"), (7, other, "a"), (8, other, "a"), (None, other, "a")]
    kept = similar.near_dedup(frame(spark, docs))
    assert kept.columns == frame(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["7", "None"]
    assert [r.doc_id for r in similar.near_dedup(frame(spark, [(None, base, "a"), (3, base, "a")])).collect()] == [3]


def test_block_maxima_are_held_by_posting():
    items = [(i, " ".join(f"word{i}x{k}" for k in range(40)).encode()) for i in range(200)]
    index = decontam.Index(items, 200, 40.0, Counter(w for _, t in items for w in decontam.words_of(t)))
    assert sum(x.nbytes for x in index.block_tops()) < 24 * sum(map(len, index.items)) + 64
    assert sorted(index.matches(b" ".join(t for _, t in items))) == list(range(200))


def test_a_text_goes_to_python_once(spark):
    """And not with each of its contexts, however many these are."""
    texts = spark.createDataFrame([(k, k + 100, bytearray(b"w " * 3000)) for k in range(3)], "doc_id long, row long, text binary")
    wanted = [(k, k + 100, n, n + 5, n, b"c%d" % n, 2, k, False) for k in (0, 2) for n in range(40)]
    wanted = spark.createDataFrame(wanted, "doc_id long, row long, first int, last int, anchor long, context binary, kinds long, last_id long, several boolean")
    got = substrings.passages_of(texts, wanted, lambda text, first, last: [b"%d of %d" % (f, len(first)) for f in first]).collect()
    assert sorted((x.doc_id, x.last_id, x.anchor, bytes(x.context), bytes(x.words)) for x in got) == sorted((k, k, n, b"c%d" % n, b"%d of 40" % n) for k in (0, 2) for n in range(40))


def test_pieces_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(substrings, "PIECE", 100)
    sizes = [0, 0, 60, 60, 10, 500, 0, 99, 1]
    texts = [bytes([k]) * n for k, n in enumerate(sizes)]
    made = [p.column("text").to_pylist() for p in substrings.pieces(substrings.pa.RecordBatch.from_pydict({"text": texts}))]
    assert [t for p in made for t in p] == texts
    assert all(sum(map(len, p)) <= 100 + max(map(len, p)) for p in made) and len(made) > 2
