"""Keyframes, as-of joins and edits by body, against plain loops over random cases."""

import random
from collections import Counter

import pytest

from strataframe.operators import changes, pairing
from strataframe.operators.asof import asof
from strataframe.operators.history import History
from strataframe.operators.keyframes import Keyframes
from tests.test_changes import document, frame, random_history, rows

STATE = ("term_id", "predicate", "value")


@pytest.mark.parametrize("every", [1, 3, 50])
def test_keyframes_answer_as_snapshots_do(spark, tmp_path, every):
    made = changes.build(frame(spark, [d if d is None else document(d) for d in random_history(5, 13)]))
    events, shots = made["events"].persist(), made["term_snapshots"].persist()
    h, root = History(events, None, shots), str(tmp_path / "k")
    Keyframes.of(events, every).write(root)
    k = Keyframes.open(spark, root, every)
    last = events.agg({"commit_seq": "max"}).first()[0]
    for seq in (0, 2, last // 2, last - 1, last):
        for strict in (False, True):
            assert rows(k.states_at(seq, strict=strict), *STATE) == rows(h.states_at(seq, strict=strict), *STATE), (seq, strict)
    assert rows(k.states_at(last, "X:2"), *STATE) == rows(h.states_at(last, "X:2"), *STATE)


def test_a_state_reads_one_frame_and_one_stretch(spark, tmp_path):
    events = spark.createDataFrame([(f"T:{t}", s, "s", "p", f"{s}", "add") for t in range(5) for s in range(30)], "term_id string, commit_seq int, sha string, predicate string, value string, operation string")
    Keyframes.of(events, 10).write(str(tmp_path))
    plan = Keyframes.open(spark, str(tmp_path), 10).states_at(14, "T:3")._jdf.queryExecution().executedPlan().toString()
    assert "(frame#" in plan and plan.count("PartitionFilters: [isnotnull(frame") >= 2 and "EqualTo(term_id,T:3)" in plan


def test_no_entities_go_through_the_driver(spark, tmp_path):
    """Of tables whose files are small, however many entities these hold."""
    spark.range(3000).selectExpr("concat('T:', id % 1000) AS term_id", "cast(id / 1000 AS int) AS commit_seq", "'s' AS sha", "'p' AS predicate", "string(id) AS value", "'add' AS operation").write.parquet(str(tmp_path / "e"))
    k = Keyframes.of(spark.read.parquet(str(tmp_path / "e")), 2)
    k.write(str(tmp_path))
    written = Keyframes.open(spark, str(tmp_path), 2)
    for df in (k.deltas, k.frames, written.states_at(1), written.states_at(1, "T:3", strict=True)):
        df.collect()
        assert "Join" in (plan := df._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan


@pytest.mark.parametrize("seed", range(3))
def test_asof_against_a_loop(spark, seed):
    r = random.Random(seed)
    key = lambda: "hot" if r.random() < 0.5 else r.choice(["a", "b", "", None])
    states = [(key(), None if r.random() < 0.05 else r.randrange(-5, 60), "s") for _ in range(40)]
    probes = [(key(), None if r.random() < 0.05 else r.randrange(-10, 70), r.randrange(3)) for _ in range(400)]
    got = asof(spark.createDataFrame(probes, "k string, at long, x int"), spark.createDataFrame(states, "k string, at long, x string"), "k", "at")
    best = lambda k, at: max((s for e, s, _ in states if e == k is not None and s is not None and s <= at), default=None) if at is not None else None
    assert rows(got, "k", "at", "x", "state_at") == sorted(((k, at, x, best(k, at)) for k, at, x in probes), key=str)
    assert asof(spark.createDataFrame([], "k string, at long"), spark.createDataFrame(states, "k string, at long, x string"), "k", "at").count() == 0


def test_one_entity_over_all_partitions(spark):
    """The only state is in the first partition; probes of the entity fill the others."""
    probes = spark.range(4000).selectExpr("'hot' as k", "id as at")
    states = spark.createDataFrame([("hot", 5), ("other", 9)], "k string, at long")
    got = asof(probes, states, "k", "at")
    assert got.filter("state_at = 5").count() == 3995 and got.filter("state_at is null").count() == 5


def test_edits_by_body(spark):
    r, given = random.Random(4), []
    for _ in range(300):
        q = sorted(r.sample(["a", "b", "c"], r.randrange(3)))
        block = " {" + ", ".join(f'{x}="{r.randrange(2)}"' for x in q) + "}" if q else ""
        given.append((f"T:{r.randrange(2)}", r.randrange(2), "xref", f"B:{r.randrange(3)}{block}" if r.random() < 0.95 else None, r.choice(["add", "remove"])))
    given += [("T:0", 0, "xref", 'B:0 {broken', "add"), ("T:9", 0, "xref", "B:1", "add")]
    want = {}
    for t, s, p, v, op in given:
        if v is None or v.endswith("broken"):
            continue
        body, _, rest = v.partition(" {")
        g = want.setdefault((t, s, p, body), [0, 0, Counter()])
        g[op == "add"] += 1
        for x in rest.rstrip("}").split(", ") if rest else []:
            g[2][x] += 1 if op == "add" else -1
    sides = lambda c, sign: sorted((x, sign * n) for x, n in c.items() if n * sign > 0)
    got = {(x.term_id, x.commit_seq, x.predicate, x.body): (x.kind, x.n_before, x.n_after, [tuple(y) for y in x.removed], [tuple(y) for y in x.added]) for x in pairing.pair_bodies(spark.createDataFrame(given, "term_id string, commit_seq int, predicate string, value string, operation string")).collect()}
    assert got == {k: ("group", a, b, sides(c, -1), sides(c, 1)) for k, (a, b, c) in want.items() if a and b}
