import random
import re
from collections import Counter

from pyspark.sql import functions as F

from strataframe.operators import changes, stanzas
from strataframe.operators.history import History
from strataframe.streaming.append import VERSIONS, append_batch, append_stream

HEAD = "format-version: 1.2\n\n"


def document(terms: dict[str, list[str]]) -> str:
    return HEAD + "\n".join(f"[Term]\nid: {t}\n" + "".join(f"{line}\n" for line in lines) for t, lines in terms.items()) + "\n[Typedef]\nid: part_of\nname: part of\n"


def frame(spark, documents):
    return spark.createDataFrame([(i, f"s{i}", d) for i, d in enumerate(documents)], VERSIONS)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


EVENT = ("term_id", "commit_seq", "predicate", "value", "operation")


def simulate(documents):
    """The rules, one version after the other: what was good last is kept over failures, lost by removal."""
    good, raw, events, skipped, shots = {}, {}, [], [], []
    for i, d in enumerate(documents):
        if d is None:
            skipped.append((i, None, "BlobMissing"))
            continue
        for t in set(raw) - set(d):
            events += [(t, i, *c, "remove") for c in good.pop(t, [])]
            raw.pop(t)
        for t, lines in d.items():
            if raw.get(t) == lines:
                continue
            raw[t] = lines
            if any("VAGUELY" in x for x in lines):
                skipped.append((i, t, "ParseError"))
                continue
            now = sorted(tuple(x.split(": ", 1)) for x in lines)
            if t in good and good[t] == now:
                continue
            before = Counter(good.get(t, []))
            events += [(t, i, *c, "add") for c in (Counter(now) - before).elements()] + [(t, i, *c, "remove") for c in (before - Counter(now)).elements()]
            shots.append((t, i))
            good[t] = now
    return sorted(events, key=str), sorted(skipped, key=str), sorted(shots, key=str)


def random_history(seed: int, n: int = 14):
    r, out, now = random.Random(seed), [], {}
    for _ in range(n):
        if r.random() < 0.12:
            out.append(None)
            continue
        for t in ("X:1", "X:2", "X:3", "Y:1"):
            p = r.random()
            if p < 0.25:
                now.pop(t, None)
            elif p < 0.7:
                now[t] = [f"{r.choice(['name', 'xref'])}: v{r.randint(0, 2)}" for _ in range(r.randint(1, 3))]
                if r.random() < 0.25:
                    now[t].append('synonym: "y" VAGUELY [Z:9]')
        out.append(dict(now))
    return out


def test_random_histories_follow_the_rules(spark):
    for seed in range(4):
        history = random_history(seed)
        made = changes.build(frame(spark, [d if d is None else document(d) for d in history]))
        events, skipped, shots = simulate(history)
        assert rows(made["events"], *EVENT) == events
        assert rows(made["skipped"], "commit_seq", "term_id", "error") == skipped
        assert rows(made["term_snapshots"], "term_id", "commit_seq") == shots


def test_births_reorderings_and_flags(spark):
    oak, elm = "T:31", "T:8"
    first = ["name: oak", "xref: W:5", 'def: "A tree." [W:5]']
    history = [{elm: ["name: elm"]}, {elm: ["name: elm"], oak: first}, {elm: ["name: elm"], oak: first[::-1]}, {elm: ["name: elm", "is_obsolete: true"], oak: [*first, "xref: W:5"]}]
    made = changes.build(frame(spark, [document(d) for d in history]))
    want = [(elm, 0, "name", "elm", "add"), *((oak, 1, *x.split(": ", 1), "add") for x in first), (elm, 3, "is_obsolete", "true", "add"), (oak, 3, "xref", "W:5", "add")]
    assert rows(made["events"], *EVENT) == sorted(want, key=str)
    shots = {(r.term_id, r.commit_seq): r for r in made["term_snapshots"].collect()}
    assert set(shots) == {(elm, 0), (oak, 1), (elm, 3), (oak, 3)}  # another order of the same clauses is no change
    assert shots[elm, 3].is_obsolete and shots[oak, 3].name == "oak" and not shots[oak, 3].is_obsolete and len(shots[oak, 3].clauses) == 4


def test_another_spacing_is_no_change(spark):
    one = {"T:1": ['synonym: "a, b" EXACT [W:1, W:2] {s="1", n="x,y"} ! c', "name: two  words"]}
    two = {"T:1": ['synonym:  "a, b"   EXACT [W:1,W:2]{s = "1",n="x,y"}   !  c', "name: two  words  "]}
    made = changes.build(frame(spark, [document(one), document(two)]))
    assert rows(made["term_snapshots"], "commit_seq") == [(0,)]
    assert [r.value for r in made["events"].orderBy("predicate").collect()] == ["two  words", '"a, b" EXACT [W:1, W:2] {s="1", n="x,y"} ! c']


def test_milestones(spark):
    a = "M:1"
    history = [{}, {a: ["name: x"]}, {a: ["name: x", "is_obsolete: true", "replaced_by: M:2"]}, {a: ["name: x"]}, {a: ["name: x", "is_obsolete: true"]}, {}, {a: ["name: y"]}]
    made = changes.build(frame(spark, [document(d) for d in history]))
    got = History(made["events"], None, made["term_snapshots"]).milestones()
    assert rows(got, "commit_seq", "kind", "target") == sorted([(1, "created", None), (2, "obsoleted", None), (2, "merged", "M:2"), (3, "restored", None), (4, "obsoleted", None), (5, "removed", None), (6, "created", None)], key=str)


def test_replaying_events_gives_the_states(spark):
    history = [d for d in random_history(9) if d is not None]
    made = changes.build(frame(spark, [document(d) for d in history]))
    events = made["events"].collect()
    for seq, d in enumerate(history):
        net = Counter()
        for e in events:
            if e.commit_seq <= seq:
                net[e.term_id, e.predicate, e.value] += 1 if e.operation == "add" else -1
        assert min(net.values(), default=0) >= 0
        want = Counter((t, *line.split(": ", 1)) for t, lines in d.items() if not any("VAGUELY" in x for x in lines) for line in lines)
        got = Counter({k: n for k, n in net.items() if n and not any("VAGUELY" in x for x in d.get(k[0], []))})
        assert got == want


def test_window_keeps_numbers(spark):
    versions = changes.last_versions(frame(spark, [document({"X:1": [f"name: {i}"]}) for i in range(5)]), 2)
    assert rows(changes.build(versions)["events"], "commit_seq", "value", "operation") == [(3, "3", "add"), (4, "3", "remove"), (4, "4", "add")]


def test_stanzas(spark):
    text = document({"K:6 ! a kind of kite": ["name: kite"], "A:1": ["name: a [Term] inline", "comment"]}) + "\n[Term]\nname: no id\n"
    got = stanzas.stanzas(frame(spark, [text, None, ""])).select("term_id", stanzas.clauses_of(F.col("stanza")).alias("c"), stanzas.parse_error(F.col("stanza"), F.col("term_id")).alias("e"))
    found = {r.term_id: ([tuple(c) for c in r.c], r.e) for r in got.collect()}
    assert found == {"K:6": ([("name", "kite")], None), "A:1": ([("comment", ""), ("name", "a [Term] inline")], "ParseError")}


def test_content_hash_is_of_the_sorted_clauses(spark):
    import hashlib

    df = spark.sql("select array(named_struct('predicate','n','value','ç'), named_struct('predicate','a','value','1')) as c")
    assert df.select(stanzas.content_hash(F.col("c"))).first()[0] == hashlib.sha1("a\x001\x00n\x00ç\x00".encode()).hexdigest()


def test_appending_gives_the_full_build(spark, tmp_path):
    history = random_history(21, 16)
    documents = [d if d is None else document(d) for d in history]
    full = changes.build(frame(spark, documents))
    versions = frame(spark, documents)
    for n, (lo, hi) in enumerate([(0, 5), (5, 9), (9, 16)]):
        append_batch(versions.filter((F.col("commit_seq") >= lo) & (F.col("commit_seq") < hi)), str(tmp_path / "h"), n)
    for name, columns in (("events", EVENT), ("term_snapshots", ("term_id", "commit_seq", "content_hash")), ("skipped", ("commit_seq", "term_id", "error"))):
        assert rows(spark.read.parquet(str(tmp_path / "h" / name)), *columns) == rows(full[name], *columns)


def test_stream_appends_files(spark, tmp_path):
    documents = [document({"X:1": [f"name: {i // 2}"]}) for i in range(4)]
    versions = frame(spark, documents)
    for k in range(2):
        versions.filter(F.col("commit_seq").between(2 * k, 2 * k + 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        append_stream(spark, str(tmp_path / "in"), str(tmp_path / "h"), str(tmp_path / "c")).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "h" / "events")), *EVENT) == rows(changes.build(versions)["events"], *EVENT)


def test_star_documents_come_in_parts_of_one_stanza(spark):
    from strataframe.sources import star

    parts = star.documents(spark, "/root/testdata/sf0.001").persist()
    assert parts.filter(F.size(F.split("content", r"\[Term\]")) > 2).count() == 0 < parts.count()
    whole = parts.groupBy("commit_seq", "sha").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "content"))), lambda x: x["content"]), "\n").alias("content"))
    for name, columns in (("events", EVENT), ("skipped", ("commit_seq", "sha", "term_id", "error"))):
        assert rows(changes.build(parts)[name], *columns) == rows(changes.build(whole)[name], *columns)


def test_of_repeated_ids_the_last_part_counts(spark):
    parts = [(0, "s0", p, document({"X:1": [f"name: {v}"]})) for p, v in (("b", 2), ("a", 1))]
    made = changes.build(spark.createDataFrame(parts, "commit_seq int, sha string, part string, content string"))
    assert rows(made["events"], *EVENT) == [("X:1", 0, "name", "2", "add")]


def test_clauses_are_counted_and_kept_out_of_the_windows(spark):
    state = spark.createDataFrame([("U", 0, "p", "a")] * 40 + [("U", 0, "p", "b")] + [("U", 1, "p", "a")] * 40 + [("U", 2, "p", "a")] * 39, "term_id string, commit_seq int, predicate string, value string")
    presence = changes.presence_of_state(state)
    assert presence.agg(F.max(F.size("clauses"))).first()[0] == 2
    assert rows(presence, "vidx", "content_hash") == rows(state.groupBy("commit_seq").agg(stanzas.content_hash(F.collect_list(F.struct("predicate", "value"))).alias("h")), "commit_seq", "h")
    versions = spark.createDataFrame([(i, f"s{i}", i) for i in range(4)], "commit_seq int, sha string, vidx int")
    made = changes.change_tables(presence, versions)
    got = Counter(tuple(r) for r in made["events"].select(*EVENT).collect())
    assert got == {("U", 0, "p", "a", "add"): 40, ("U", 0, "p", "b", "add"): 1, ("U", 1, "p", "b", "remove"): 1, ("U", 2, "p", "a", "remove"): 1, ("U", 3, "p", "a", "remove"): 39}
    assert rows(made["term_snapshots"].select("commit_seq", F.size("clauses").alias("n")), "commit_seq", "n") == [(0, 41), (1, 40), (2, 39)]
    for name in ("events", "term_snapshots"):
        plan = made[name]._jdf.queryExecution().optimizedPlan().toString()
        assert not [x for x in plan.split("\n") if "Window [" in x and "clauses" in x]


def test_long_values_go_by_digests(spark, tmp_path):
    """The same events, which are counted without their values."""
    r = random.Random(12)
    given = [(f"T:{r.randrange(6)}", v, r.choice("pq"), r.choice(("a", "b", "long " * 20, ""))) for v in range(6) for _ in range(r.randrange(30))]
    state = spark.createDataFrame(given, "term_id string, commit_seq int, predicate string, value string")
    changes.presence_of_state(state).write.parquet(f"{tmp_path}/presence")
    presence = spark.read.parquet(f"{tmp_path}/presence")
    versions = spark.createDataFrame([(v, 10 * v, f"s{v}") for v in range(6)], "vidx int, commit_seq int, sha string")
    columns = ("term_id", "commit_seq", "sha", "predicate", "value", "operation")
    plain, long = (changes.change_tables(presence, versions, "p", ("q", "a"), long_values=x)["events"] for x in (False, True))
    assert rows(long, *columns) == rows(plain, *columns) and plain.count() > 50
    # clauses that repeat instead of being counted
    repeated = presence.withColumn("clauses", F.flatten(F.transform("clauses", lambda c: F.array_repeat(c.withField("n", F.lit(1)), c["n"]))))
    assert rows(changes.change_tables(repeated, versions, "p", ("q", "a"), long_values=True)["events"], *columns) == rows(plain, *columns)
    summed = lambda df: re.findall(r"Aggregate \[[^\]]*\bvalue#\d+\],", df._jdf.queryExecution().optimizedPlan().toString())
    assert summed(plain) and not summed(long)
