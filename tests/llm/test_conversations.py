"""Operators over conversations against their SQL, on tables with whatever may go wrong."""

import itertools
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataframe.llm import repair, trie
from tests.oracle import norm

SCHEMA = "conv_id long, turn long, role string, text string, part string, place string, n string, chunk string, shard string"
TEXTS = ["Yes.", "no", "What?", "", " \t\n", None, "a\x85", "Tail. \r\n", "word é!", "!", "x" * 40]


def turns(seed: int, conversations: int = 60, ids=None):
    r = random.Random(seed)
    out = []
    for c in ids or range(conversations):
        for i in range(r.choice([0, 1, 2, 5, 8, 14])):
            role = r.choice(["user", "assistant"]) if r.random() < 0.8 else r.choice(["system", "tool", "", None, "user"])
            out.append((c, None if r.random() < 0.04 else i + r.choice([0, 0, 0, 1, 40]), role, r.choice(TEXTS)))
    return [*out, *out[5:9], *out[5:7]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def by_sql(sql, rows):
    con = duckdb.connect()
    conversations = pd.DataFrame({c: pd.array([r[i] for r in rows], dtype=k) for i, (c, k) in enumerate((("conv_id", "Int64"), ("turn", "Int64"), ("role", "string"), ("text", "string")))})
    con.register("given", conversations)
    con.execute("create table conversations as select conv_id::bigint as conv_id, turn::bigint as turn, role::varchar as role, text::varchar as text from given")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, sorted((tuple(norm(x) for x in r) for r in found.fetchall()))


def agrees(df, sql, rows):
    names, want = by_sql(sql, rows)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(norm(x) for x in r) for r in df.select(*names).collect()) == want


@pytest.mark.parametrize("chunk,span", [(1024, 4096), (2, 3)])
def test_repair_against_sql(spark, monkeypatch, chunk, span):
    monkeypatch.setattr(repair, "CHUNK", chunk)
    monkeypatch.setattr(repair, "SPAN", span)
    rows = turns(1) + turns(2, ids=[None, -7, 1 << 40])
    agrees(repair.op11_repair(frame(spark, rows)), repair.ORACLE, rows)
    agrees(repair.op11_repair(frame(spark, [])), repair.ORACLE, [])


def test_one_conversation_over_many_chunks(spark, monkeypatch):
    """A conversation with most of the rows, with stretches in which vectors don't converge, over all partitions and passes."""
    monkeypatch.setattr(repair, "CHUNK", 7)
    monkeypatch.setattr(repair, "SPAN", 16)
    r = random.Random(3)
    hot = [(5, i, r.choice(["user", "assistant"]) if i % 400 > 250 else "tool", f"open {i}" if i % 400 < 380 else r.choice(TEXTS)) for i in range(1600)]
    rows = [*hot, *turns(4, 20), *[(5, 9, "user", "same.")] * 50]
    agrees(repair.op11_repair(frame(spark, rows)), repair.ORACLE, rows)


def test_vectors_against_all_edits():
    """Costs and least edits against every sequence of edits of short conversations."""
    ok = {""} | {s + "ua" * k for s in ("", "s") for k in range(1, 4)}
    costs = {"D": 4, "I": 3}

    def plain(codes):
        best = None
        per_row = [["D", *(["K"] if c >> 1 < 3 else []), "Ru", "Ra"] for c in codes]
        gaps = ["", "u", "a", "ua", "au", "uau", "aua"]
        for edits in itertools.product(*per_row):
            for puts in itertools.product(gaps, repeat=len(codes) + 1):
                out = audit = ""
                cost = 0
                for i, put in enumerate(puts):
                    out, audit, cost = out + put, audit + "I" * len(put), cost + costs["I"] * len(put)
                    if i < len(codes):
                        e = edits[i]
                        audit += e[0]
                        out += "" if e == "D" else "sua"[codes[i] >> 1] if e == "K" else e[1]
                        cost += 4 if e == "D" else 3 * (codes[i] & 1) + 3 * (e != "K")
                if out in ok and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        return best[1]

    r = random.Random(1)
    for _ in range(120):
        codes = [r.randrange(8) for _ in range(r.randrange(4))]
        got, _ = repair.traced(codes, [0] * len(codes), repair.backward(codes, repair.END), 0, True)
        assert got == plain(codes), codes


def test_repaired_turns(spark):
    """The operator's own rows, without damage: roles alternate, kept texts are those given."""
    rows = turns(6, 25)
    given = frame(spark, rows)
    got = repair.repair(given, lambda df: df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("n")))
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.conv_id, r.part, r.chunk, r.place, r.step)):
        by.setdefault(r.conv_id, []).append(r)
    assert by
    for turns_ in by.values():
        initials = "".join(r.role[0] for r in turns_)
        body = initials.removeprefix("s")
        assert body and body == "ua" * (len(body) // 2)
        assert all((r.turn is None and r.text == "") if r.edit == "I" else any(x[0] == r.conv_id and (x[3] or " ") == r.text for x in rows) for r in turns_)


def families(seed: int, n: int, deep: int):
    """Conversations that share long beginnings, some whole, among others that share nothing."""
    r = random.Random(seed)
    trunk = [(r.choice(["user", "assistant"]), f"turn {i}") for i in range(deep)]
    out = []
    for c in range(n):
        keep = r.choice([0, 1, deep // 3, deep // 2, deep - 1, deep, deep])
        body = trunk[:keep] + [("user", r.choice(TEXTS)) for _ in range(r.choice([0, 0, 1, 3, deep]))]
        out += [(c, i, role, text) for i, (role, text) in enumerate(body)]
    return out


@pytest.mark.parametrize("segment", [256, 3])
def test_trie_against_sql(spark, monkeypatch, segment):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    rows = turns(1) + turns(2, ids=[None, -7, 1 << 40]) + [(77, 1, "user", "again")] * 20
    agrees(trie.op12_trie(frame(spark, rows)), trie.ORACLE, rows)


@pytest.mark.parametrize("segment,piece", [(256, 10_000), (4, 2)])
def test_trie_of_shared_beginnings(spark, monkeypatch, segment, piece):
    monkeypatch.setattr(trie, "SEGMENT", segment)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = families(3, 90, 13)
    agrees(trie.op12_trie(frame(spark, rows)), trie.ORACLE, rows)


def test_trie_of_nothing(spark):
    assert trie.op12_trie(frame(spark, [])).count() == 0
    assert [tuple(r)[:7] for r in trie.op12_trie(frame(spark, [(5, 0, "user", "é")])).orderBy("depth").collect()] == [(5, 0, None, 1, 1, 1, 0), (5, 1, 5, 1, 0, 1, 0)]
