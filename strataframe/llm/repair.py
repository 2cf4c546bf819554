"""Conversation structure repair: the cheapest edits that make roles alternate, by rank-convergence parallel Viterbi.

The states are what the repaired roles are so far: nothing, a system turn, a user's turn, an assistant's turn. Conversations are cut into
chunks of ``CHUNK`` rows. Each chunk works out its backward costs (what the rest costs from each state) from a speculative vector; fix-up
passes run those chunks anew whose right neighbour came to another vector, until all differ only by constants, which don't
matter for the choice of edits (Maleki, Musuvathi and Mytkowicz, "Parallelizing dynamic programming through
rank convergence"). Rows that must be deleted only add a constant. With the stitched costs each chunk's edits follow from the state in which it is
entered; chunks say this for all four states, and the maps are composed along the conversation.

A pass goes over spans of chunks that grow eightfold up to ``SPAN`` chunks, so the passes that rows without convergence can force are
bounded by their number over CHUNK * SPAN. Costs depend on a chunk through codes of a byte a row; texts are never read by a pass.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import BLANK_CHARS, Scratch, shuffle_partitions
from strataframe.llm.turns import in_order, matched, starts

CHUNK, SPAN = 1024, 4096

# The damage, the costs, and what may follow what.
DROP, EMPTY, STRIP, REPEAT, RECAST, OF = 0, 1, 2, 3, 4, 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state after each state's user's or assistant's turn, whichever may follow.
FOLLOWS = (USER, USER, ASSISTANT, USER)
ROLES = ("", "system", "user", "assistant")
#: What the end of a conversation costs: turns that are still to be put in.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 40


def with_inserts(v: list[int]) -> tuple[int, ...]:
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[NOTHING], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


def kept_state(code: int, state: int) -> int | None:
    """The state after keeping a row, None where it may not be kept. A code is twice the initial's rank (s, u, a, other), plus 1 if truncated."""
    initial = code >> 1
    if initial == 0:
        return SYSTEM if state == NOTHING else None
    return initial + 1 if initial < 3 and FOLLOWS[state] == initial + 1 else None


#: Vectors up to a constant are few; what follows from them is kept by a process.
_stepped: dict = {}
_chosen: dict = {}


def stepped(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Backward costs before a row from those after it; exact, not shifted."""
    if (found := _stepped.get((code, after))) is None:
        extra, out = TRUNCATED * (code & 1), []
        for state in range(4):
            kept = kept_state(code, state)
            out.append(min(DELETE + after[state], REROLE + extra + after[FOLLOWS[state]], FAR if kept is None else extra + after[kept]))
        _stepped[code, after] = found = with_inserts(out)
    return found


def level(v) -> tuple[int, ...]:
    """The vector up to a constant."""
    least = min(v)
    return tuple(x - least for x in v)


def backward(codes: list[int], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Vectors up to constants before each row, and last the one after all. Code -1: no row that may stay."""
    out = [level(after)]
    for code in reversed(codes):
        out.append(out[-1] if code < 0 else level(stepped(code, out[-1])))
    return out[::-1]


def chosen(code: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits up to and with this row, and the state after them."""
    if (found := _chosen.get((code, state, after))) is None:
        before, extra, edits, at = stepped(code, after), TRUNCATED * (code & 1), "", state
        while DELETE + after[at] != before[at] and INSERT + before[FOLLOWS[at]] == before[at]:
            edits, at = edits + "I", FOLLOWS[at]
        kept = kept_state(code, at)
        if DELETE + after[at] == before[at]:
            found = edits + "D", at
        elif kept is not None and extra + after[kept] == before[at]:
            found = edits + "K", kept
        else:
            found = edits + "R", FOLLOWS[at]
        _chosen[code, state, after] = found
    return found


def traced(codes: list[int], forced: list[int], vectors: list[tuple[int, ...]], state: int, last: bool) -> tuple[str, int]:
    """The edits of a chunk that is entered in a state, and the state after it."""
    out = []
    for i, code in enumerate(codes):
        if code >= 0:
            edits, state = chosen(code, state, vectors[i + 1])
            out.append(edits)
        out.append("D" * forced[i])
    while last and END[state]:
        out.append("I")
        state = FOLLOWS[state]
    return "".join(out), state


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n: the damaged rows, each with how often it is there; dropped rows are there 0 times."""
    text_or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text_or_blank("conv_id"), text_or_blank("turn")).cast("binary")) % OF
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_or_blank("role").alias("role"), text_or_blank("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == DROP
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"), F.when(gone, "").when(F.col("kind") == RECAST, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("kind") == EMPTY), "").when(F.col("kind") == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("kind") == REPEAT, 2).otherwise(1).cast("long").alias("n"),
    )


def _place_key(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"))


def ordered_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (conv_id, turn, role, text, n) in order, with chunk, blank, again (seen earlier), and the code and forced deletions of each.

    Rows that repeat are summed up before anything is sorted, so no group of copies is one task.
    """
    rows = scratch.stored(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("digest", F.unhex(F.sha2("text", 256))), "rows")
    firsts = scratch.stored(rows.filter("n > 0").groupBy("conv_id", "role", "digest").agg(F.min(_place_key(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("places")).filter("places > 1").drop("places"), "firsts")
    again = F.coalesce(F.col("first") < _place_key(F.col("turn")), F.lit(False)).alias("again")
    rows = matched(rows, firsts, "conv_id", "role", "digest", how="left").select("conv_id", "turn", "role", "text", "n", again)
    bare = F.rtrim(F.col("text"), F.lit(BLANK_CHARS))
    rows = rows.withColumn("blank", bare == "")
    initial = F.substring("role", 1, 1)
    code = 2 * F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.substring(bare, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    gone = F.col("blank") | F.col("again")
    rows = rows.withColumn("code", F.when(gone | (F.col("n") == 0), -1).otherwise(code).cast("int")).withColumn("forced", F.when(gone, F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0))))
    return scratch.stored(in_order(rows).withColumn("chunk", F.floor(F.col("place") / CHUNK)), "ordered")


_OPS = "conv_id long, part int, chunk long, entry int, ops string"


def _entries(b) -> list[tuple[list[int], list[int]]]:
    return [([e["code"] for e in x], [e["forced"] for e in x]) for x in b.column("entries").to_pylist()]


def _single(batches):
    for b in batches:
        ops = [traced(codes, forced, backward(codes, END), NOTHING, True)[0] for codes, forced in _entries(b)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "chunk")), pa.array([NOTHING] * len(ops), pa.int32()), pa.array(ops, pa.string())], names=["conv_id", "part", "chunk", "entry", "ops"])


def _fixed(t: pa.Table) -> pa.Table:
    """Of a span of chunks of one conversation, those with another vector at their right end run anew, the last first."""
    rows = sorted(t.to_pylist(), key=lambda r: -r["idx"])
    for i, r in enumerate(rows):
        right = rows[i - 1]["out"] if i else r["right"]
        if r["used"] != right:
            r["used"], r["out"] = right, list(backward([e["code"] for e in r["entries"]], tuple(right))[0])
        del r["right"], r["span"]
    return pa.Table.from_pylist(rows, schema=pa.schema([t.schema.field(c) for c in rows[0]]))


def _stitched(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """Chunks with the right vector in ``used``: fix-up passes until no neighbour differs by more than a constant."""
    vector = F.array(*map(F.lit, END))
    first = chunks.withColumn("used", F.lit(None).cast("array<int>")).withColumn("out", vector)
    now, reach, done = scratch.stored(first, "pass-0"), 1, 0
    while True:
        right = now.select("conv_id", (F.col("idx") - 1).alias("idx"), F.col("out").alias("right"))
        ends = matched(now, right, "conv_id", "idx", how="left").withColumn("right", F.coalesce("right", vector))
        if ends.filter(~F.col("used").eqNullSafe(F.col("right"))).isEmpty():
            return now
        spans = ends.withColumn("span", F.floor(F.col("idx") / reach))
        now = scratch.stored(spans.groupBy("conv_id", "span").applyInArrow(_fixed, now.schema), f"pass-{done + 1}")
        scratch.drop(f"pass-{done}")
        reach, done = min(8 * reach, SPAN), done + 1


def _exits(batches):
    for b in batches:
        exits = []
        for (codes, forced), used, last in zip(_entries(b), b.column("used").to_pylist(), b.column("last").to_pylist(), strict=True):
            vectors = backward(codes, tuple(used))
            exits.append([traced(codes, [0] * len(forced), vectors, s, last)[1] for s in range(4)])
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("idx"), pa.array(exits, pa.list_(pa.int32()))], names=["conv_id", "idx", "exits"])


def _composed(t: pa.Table) -> pa.Table:
    """One map of states for a span of chunks."""
    out = list(range(4))
    for r in sorted(t.to_pylist(), key=lambda r: r["idx"]):
        out = [r["exits"][s] for s in out]
    return pa.table({"conv_id": t["conv_id"][:1], "span": t["span"][:1], "exits": pa.array([out], pa.list_(pa.int32()))})


def _entered(t: pa.Table) -> pa.Table:
    """The state before each of the rows, in order of idx, from the one before the first."""
    rows = sorted(t.to_pylist(), key=lambda r: r["idx"])
    state, out = rows[0]["entry"], []
    for r in rows:
        out.append(state)
        state = r["exits"][state]
    return pa.table({"conv_id": pa.array([r["conv_id"] for r in rows], pa.int64()), "idx": pa.array([r["idx"] for r in rows], pa.int64()), "entry": pa.array(out, pa.int32())})


def _traced(batches):
    for b in batches:
        ops = [traced(codes, forced, backward(codes, tuple(used)), entry, last)[0] for (codes, forced), used, entry, last in zip(_entries(b), *(b.column(c).to_pylist() for c in ("used", "entry", "last")), strict=True)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "part", "chunk", "entry")), pa.array(ops, pa.string())], names=["conv_id", "part", "chunk", "entry", "ops"])


def edits(ordered: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, part, chunk, entry, ops): the edits of each chunk, and the state in which it is entered."""
    chunks = ordered.groupBy("conv_id", "part", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "code", "forced"))).alias("entries"))
    chunks = scratch.stored(chunks, "chunks")
    several = scratch.stored(starts(chunks.groupBy("conv_id", "part").agg((F.max("chunk") + 1).alias("n"))), "several")
    alone = matched(chunks, several, "conv_id", "part", how="left_anti").mapInArrow(_single, _OPS)
    if several.isEmpty():
        return alone
    many = matched(chunks, several, "conv_id", "part").withColumn("idx", F.col("before") + F.col("chunk"))
    now = _stitched(many.withColumn("last", F.col("idx") == F.col("total") - 1).drop("before", "total"), scratch)
    maps = scratch.stored(now.mapInArrow(_exits, "conv_id long, idx long, exits array<int>").withColumn("span", F.floor(F.col("idx") / SPAN)), "maps")
    spans = maps.groupBy("conv_id", "span").applyInArrow(_composed, "conv_id long, span long, exits array<int>").select("conv_id", F.col("span").alias("idx"), "exits", F.lit(NOTHING).alias("entry"))
    # a row for CHUNK * SPAN rows of a conversation
    entered = "conv_id long, idx long, entry int"
    tops = spans.groupBy("conv_id").applyInArrow(_entered, entered).select("conv_id", F.col("idx").alias("span"), "entry")
    entries = matched(maps, tops, "conv_id", "span").groupBy("conv_id", "span").applyInArrow(_entered, entered)
    ready = matched(now, entries, "conv_id", "idx")
    return alone.unionByName(ready.mapInArrow(_traced, _OPS))


_WALK = ("conv_id", "part", "chunk", "place", "turn", "role", "text", "n", "blank", "again", "code", "forced", "entry", "ops")


def _with_edits(ordered: DataFrame, ops: DataFrame, *keys: str) -> DataFrame:
    """The rows of each chunk behind a row with its edits, each chunk in order; no two partitions share the keys."""
    heads = ops.withColumn("place", F.lit(-1).cast("long"))
    stream = ordered.unionByName(heads, allowMissingColumns=True).select(*_WALK)
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "part", "chunk", "place")]
    return stream.repartition(shuffle_partitions(ordered.sparkSession), *keys).sortWithinPartitions(*order)


def _walk(batches):
    """(row, edits): each input row with the (edit, state after, role, text) that fall on it; a chunk's edits past its rows come with a row None."""
    ops, at, state = "", 0, NOTHING

    def rest():
        nonlocal at, state
        while at < len(ops):
            at, state = at + 1, FOLLOWS[state]
            yield "I", ROLES[state], ""

    for b in batches:
        for r in b.to_pylist():
            if r["place"] < 0:
                yield None, list(rest())
                ops, at, state = r["ops"], 0, r["entry"]
                yield r, []
                continue
            done = []
            if r["code"] >= 0:
                while ops[at] == "I":
                    at, state = at + 1, FOLLOWS[state]
                    done.append(("I", ROLES[state], ""))
                if ops[at] == "K":
                    state = kept_state(r["code"], state)
                    done.append(("K", r["role"], r["text"]))
                elif ops[at] == "R":
                    state = FOLLOWS[state]
                    done.append(("R", ROLES[state], r["text"]))
                else:
                    done.append(("D", None, None))
                at += 1
            at += r["forced"]
            yield r, done
    yield None, list(rest())


def repair(conversations: DataFrame, damage=damaged) -> DataFrame:
    """The repaired turns: conv_id, part, chunk, place and step (their order), edit (K, R or I), turn (null if put in), role, text.

    ``damage`` says which rows are repaired and how often each is there. Null ids are one conversation, null turns come first. A
    conversation of any length is spread over its chunks. No rows: no rows. Extra columns are left out.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    ordered = ordered_rows(damage(conversations), scratch)

    def run(batches):
        head, step = None, 0
        for r, done in _walk(batches):
            head, step = (r, 0) if r else (head, step)
            out = []
            for edit, role, text in done:
                if edit != "D":
                    out.append({**{c: head[c] for c in ("conv_id", "part", "chunk", "place")}, "step": step, "edit": edit, "turn": head["turn"] if edit != "I" else None, "role": role, "text": text})
                    step += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("chunk", pa.int64()), ("place", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]))

    return _with_edits(ordered, edits(ordered, scratch), "conv_id", "part", "chunk").mapInArrow(run, "conv_id long, part int, chunk long, place long, step int, edit string, turn long, role string, text string")


class _Totals:
    """What the query says of one conversation, from its rows in order."""

    COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def __init__(self, conv_id):
        self.conv_id, self.counts, self.first, self.turn, self.turns = conv_id, dict.fromkeys(self.COLUMNS[2:7], 0), None, None, 0
        self.before, self.audit, self.digest, self.pieces = None, [], hashlib.sha256(), 0

    def row(self, r):
        n, c = r["n"], self.counts
        if not n:
            return
        if r["turn"] is not None and r["turn"] != self.turn:
            self.first, self.turn, self.turns = r["turn"] if self.first is None else self.first, r["turn"], self.turns + 1
        initial = r["role"][:1]
        c["illegal"] += n - 1 + (self.before is not None and self.before + initial not in LEGAL_PAIRS)
        self.before = initial
        c["blank"] += n * r["blank"]
        c["duplicate"] += 0 if r["blank"] else n - (not r["again"])
        c["truncated"] += r["code"] >= 0 and r["code"] & 1
        c["cost"] += DELETE * r["forced"]

    def edited(self, r, done):
        for edit, role, text in done:
            self.counts["cost"] += {"I": INSERT, "D": DELETE, "K": 0, "R": REROLE}[edit] + (TRUNCATED * (r["code"] & 1) if edit in "KR" else 0)
            if edit != "D":
                self.digest.update(("\n" * (self.pieces > 0) + role + ":" + text).encode())
                self.pieces += 1

    def result(self):
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), "".join(self.audit), self.digest.hexdigest())


def op11_repair(conversations: DataFrame) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of each conversation; see the module for the method.

    Null ids are one conversation, null turns come first, rows of one turn go by role and text, a role without characters may
    only be changed or deleted. Rows that repeat are each a row. No rows: no rows. Extra columns are left out. The SHA-256 of a conversation is
    one sequential pass by its definition: its rows stream through one task, never held together.
    """
    scratch = Scratch(conversations.sparkSession, "op11")
    ordered = ordered_rows(damaged(conversations), scratch)

    def run(batches):
        at, ready = None, []
        for r, done in _walk(batches):
            if r is not None and r["place"] < 0:
                if at is None or at.conv_id != r["conv_id"]:
                    ready += [at.result()] if at else []
                    at = _Totals(r["conv_id"])
                at.audit.append(r["ops"])
            elif r is not None:
                at.row(r)
            if at:
                at.edited(r, done)
            if len(ready) >= 1000:
                yield _batch(ready)
                ready = []
        ready += [at.result()] if at else []
        yield _batch(ready)

    def _batch(rows):
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(_Totals.COLUMNS))

    schema = ", ".join(f"{c} {'string' if c in ('audit', 'repaired_sha256') else 'long'}" for c in _Totals.COLUMNS)
    return _with_edits(ordered, edits(ordered, scratch), "conv_id").mapInArrow(run, schema)


#: The plain way: costs and edits forward, a row a step, each state with its cheapest and least edits so far.
ORACLE = """
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda c: ascii(c)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM conversations, bits),
copies AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM named WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS bare, left(role, 1) AS initial FROM copies),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND again AS duplicate, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS extra,
         before IS NOT NULL AND concat(before, initial) NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (extra > 0) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n FROM faults GROUP BY conv_id),
best AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'e': '', 'o': ''} AS z, {'c': 1000000000, 'e': '', 'o': ''} AS s, {'c': 3, 'e': 'I', 'o': chr(10) || 'user:'} AS u, {'c': 6, 'e': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM counted
  UNION ALL
  SELECT conv_id, i, z, s, list_min([u, {'c': z.c + 3, 'e': z.e || 'I', 'o': z.o || chr(10) || 'user:'}, {'c': s.c + 3, 'e': s.e || 'I', 'o': s.o || chr(10) || 'user:'}, {'c': a.c + 3, 'e': a.e || 'I', 'o': a.o || chr(10) || 'user:'}]),
         list_min([a, {'c': u.c + 3, 'e': u.e || 'I', 'o': u.o || chr(10) || 'assistant:'}, {'c': z.c + 6, 'e': z.e || 'II', 'o': z.o || chr(10) || 'user:' || chr(10) || 'assistant:'}, {'c': s.c + 6, 'e': s.e || 'II', 'o': s.o || chr(10) || 'user:' || chr(10) || 'assistant:'}])
  FROM (
    SELECT b.conv_id, f.i, {'c': z.c + 4, 'e': z.e || 'D', 'o': z.o} AS z,
      list_min([{'c': s.c + 4, 'e': s.e || 'D', 'o': s.o}, {'c': z.c + extra + CASE WHEN stays AND initial = 's' THEN 0 ELSE 1000000000 END, 'e': z.e || 'K', 'o': z.o || kept}]) AS s,
      list_min([{'c': u.c + 4, 'e': u.e || 'D', 'o': u.o},
        {'c': z.c + extra + may_u, 'e': z.e || 'K', 'o': z.o || kept}, {'c': s.c + extra + may_u, 'e': s.e || 'K', 'o': s.o || kept}, {'c': a.c + extra + may_u, 'e': a.e || 'K', 'o': a.o || kept},
        {'c': z.c + extra + may_r, 'e': z.e || 'R', 'o': z.o || as_u}, {'c': s.c + extra + may_r, 'e': s.e || 'R', 'o': s.o || as_u}, {'c': a.c + extra + may_r, 'e': a.e || 'R', 'o': a.o || as_u}]) AS u,
      list_min([{'c': a.c + 4, 'e': a.e || 'D', 'o': a.o}, {'c': u.c + extra + CASE WHEN stays AND initial = 'a' THEN 0 ELSE 1000000000 END, 'e': u.e || 'K', 'o': u.o || kept}, {'c': u.c + extra + may_r, 'e': u.e || 'R', 'o': u.o || as_a}]) AS a
    FROM best b JOIN (
      SELECT *, NOT blank AND NOT duplicate AS stays, concat(chr(10), role, ':', text) AS kept, concat(chr(10), 'user:', text) AS as_u, concat(chr(10), 'assistant:', text) AS as_a,
        CASE WHEN blank OR duplicate THEN 1000000000 ELSE 3 END AS may_r, CASE WHEN blank OR duplicate OR initial <> 'u' THEN 1000000000 ELSE 0 END AS may_u FROM faults) f
    ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1) x),
ended AS (SELECT b.conv_id, list_min([b.z, b.a]) AS w FROM best b JOIN counted c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.n = b.i)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit, sha256(substr(coalesce(w.o, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
