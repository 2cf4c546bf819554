"""Edits out of removed and added clauses, and what a search really hits.

Pairing is sequential within the changes of one predicate of an entity in one commit, so it runs in Python, on
both sides as Spark has counted, gathered and sorted them: a row a distinct value, however often it occurs. Groups without both a removal
and an addition, which are most, never reach Python.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql import types as T

from strataframe.functions.clauses import delta_matches, edit_kind, edit_lines, pair_counted, parse_value
from strataframe.functions.text import truncated

OPS = "term_id string, commit_seq int, predicate string, kind string, before string, after string"
GROUP = ["term_id", "commit_seq", "predicate"]


def pair_changes(changes: DataFrame, least: float = 0.5) -> DataFrame:
    """changes (term_id, commit_seq, predicate, value, operation) -> OPS; kind is edit, remove or add.

    No changes: no rows. Nulls among the keys form groups of their own; null values count as empty.
    """
    counted = changes.groupBy(*GROUP, F.coalesce("value", F.lit("")).alias("value"), "operation").agg(F.count(F.lit(1)).cast("int").alias("n"))
    side = lambda x: F.sort_array(F.collect_list(F.when(F.col("operation") == x, F.struct("value", "n")))).alias(x)
    groups = counted.groupBy(*GROUP).agg(side("remove"), side("add"))
    none = F.lit(None).cast("string")
    one = lambda kind, before, after, n: F.struct(F.lit(kind).alias("kind"), before.alias("before"), after.alias("after"), n.alias("n"))
    ops = F.concat(F.transform("remove", lambda x: one("remove", x["value"], none, x["n"])), F.transform("add", lambda x: one("add", none, x["value"], x["n"])))
    alone = groups.filter("size(remove) = 0 or size(add) = 0").select(*GROUP, F.explode(ops).alias("o")).select(*GROUP, "o.*")

    def run(batches):
        for b in batches:
            out = []
            for *key, old, new in zip(*(b.column(c).to_pylist() for c in (*GROUP, "remove", "add"))):
                old, new = ([(x["value"], x["n"]) for x in side] for side in (old, new))
                pairs = pair_counted(key[2], old, new, least)
                left, right = [n for _, n in old], [n for _, n in new]
                for i, j, n in pairs:
                    left[i], right[j] = left[i] - n, right[j] - n
                out += [(*key, "edit", old[i][0], new[j][0], n) for i, j, n in pairs]
                out += [(*key, "remove", x, None, n) for (x, _), n in zip(old, left) if n]
                out += [(*key, "add", None, x, n) for (x, _), n in zip(new, right) if n]
            if out:
                kinds = (pa.string(), pa.int32(), *[pa.string()] * 4, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=[*GROUP, "kind", "before", "after", "n"])

    both = groups.filter("size(remove) > 0 and size(add) > 0").select(*GROUP, "remove", "add")
    made = alone.unionByName(both.mapInArrow(run, OPS + ", n int"))
    return made.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "__n")


_PARTS = T.StructType([T.StructField("body", T.StringType()), T.StructField("qualifiers", T.ArrayType(T.StringType()))])


@F.arrow_udf(_PARTS)
def _parts(predicates: pa.Array, values: pa.Array) -> pa.Array:
    read = (parse_value(p, v) for p, v in zip(predicates.to_pylist(), values.to_pylist()))
    return pa.array([None if x is None else {"body": x.body, "qualifiers": list(x.qualifiers)} for x in read], pa.struct([("body", pa.string()), ("qualifiers", pa.list_(pa.string()))]))


def pair_bodies(changes: DataFrame) -> DataFrame:
    """changes (term_id, commit_seq, predicate, value, operation) -> one edit for all removed and added clauses of one body.

    (GROUP, kind, body, n_before, n_after, removed, added): how many clauses stand on each side, and the multiset difference of
    their qualifiers, as sorted arrays of (qualifier, n). Nothing is paired one by one, so any number of clauses on either
    side is two sums, and a body that holds much of a table is added up before it is shuffled. Bodies of one side alone, and values that can't be read,
    are no such edit.
    """
    counted = changes.groupBy(*GROUP, F.coalesce("value", F.lit("")).alias("value"), "operation").agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("p", _parts("predicate", "value")).filter("p is not null").select(*GROUP, "p.*", F.when(F.col("operation") == "add", F.col("n")).otherwise(-F.col("n")).alias("n"))
    side = lambda sign: F.coalesce(F.sum(F.when(F.col("n") * sign > 0, F.col("n") * sign)), F.lit(0))
    groups = parts.groupBy(*GROUP, "body").agg(side(-1).alias("n_before"), side(1).alias("n_after")).filter("n_before > 0 and n_after > 0")
    net = parts.select(*GROUP, "body", "n", F.explode("qualifiers").alias("qualifier")).groupBy(*GROUP, "body", "qualifier").agg(F.sum("n").alias("net")).filter("net <> 0")
    of = lambda sign: F.sort_array(F.collect_list(F.when(F.col("net") * sign > 0, F.struct("qualifier", (F.col("net") * sign).alias("n")))))
    changed = net.groupBy(*GROUP, "body").agg(of(-1).alias("removed"), of(1).alias("added"))
    none = F.array().cast("array<struct<qualifier:string,n:bigint>>")
    keys = [*GROUP, "body"]
    right = changed.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return groups.join(right, same, "left").select(*GROUP, F.lit("group").alias("kind"), "body", "n_before", "n_after", F.coalesce("removed", none).alias("removed"), F.coalesce("added", none).alias("added"))


def in_order(ops: DataFrame) -> DataFrame:
    """Sorted as a reader expects: by entity, commit and predicate, edits before removals before additions."""
    rank = F.when(F.col("kind") == "edit", 0).when(F.col("kind") == "remove", 1).otherwise(2)
    return ops.orderBy("term_id", "commit_seq", "predicate", rank, F.coalesce("before", "after"), "after")


def _on_edits(ops: DataFrame, columns: str, made) -> DataFrame:
    def run(batches):
        for p in batches:
            yield made(p)

    return ops.filter("kind = 'edit'").mapInPandas(run, columns)


def edit_kinds(ops: DataFrame) -> DataFrame:
    """OPS of the edits with how each is best shown."""
    return _on_edits(ops, OPS + ", edit_kind string", lambda p: p.assign(edit_kind=[edit_kind(*x) for x in zip(p["predicate"], p["before"], p["after"])]))


def edit_texts(ops: DataFrame, cap: int | None = 200) -> DataFrame:
    """OPS of the edits with their lines: marker and text, joined by line breaks."""
    lines = lambda x: "\n".join(f"{m} {t}" for m, t in edit_lines(*x, cap))
    return _on_edits(ops, OPS + ", lines string", lambda p: p.assign(lines=[lines(x) for x in zip(p["predicate"], p["before"], p["after"])]))


def rendered(ops: DataFrame, cap: int | None = 200) -> DataFrame:
    """OPS with their lines: marker and text, joined by line breaks. Additions and removals stay in the JVM."""
    short = lambda c: truncated(c, cap) if cap is not None else c
    plain = F.concat(F.when(F.col("kind") == "add", "+ ").otherwise("- "), "predicate", F.lit(": "), short(F.coalesce("before", "after")))
    return edit_texts(ops, cap).unionByName(ops.filter("kind <> 'edit'").withColumn("lines", plain))


def search_hits(matched: DataFrame, query: str, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """OPS of matched changes, without edits that the query hits only in what they kept."""
    ops = pair_changes(matched)

    def run(batches):
        for p in batches:
            keep = [k != "edit" or delta_matches(x, b, a, query, regex, ignore_case) for k, x, b, a in zip(p["kind"], p["predicate"], p["before"], p["after"])]
            yield p[keep]

    return ops.mapInPandas(run, OPS)
