"""From document text to the clauses of its entities.

A document is a header and stanzas; an entity is a ``[Term]`` stanza with an id. Clauses are kept as a sorted
multiset and hashed, so a stanza that is only written in another order doesn't count as changed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataframe.functions.reader import Reader
from strataframe.functions.text import or_null

STANZA = r"(?m)(?=^\[[^\]\n]+\]\n)"
ID_LINE = r"(?m)^id: [^\S\n]*(\S+)"
CLAUSE = T.StructType([T.StructField("predicate", T.StringType()), T.StructField("value", T.StringType())])
READ = T.StructType([T.StructField("clauses", T.ArrayType(CLAUSE)), T.StructField("error", T.StringType())])
_PAIR = pa.struct([("predicate", pa.string()), ("value", pa.string())])


def stanza_id(stanza: Column) -> Column:
    return or_null(F.regexp_extract(stanza, ID_LINE, 1))


def stanzas(versions: DataFrame, content: str = "content") -> DataFrame:
    """All columns but the content, with term_id, stanza and pos of each entity's stanza.

    Stanzas of other kinds and without an id are left out. Null content: no stanzas.
    """
    rest = [c for c in versions.columns if c != content]
    split = versions.select(*rest, F.posexplode(F.split(F.col(content), STANZA)).alias("pos", "stanza"))
    return split.filter(F.col("stanza").startswith("[Term]\n")).withColumn("term_id", stanza_id(F.col("stanza"))).filter("term_id is not null")


def lines_of(stanza: Column) -> Column:
    """The clause lines, without the head, the id and blank lines."""
    lines = F.transform(F.split(stanza, "\n"), lambda x: F.rtrim(x))
    return F.filter(F.slice(lines, 2, F.size(lines)), lambda x: (x != "") & ~x.startswith("!") & ~x.startswith("id:"))


@F.arrow_udf(CLAUSE)
def _canonical(lines: pa.Array) -> pa.Array:
    reader = Reader()
    return pa.array([None if x is None else dict(zip(("predicate", "value"), reader.line(x)[0])) for x in lines.to_pylist()], _PAIR)


def canonical(line: Column) -> Column:
    """(predicate, value) of a clause line, written in one way: a document that is only spaced in another way
    has the same clauses.

    One blank between the parts of a value, none around ``=`` in qualifiers, one after each comma of the qualifiers and
    of a list of references. The order of qualifiers is part of the value.
    """
    return _canonical(line)


@F.arrow_udf(READ)
def _read(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    reader = Reader()
    for texts, ids in batches:
        rows = [((), None) if t is None else reader.stanza(t, i) for t, i in zip(texts.to_pylist(), ids.to_pylist())]
        flat = [c for clauses, _ in rows for c in clauses]
        pairs = pa.StructArray.from_arrays([pa.array([c[k] for c in flat], pa.string()) for k in (0, 1)], fields=list(_PAIR))
        offsets = pa.array(itertools.accumulate((len(c) for c, _ in rows), initial=0), pa.int32())
        yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pairs), pa.array([e for _, e in rows], pa.string())], names=["clauses", "error"])


def read(stanza: Column, term_id: Column) -> Column:
    """READ of a stanza, in one linear pass: its sorted clauses, each in its one way of writing, and null or why it can't be read.

    Stanzas fail one by one, so a bad one costs no other. A line may be of any length and hold any marks.
    """
    return _read(stanza, term_id)


def clauses_of(stanza: Column) -> Column:
    """Sorted array of (predicate, value), each in its one way of writing."""
    return read(stanza, F.lit(None).cast("string"))["clauses"]


def parse_error(stanza: Column, term_id: Column) -> Column:
    """Null, or why the stanza can't be read."""
    return read(stanza, term_id)["error"]


def content_hash(clauses: Column) -> Column:
    """SHA-1 of each predicate and value followed by a zero byte, in sorted order."""
    parts = F.transform(F.array_sort(clauses), lambda x: F.concat(x["predicate"], F.lit("\0"), x["value"], F.lit("\0")))
    return F.sha1(F.array_join(parts, ""))


def once_each(clauses: Column) -> Column:
    """(predicate, value, n) of plain clauses; what repeats stays repeated."""
    return F.transform(clauses, lambda x: F.struct(x["predicate"].alias("predicate"), x["value"].alias("value"), F.lit(1).alias("n")))


def expanded(counted: Column) -> Column:
    """Clauses as often as their ``n`` says, sorted."""
    return F.flatten(F.transform(F.array_sort(counted), lambda x: F.array_repeat(F.struct(x["predicate"].alias("predicate"), x["value"].alias("value")), x["n"])))


def counted_hash(counted: Column) -> Column:
    """``content_hash`` of the expanded clauses, without expanding them."""
    parts = F.transform(F.array_sort(counted), lambda x: F.repeat(F.concat(x["predicate"], F.lit("\0"), x["value"], F.lit("\0")), x["n"]))
    return F.sha1(F.array_join(parts, ""))


def name_of(clauses: Column, predicate: str = "name") -> Column:
    return F.try_element_at(F.filter(clauses, lambda x: x["predicate"] == predicate), F.lit(1))["value"]


def is_obsolete(clauses: Column, predicate: str = "is_obsolete", value: str = "true") -> Column:
    return F.exists(clauses, lambda x: (x["predicate"] == predicate) & (x["value"] == value))
