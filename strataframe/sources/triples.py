"""Versions written as N-Triples, as the rows of any other history: entity, predicate, value.

A triple is a line, so a version comes as lines (``spark.read.text`` splits files itself) and is never one cell. Subjects and
predicates become short names by prefixes, literals their text, so a history says the same in either form.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The grammar of a line, and what is escaped in literals.
IRI = r"<([^\x00-\x20<>\"{}|^`]*+)>"
NODE = rf"(?:{IRI}|(_:[^\s<>\"]++))"
LITERAL = rf'"((?:[^"\\\n\r]++|\\.)*+)"(?:@([A-Za-z]++(?:-[A-Za-z0-9]++)*+)|\^\^{IRI})?'
LINE = re.compile(rf"[ \t]*+{NODE}[ \t]*+{IRI}[ \t]*+(?:{NODE}|{LITERAL})[ \t]*+\.[ \t]*+(?:#.*)?", re.S)
ESCAPED = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
MARKS = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
PLAIN_TYPE = "http://www.w3.org/2001/XMLSchema#string"
TRIPLE = T.StructType([T.StructField(c, T.StringType()) for c in ("term_id", "predicate", "value", "error")])


def unescaped(text: str) -> str:
    """KeyError, ValueError or OverflowError where an escape is none."""
    if "\\" not in text:
        return text
    return ESCAPED.sub(lambda m: MARKS[m[3]] if m[3] else chr(int(m[1] or m[2], 16)), text)


def short(iri: str, prefixes: list[tuple[str, str]]) -> str:
    """``NAME:rest`` by the longest prefix (given longest first); a name that is empty stands for nothing; else the IRI in its marks."""
    for start, name in prefixes:
        if iri.startswith(start):
            return f"{name}:{iri[len(start):]}" if name else iri[len(start) :]
    return f"<{iri}>"


def parsed(line: str, prefixes: list[tuple[str, str]]) -> tuple[str | None, str | None, str | None, str | None] | None:
    """(entity, predicate, value, None), or (None, None, None, why); None for lines that say nothing."""
    bare = line.strip(" \t\r")
    if not bare or bare[0] == "#":
        return None
    m = LINE.fullmatch(bare)
    if m is None:
        return None, None, None, "ParseError"
    subject, blank, predicate, iri, node, literal, language, kind = m.groups()
    try:
        name = lambda x: short(unescaped(x), prefixes)
        value = name(iri) if iri is not None else node
        if literal is not None:
            value = unescaped(literal) + (f"@{language}" if language else f"^^{name(kind)}" if kind is not None and kind != PLAIN_TYPE else "")
            value.encode()
        return blank or name(subject), name(predicate), value, None
    except (KeyError, ValueError, OverflowError):
        return None, None, None, "ParseError"


def triples(lines: DataFrame, prefixes: dict[str, str], line: str = "line") -> DataFrame:
    """lines -> their other columns with term_id, predicate, value and error; blank lines and comments give no row.

    ``prefixes``: what an IRI starts with -> its short name. A triple that is written twice counts twice. A line may be of any length.
    """
    longest = sorted(prefixes.items(), key=lambda x: (-len(x[0]), x[0]))

    @F.arrow_udf(TRIPLE)
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = [None if x is None else parsed(x, longest) for x in b.to_pylist()]
            columns = [pa.array([None if r is None else r[k] for r in rows], pa.string()) for k in range(4)]
            yield pa.StructArray.from_arrays(columns, names=TRIPLE.names, mask=pa.array([r is None for r in rows]))

    rest = [c for c in lines.columns if c != line]
    return lines.select(*rest, read(F.col(line)).alias("t")).filter("t is not null").select(*rest, "t.*")


def version_lines(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """(commit_seq, line) of one file or folder a version, split where Spark likes."""
    out = spark.createDataFrame([], "commit_seq int, line string")
    for seq, path in paths.items():
        out = out.unionByName(spark.read.text(path).select(F.lit(seq).cast("int").alias("commit_seq"), F.col("value").alias("line")))
    return out


def state_of(found: DataFrame) -> DataFrame:
    """(term_id, commit_seq, predicate, value) of the triples that could be read."""
    return found.filter("error is null").select("term_id", "commit_seq", "predicate", "value")
