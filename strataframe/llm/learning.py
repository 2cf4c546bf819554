"""What the classifiers share: the training fold and bounded samples of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainder of crc32(doc_id as text) that is held out of all learning.
FOLDS, HELD_OUT = 3, 1


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS))


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == HELD_OUT


def sample(rows: DataFrame, at_most: int, seed: int = 0) -> DataFrame:
    """At most so many rows, those of least hash of doc_id: the same for the same table.

    A threshold on the hash, from a count, comes first, so of a table of any size only about the rows that are wanted
    are sorted. It leaves out a row too many but once in very many tables, and the limit is for that.
    """
    n = rows.count()
    if n <= at_most:
        return rows
    place = F.xxhash64("doc_id", F.lit(seed))
    share = min(1.0, (at_most + 6 * at_most**0.5 + 12) / n)
    return rows.filter(place < F.lit(int((share - 0.5) * (1 << 64) * 0.999999999)).cast("long") if share < 1 else F.lit(True)).orderBy(place, "doc_id").limit(at_most)
