"""Change detection: snapshots, events and skipped rows from the presence of entities in versions.

Everything is a window or an aggregation by entity; no chunk has to be seeded with the state before it.
Windows carry a hash and a number a version. Clauses are counted (predicate, value, n) and joined back by
entity and version for the rows that changed, so an entity that holds much of a table is spread over its versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataframe.operators.stanzas import content_hash, counted_hash, expanded, is_obsolete, name_of, once_each, read, stanzas


def signed_delta(rows: DataFrame, keys: list[str], sign: str = "sign") -> DataFrame:
    """keys and operation: a row for each clause added or removed, as often as the signs don't cancel.

    Multiset difference both ways in one aggregation instead of two ``exceptAll``.
    """
    net = rows.groupBy(*keys).agg(F.sum(sign).cast("int").alias("__net")).filter("__net <> 0")
    return net.select(*keys, F.when(F.col("__net") > 0, "add").otherwise("remove").alias("operation"), F.explode(F.sequence(F.lit(1), F.abs("__net"))).alias("__n")).drop("__n")


def state_delta(state: DataFrame) -> DataFrame:
    """Events of a state table (term_id, commit_seq, predicate, value) that has a full document at each commit_seq.

    A clause of one commit and not of the one before is added, of the one before and not of this removed.
    Every commit_seq from 0 to the last must exist; entities may come and go.
    """
    last = state.agg(F.max("commit_seq")).scalar()
    keys = ["term_id", "commit_seq", "predicate", "value"]
    # the same rows count for their commit and against the next one: no second scan, no join
    both = state.select("term_id", "predicate", "value", F.explode(F.array(F.struct(F.col("commit_seq").alias("s"), F.lit(1).alias("sign")), F.struct((F.col("commit_seq") + 1).alias("s"), F.lit(-1).alias("sign")))).alias("x"))
    signed = both.select("term_id", F.col("x.s").alias("commit_seq"), "predicate", "value", F.col("x.sign").alias("sign"))
    return signed_delta(signed.filter(F.col("commit_seq") <= last), keys)


def presence_of_state(state: DataFrame) -> DataFrame:
    """(term_id, vidx, raw, ok, clauses, content_hash, error) of a state table; clauses are counted before they are gathered."""
    counted = state.groupBy("term_id", F.col("commit_seq").alias("vidx"), "predicate", "value").agg(F.count(F.lit(1)).cast("int").alias("n"))
    grouped = counted.groupBy("term_id", "vidx").agg(F.array_sort(F.collect_list(F.struct("predicate", "value", "n"))).alias("clauses"))
    hashed = grouped.withColumn("content_hash", counted_hash(F.col("clauses")))
    return hashed.select("term_id", "vidx", F.col("content_hash").alias("raw"), F.lit(True).alias("ok"), "clauses", "content_hash", F.lit(None).cast("string").alias("error"))


def episodes(presence: DataFrame) -> DataFrame:
    """presence with ``ep``, the number of the unbroken stretch of versions, and ``changed``: raw bytes differ from the version before.

    Failed rows count as present: a stretch doesn't end because a version of it can't be read.
    """
    w = Window.partitionBy("term_id").orderBy("vidx")
    gap = F.coalesce(F.col("vidx") != F.lag("vidx").over(w) + 1, F.lit(True))
    marked = presence.withColumn("__gap", gap).withColumn("__raw", F.lag("raw").over(w))
    return marked.select(
        *presence.columns,
        F.sum(F.col("__gap").cast("int")).over(w).alias("ep"),
        (F.col("__gap") | (F.col("raw") != F.col("__raw"))).alias("changed"),
    )


def good_changes(marked: DataFrame) -> DataFrame:
    """Rows whose content differs from the last good one of their stretch, with its vidx as ``before`` (null: none)."""
    w = Window.partitionBy("term_id", "ep").orderBy("vidx")
    good = marked.filter("ok and changed")
    told = good.withColumn("before", F.lag("vidx").over(w)).withColumn("__hash", F.lag("content_hash").over(w))
    return told.filter("__hash is null or __hash <> content_hash").drop("__hash")


def removals(marked: DataFrame, versions: DataFrame) -> DataFrame:
    """(term_id, vidx, before): the version of a stretch's last good clauses, at the first version after it.

    A stretch without any good row has nothing to take away; one that lasts to the end isn't over.
    """
    ended = marked.groupBy("term_id", "ep").agg(
        (F.max("vidx") + 1).alias("vidx"),
        F.max(F.when(F.col("ok") & F.col("changed"), F.col("vidx"))).alias("before"),
    )
    return ended.filter(F.col("before").isNotNull() & (F.col("vidx") <= versions.agg(F.max("vidx")).scalar())).select("term_id", "vidx", "before")


def change_tables(presence: DataFrame, versions: DataFrame, name_predicate: str = "name", obsolete: tuple[str, str] = ("is_obsolete", "true"), long_values: bool = False) -> dict[str, DataFrame]:
    """term_snapshots, events and skipped of a presence table and its versions (vidx, commit_seq, sha).

    vidx numbers the readable versions densely, so a commit whose content is missing ends no stretch. Removal
    writes events and no snapshot. ``long_values``: texts are told apart by digests (see ``text_delta``).
    """
    marked = episodes(presence.drop("clauses"))
    good = good_changes(marked)
    held = presence.filter("clauses is not null").select("term_id", F.col("vidx").alias("at"), "clauses")
    # read off before the join: where only names are asked for, no clauses are shuffled
    told = held.select("term_id", "at", name_of(F.col("clauses"), name_predicate).alias("name"), is_obsolete(F.col("clauses"), *obsolete).alias("is_obsolete"), "clauses")
    snapshots = good.withColumnRenamed("vidx", "at").join(told, ["term_id", "at"]).join(versions.withColumnRenamed("vidx", "at"), "at").select(
        "term_id", "commit_seq", "sha", "name", "is_obsolete", "content_hash", expanded(F.col("clauses")).alias("clauses")
    )
    gone = removals(marked, versions)
    sides = (
        good.select("term_id", "vidx", F.col("vidx").alias("at"), F.lit(1).alias("sign"))
        .unionByName(good.filter("before is not null").select("term_id", "vidx", F.col("before").alias("at"), F.lit(-1).alias("sign")))
        .unionByName(gone.select("term_id", "vidx", F.col("before").alias("at"), F.lit(-1).alias("sign")))
    )
    if long_values:
        events = text_delta(sides, held, versions)
    else:
        flat = sides.join(held, ["term_id", "at"]).select("term_id", "vidx", "sign", F.explode("clauses").alias("c")).select("term_id", "vidx", F.col("c.predicate").alias("predicate"), F.col("c.value").alias("value"), (F.col("sign") * F.col("c.n")).alias("sign"))
        delta = signed_delta(flat, ["term_id", "vidx", "predicate", "value"])
        events = delta.join(versions, "vidx").select("term_id", "commit_seq", "sha", "predicate", "value", "operation")
    skipped = marked.filter("changed and not ok").join(versions, "vidx").select("commit_seq", "sha", "term_id", "error")
    return {"term_snapshots": snapshots, "events": events, "skipped": skipped}


def text_delta(sides: DataFrame, held: DataFrame, versions: DataFrame) -> DataFrame:
    """``signed_delta`` of the clauses of ``sides``, with the commits of ``versions``, for values that are long texts.

    Digests (SHA-256) take their place until the events are known, and then each clause of ``held`` is shuffled once.
    """
    digest = lambda c: F.unhex(F.sha2(c, 256))
    marks = held.select("term_id", "at", F.transform("clauses", lambda c: F.struct(c["predicate"].alias("predicate"), digest(c["value"]).alias("digest"), c["n"].alias("n"))).alias("clauses"))
    flat = sides.join(marks, ["term_id", "at"]).select("term_id", "vidx", "at", "sign", F.explode("clauses").alias("c"))
    flat = flat.select("term_id", "vidx", "at", "c.predicate", "c.digest", (F.col("sign") * F.col("c.n")).alias("sign"))
    # what is added stands in the later of the two versions, what is removed in the earlier
    net = flat.groupBy("term_id", "vidx", "predicate", "digest").agg(F.sum("sign").cast("int").alias("net"), F.min("at").alias("early"), F.max("at").alias("late")).filter("net <> 0")
    told = net.join(versions, "vidx").select(
        "term_id", F.when(F.col("net") > 0, F.col("late")).otherwise(F.col("early")).alias("at"), "predicate", "digest",
        "commit_seq", "sha", F.when(F.col("net") > 0, "add").otherwise("remove").alias("operation"), F.abs("net").alias("times"),
    )
    once = F.array_distinct(F.transform("clauses", lambda c: F.struct(c["predicate"].alias("predicate"), c["value"].alias("value"))))
    texts = held.select("term_id", "at", F.explode(once).alias("c")).select("term_id", "at", "c.predicate", digest(F.col("c.value")).alias("digest"), "c.value")
    # neither side fits the driver, however small the files that hold it
    events = told.hint("merge").join(texts, ["term_id", "at", "predicate", "digest"])
    return events.select("term_id", "commit_seq", "sha", "predicate", "value", "operation", F.explode(F.sequence(F.lit(1), "times")).alias("__n")).drop("__n")


def number_readable(versions: DataFrame) -> DataFrame:
    """versions (commit_seq, sha, content) that have content, with their dense number; a window over ids and not texts."""
    ids = versions.filter("content is not null").select("commit_seq", "sha")
    if "part" in versions.columns:
        ids = ids.distinct()
    return ids.withColumn("vidx", F.row_number().over(Window.orderBy("commit_seq")) - 1)


def presence_of_documents(versions: DataFrame, numbered: DataFrame) -> DataFrame:
    """Presence of the entities of versions (commit_seq, sha, content), numbered by ``number_readable``.

    Stanza hashes are compared first, and only stanzas whose bytes changed are parsed: the
    windows carry 40 characters a stanza, not its text. Rows that didn't change have no clauses.
    A version may come in parts: rows with a column ``part`` that orders them, each of whole stanzas.
    """
    text = versions.filter("content is not null").join(numbered.select("commit_seq", "vidx"), "commit_seq").drop("commit_seq", "sha")
    found = stanzas(text)
    if "part" in versions.columns:
        found = found.withColumn("pos", F.struct("part", "pos"))
    # of repeated ids in a document the last counts
    heads = found.groupBy("term_id", "vidx").agg(F.max_by(F.struct(F.sha1("stanza").alias("raw"), F.col("pos").alias("pos")), "pos").alias("h"))
    w = Window.partitionBy("term_id").orderBy("vidx")
    seen = heads.select("term_id", "vidx", "h.raw", "h.pos")
    fresh = seen.withColumn("v0", F.lag("vidx").over(w)).withColumn("r0", F.lag("raw").over(w)).filter("v0 is null or vidx <> v0 + 1 or raw <> r0").select("term_id", "vidx", "pos")
    parsed = found.join(fresh, ["term_id", "vidx", "pos"]).select("term_id", "vidx", read(F.col("stanza"), F.col("term_id")).alias("r"))
    parsed = parsed.select("term_id", "vidx", "r.error", F.when(F.col("r.error").isNull(), F.col("r.clauses")).alias("clauses"))
    return seen.join(parsed, ["term_id", "vidx"], "left").select(
        "term_id", "vidx", "raw", F.col("error").isNull().alias("ok"), once_each(F.col("clauses")).alias("clauses"), content_hash(F.col("clauses")).alias("content_hash"), "error"
    )


def missing_content(versions: DataFrame) -> DataFrame:
    """A skipped row for each version without content, also where it comes in parts."""
    gone = versions.filter("content is null").select("commit_seq", "sha")
    return (gone.distinct() if "part" in versions.columns else gone).select("commit_seq", "sha", F.lit(None).cast("string").alias("term_id"), F.lit("BlobMissing").alias("error"))


def build(versions: DataFrame, keep=lambda presence: presence) -> dict[str, DataFrame]:
    """The change tables of versions (commit_seq int, sha string, content string; null content: missing), whole or in parts.

    ``keep`` may write the presence table and give it back, so that the tables don't each work it out.
    """
    numbered = number_readable(versions)
    out = change_tables(keep(presence_of_documents(versions, numbered)), numbered)
    out["skipped"] = out["skipped"].unionByName(missing_content(versions))
    return out


def change_rows(versions: DataFrame) -> DataFrame:
    """CHANGES of versions (commit_seq, sha, content; whole or in parts, null content: missing)."""
    numbered = number_readable(versions)
    found = stanzas(versions.filter("content is not null").join(numbered.select("commit_seq", "vidx"), "commit_seq").drop("sha"))
    found = found.withColumn("place", F.struct("part", "pos") if "part" in versions.columns else F.struct("pos")).withColumn("raw", F.sha1("stanza"))
    last = found.groupBy("term_id", "vidx").agg(F.max_by(F.struct("raw", "place"), "place").alias("h")).select("term_id", "vidx", "h.raw", "h.place")
    w = Window.partitionBy("term_id").orderBy("vidx")
    near = last.select("*", F.lag("vidx").over(w).alias("v0"), F.lag("raw").over(w).alias("r0"), F.lead("vidx").over(w).alias("v1"))
    fresh = near.filter("v0 is null or vidx <> v0 + 1 or raw <> r0").select("term_id", "vidx", "place")
    top = numbered.agg(F.max("vidx")).scalar()
    none = lambda kind: F.lit(None).cast(kind)
    gone = near.filter((F.col("v1").isNull() | (F.col("v1") != F.col("vidx") + 1)) & (F.col("vidx") < top)).select("term_id", (F.col("vidx") + 1).alias("vidx"), none("string").alias("raw"), none("string").alias("stanza"))
    kept = found.join(fresh, ["term_id", "vidx", "place"]).select("term_id", "vidx", "raw", "stanza").unionByName(gone)
    rows = kept.join(numbered, "vidx").select("commit_seq", "sha", "term_id", F.when(F.col("raw").isNotNull(), 0).alias("pos"), "raw", "stanza")
    lost = versions.filter("content is null").select("commit_seq", "sha").distinct()
    return rows.unionByName(lost.select("commit_seq", "sha", none("string").alias("term_id"), none("int").alias("pos"), none("string").alias("raw"), none("string").alias("stanza")))


def tables_of_changes(rows: DataFrame, keep=lambda parsed: parsed, name_predicate: str = "name", obsolete: tuple[str, str] = ("is_obsolete", "true")) -> dict[str, DataFrame]:
    """term_snapshots, events and skipped out of CHANGES: work and rows follow what changed, not the number of entities a version has.

    ``keep`` may write what was parsed and give it back, so that the tables don't each read the stanzas.
    """
    axis = rows.select("commit_seq", "sha").distinct()
    own = rows.filter("term_id is not null").groupBy("term_id", "commit_seq").agg(F.max_by(F.struct("raw", "stanza"), F.coalesce("pos", F.lit(-1))).alias("x")).select("term_id", "commit_seq", "x.*")
    parsed = own.select("term_id", "commit_seq", "raw", F.when(F.col("raw").isNotNull(), read(F.col("stanza"), F.col("term_id"))).alias("r"))
    clauses = F.when(F.col("raw").isNotNull() & F.col("r.error").isNull(), F.col("r.clauses"))
    held = keep(parsed.select("term_id", "commit_seq", "raw", "r.error", clauses.alias("clauses"), content_hash(clauses).alias("content_hash")))
    w = Window.partitionBy("term_id").orderBy("commit_seq")
    # a row that says gone ends its stretch
    ended = F.coalesce(F.sum(F.col("raw").isNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = held.drop("clauses").withColumn("ep", ended)
    stretch = Window.partitionBy("term_id", "ep").orderBy("commit_seq")
    told = told.withColumn("same", F.coalesce(F.lag("raw").over(stretch) == F.col("raw"), F.lit(False))).filter("not same").drop("same")
    good = told.filter("content_hash is not null").select("*", F.lag("commit_seq").over(stretch).alias("before"), F.lag("content_hash").over(stretch).alias("hash0")).filter("hash0 is null or hash0 <> content_hash")
    last = good.groupBy("term_id", "ep").agg(F.max("commit_seq").alias("before"))
    gone = told.filter("raw is null").join(last, ["term_id", "ep"]).select("term_id", "commit_seq", "before")
    known = held.filter("clauses is not null").select("term_id", F.col("commit_seq").alias("at"), "clauses")
    with_sha = lambda df: df.join(axis, "commit_seq")
    snapshots = good.withColumn("at", F.col("commit_seq")).join(known, ["term_id", "at"])
    snapshots = with_sha(snapshots).select("term_id", "commit_seq", "sha", name_of(F.col("clauses"), name_predicate).alias("name"), is_obsolete(F.col("clauses"), *obsolete).alias("is_obsolete"), "content_hash", "clauses")
    side = lambda df, at, sign: df.select("term_id", "commit_seq", F.col(at).alias("at"), F.lit(sign).alias("sign"))
    sides = side(good, "commit_seq", 1).unionByName(side(good.filter("before is not null"), "before", -1)).unionByName(side(gone, "before", -1))
    flat = sides.join(known, ["term_id", "at"]).select("term_id", "commit_seq", "sign", F.explode("clauses").alias("c")).select("term_id", "commit_seq", "c.predicate", "c.value", "sign")
    events = with_sha(signed_delta(flat, ["term_id", "commit_seq", "predicate", "value"])).select("term_id", "commit_seq", "sha", "predicate", "value", "operation")
    skipped = with_sha(told.filter("error is not null")).select("commit_seq", "sha", "term_id", "error")
    lost = rows.filter("term_id is null").select("commit_seq", "sha", F.lit(None).cast("string").alias("term_id"), F.lit("BlobMissing").alias("error"))
    return {"term_snapshots": snapshots, "events": events, "skipped": skipped.unionByName(lost)}


HEADS = "term_id string, vidx int, raw string, ok boolean, clauses array<struct<predicate:string,value:string>>, content_hash string"


def heads_of(presence: DataFrame, last: int) -> DataFrame:
    """What a later build has to know of the entities present in version ``last``: raw hash, whether it could be read, last good clauses."""
    marked = episodes(presence.drop("clauses"))
    good = F.when(F.col("ok") & F.col("changed"), F.struct(F.col("vidx").alias("at"), "content_hash"))
    by_stretch = marked.groupBy("term_id", "ep").agg(F.max("vidx").alias("vidx"), F.max_by(F.struct("raw", "ok"), "vidx").alias("r"), F.max(good).alias("g"))
    held = presence.filter("clauses is not null").select("term_id", F.col("vidx").alias("at"), "clauses")
    heads = by_stretch.filter(F.col("vidx") == last).select("term_id", "vidx", "r.raw", "r.ok", "g.at", "g.content_hash").join(held, ["term_id", "at"], "left")
    return heads.select("term_id", "vidx", "raw", "ok", expanded(F.col("clauses")).alias("clauses"), "content_hash")


def seeded(presence: DataFrame, heads: DataFrame) -> DataFrame:
    """presence of new versions, with rows before them that carry on the stretches of ``heads``.

    A head gives the row of the last version; where that couldn't be read, a row before it
    holds the last good clauses.
    """
    none = F.lit(None).cast("string").alias("error")
    heads = heads.withColumn("clauses", once_each(F.col("clauses")))
    last = heads.select("term_id", "vidx", "raw", "ok", "clauses", "content_hash", none)
    failed = heads.filter("not ok and clauses is not null").select("term_id", (F.col("vidx") - 1).alias("vidx"), F.lit("seed").alias("raw"), F.lit(True).alias("ok"), "clauses", "content_hash", none)
    return presence.unionByName(last).unionByName(failed)


def last_versions(versions: DataFrame, n: int) -> DataFrame:
    """The window of the last n commits; their numbers stay."""
    keep = versions.select("commit_seq").orderBy(F.desc("commit_seq")).limit(n)
    return versions.join(keep, "commit_seq", "left_semi")
