"""Appending to a history with a state for each entity.

The stream brings CHANGES. Each entity's state is what was good last: its clauses, and the digest of its bytes. It lies in
RocksDB, changes only for the entities that a batch touches, and outlives executors with the stream's checkpoint. So a batch's work and
what it writes follow its changes, not the number of entities nor the length of the history.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from strataframe.functions.reader import Reader
from strataframe.schemas import CLAUSE

MADE = f"kind string, term_id string, commit_seq int, sha string, predicate string, value string, operation string, name string, is_obsolete boolean, content_hash string, clauses array<{CLAUSE}>, error string"
COLUMNS = [x.split()[0] for x in MADE.split(", ")]
TABLES = {
    "events": ("term_id", "commit_seq", "sha", "predicate", "value", "operation"),
    "term_snapshots": ("term_id", "commit_seq", "sha", "name", "is_obsolete", "content_hash", "clauses"),
    "skipped": ("commit_seq", "sha", "term_id", "error"),
}
STATE = "raw string, content_hash string, predicates array<string>, values array<string>"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Entity(StatefulProcessor):
    """One entity's versions, in order of commits: what each adds, takes away and leaves unread."""

    def __init__(self, name_predicate: str = "name", obsolete: tuple[str, str] = ("is_obsolete", "true")):
        self.name_predicate, self.obsolete = name_predicate, tuple(obsolete)

    def init(self, handle) -> None:
        self.held, self.reader = handle.getValueState("held", STATE), Reader()

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timers):
        term_id, out, by_seq = key[0], [], {}
        for p in rows:
            for seq, sha, pos, raw, stanza in zip(p["commit_seq"], p["sha"], p["pos"], p["raw"], p["stanza"]):
                pos, raw = -1 if pd.isna(pos) else int(pos), None if pd.isna(raw) else raw
                if seq not in by_seq or by_seq[seq][1] < pos:
                    by_seq[int(seq)] = sha, pos, raw, stanza
        if term_id is None:
            out = [{"kind": "skipped", "commit_seq": seq, "sha": x[0], "error": "BlobMissing"} for seq, x in by_seq.items()]
        else:
            raw, digest, clauses = None, None, None
            if self.held.exists():
                raw, digest, predicates, values = self.held.get()
                clauses = None if digest is None else list(zip(predicates, values))
            for seq in sorted(by_seq):
                sha, _, new, stanza = by_seq[seq]
                one = {"term_id": term_id, "commit_seq": seq, "sha": sha}
                if new is None:
                    out += self._delta(one, clauses or [], [])
                    raw = digest = clauses = None
                elif new != raw:
                    raw = new
                    found, error = self.reader.stanza(stanza, term_id)
                    if error:
                        out.append(one | {"kind": "skipped", "error": error})
                        continue
                    hashed = hashlib.sha1("".join(f"{p}\0{v}\0" for p, v in found).encode()).hexdigest()
                    if hashed != digest:
                        out += self._delta(one, clauses or [], found)
                        out.append(one | {"kind": "term_snapshots", **self._derived(found), "content_hash": hashed, "clauses": [{"predicate": p, "value": v} for p, v in found]})
                        digest, clauses = hashed, found
            if raw is None:
                self.held.clear()
            else:
                self.held.update((raw, digest, [p for p, _ in clauses or []], [v for _, v in clauses or []]))
        if out:
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in out], dtype=object) for c in COLUMNS})  # null stays null, not a number

    @staticmethod
    def _delta(one, before, after):
        old, new = Counter(before), Counter(after)
        sides = ((new - old, "add"), (old - new, "remove"))
        return [one | {"kind": "events", "predicate": p, "value": v, "operation": what} for more, what in sides for p, v in more.elements()]

    def _derived(self, clauses):
        return {"name": next((v for p, v in clauses if p == self.name_predicate), None), "is_obsolete": self.obsolete in clauses}


def keyed_stream(changes: DataFrame, root: str, checkpoint: str, **flags):
    """Start the stream of CHANGES into the tables below ``root``, a folder a batch; it ends when what is there has been built.

    A batch that is done again replaces its folders.
    """
    spark = changes.sparkSession
    spark.conf.set(STORE, ROCKS)
    made = changes.select("term_id", "commit_seq", "sha", "pos", "raw", "stanza").groupBy("term_id").transformWithStateInPandas(Entity(**flags), MADE, "Append", "None")

    def write(df: DataFrame, n: int) -> None:
        held = df.persist()
        try:
            for name, columns in TABLES.items():
                held.filter(F.col("kind") == name).select(*columns).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/batch={n}")
        finally:
            held.unpersist()

    return made.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
