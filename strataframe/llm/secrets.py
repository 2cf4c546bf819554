"""Secret scans: Aho-Corasick prefilter, anchored patterns at its hits, embedded checksums.

One pass over each text. The automaton finds the keywords that any match of a pattern must start
with; only there the pattern is tried, anchored at the keyword. Hex runs have no keyword: a run
is its own anchor and is found by one plain scan. Kinds that carry a checksum in the token are
reported only if it holds. No shuffle: a scan, a map and a projection.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm.common import text_of

# The patterns of the base kinds, and their least lengths.
ASSIGN = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN, MIN_ACCESS = 12, 18
#: Kinds with a checksum: a prefix, 30 characters, and the CRC32 of these in six base-62 digits.
CHECKED = r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: Lower-case keywords of the prefilter and the kind that each may start.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
KINDS = ("assign", "access", "hex", "github", "npm")
SPANS = "doc_id long, kinds array<string>, starts array<int>, ends array<int>"


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out


def scanner():
    """text -> sorted [(start, kind rank, end)]. Built once a task, as automata are costly to ship."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        automaton.add_word(word, (len(word), kind))
    automaton.make_automaton()
    assign, access, hexes, checked = (re.compile(p) for p in (ASSIGN, ACCESS, HEX, CHECKED))

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        # bytes.lower() leaves all but A-Z alone and so keeps every position
        folded = text if text.isascii() and text.islower() else text.encode().lower().decode()
        free = {"assign": 0, "access": 0}
        # by start: of two keywords at one place none is a prefix of another, so starts are distinct a kind
        for start, kind in sorted((end + 1 - n, kind) for end, (n, kind) in automaton.iter(folded)):
            if kind in free:
                if start < free[kind]:
                    continue  # inside the match before
                m = (assign if kind == "assign" else access).match(text, start)
                if m:
                    free[kind] = m.end()
                    if kind == "assign" and m.end(1) - m.start(1) >= MIN_ASSIGN:
                        found.append((start, 0, m.end()))
                    elif kind == "access" and m.end() - start >= MIN_ACCESS:
                        found.append((start, 1, m.end()))
            elif (m := checked.match(text, start)) and base62_crc(m[1]) == m[2]:
                found.append((start, KINDS.index(kind), m.end()))
        return sorted(found)

    return scan


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, kinds, starts, ends: the spans of each row, by start; code points, end exclusive.

    Null text: no spans. Rows that repeat: each its own. No rows: no rows. Extra columns are left out.
    """

    def run(batches):
        scan = scanner()
        for b in batches:
            spans = [scan(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([[KINDS[k] for _, k, _ in s] for s in spans], pa.list_(pa.string())), pa.array([[a for a, _, _ in s] for s in spans], pa.list_(pa.int32())), pa.array([[e for _, _, e in s] for s in spans], pa.list_(pa.int32()))],
                names=["doc_id", "kinds", "starts", "ends"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(run, SPANS)


def op1_secrets(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans of each row, and all spans; see ``find_secrets`` for odd rows."""
    spans = F.arrays_zip("kinds", "starts", "ends")
    base = F.filter(spans, lambda s: s["kinds"].isin("assign", "access", "hex"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kinds"], s["starts"].cast("string"), s["ends"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return find_secrets(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))
