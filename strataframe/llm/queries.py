"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from strataframe.llm import decontam, exact, lines, mixing, pii, quality, repair, secrets, simhash, substrings, suffixes, toxicity, trie
from strataframe.llm.common import table


def _conversations(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "conversations"))


def _documents(f):
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secrets": _documents(secrets.op1_secrets),
    "op2_simhash": _documents(simhash.op2_simhash),
    "op3_lines": _documents(lines.op3_lines),
    "op4_substrings": _documents(substrings.op4_substrings),
    "op5_quality": quality.op5_quality,
    "op6_mixing": _documents(mixing.op6_mixing),
    "op7_suffixes": _documents(suffixes.op7_suffixes),
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontam": decontam.op9_decontam,
    "op10_exact": _documents(exact.op10_exact),
    "op11_repair": _conversations(repair.op11_repair),
    "op12_trie": _conversations(trie.op12_trie),
    "op13_pii": _documents(pii.op13_pii),
}
ORACLES = {
    "op3_lines": lines.ORACLE,
    "op4_substrings": substrings.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_suffixes": suffixes.ORACLE,
    "op10_exact": exact.ORACLE,
    "op11_repair": repair.ORACLE,
    "op12_trie": trie.ORACLE,
}
