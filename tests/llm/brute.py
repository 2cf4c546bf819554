"""Plain ways to results that SQL can't say; they share no code with the operators but the rules of words and parts."""

import hashlib
import re

from strataframe.llm.decontam import OVERLAP, parts, shingles, words_of


def leaks(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> set[tuple[int, int]]:
    """(doc_id, item_id) by comparing all shingles of all texts."""
    out = set()
    for d, text in docs:
        words = words_of((text or "").encode())
        for i, item in items:
            q, a = (shingles(p) for p in parts((item or "").encode()))
            have = [sum(tuple(s) in {tuple(words[k : k + len(s)]) for k in range(len(words) - len(s) + 1)} for s in p) for p in (q, a)]
            total = len(q) + len(a)
            if total and sum(have) >= OVERLAP * total and all(h or not p for h, p in zip(have, (q, a))):
                out.add((d, i))
    return out


# What the contract says of each kind, written anew.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def secrets(text: str | None) -> tuple[int, int, int, str]:
    """Numbers and digest of the base kinds."""
    text = text or ""
    # with re.ASCII, (?i:...) folds A-Z alone
    spans = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{e}" for a, k, e in sorted(spans))
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest())
