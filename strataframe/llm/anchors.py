"""Anchors: how windows that occur twice meet without shuffling every window.

A window of ``n`` elements (words or bytes) is named by the least of its k-gram hashes, so every copy of a
window, wherever it stands, has the same anchor at the same offset. Neighbouring windows mostly
share their anchor; the run of windows that one anchor position names, with the elements they
cover, is its context. One row per context takes the place of one row per window, which for 50
words is about a 18th and for 400 bytes about a 180th of the rows.

Anchors only say what meets; that two contexts are the same is told by a digest of their bytes (``DIGEST``, 128
bits), and which windows of different contexts are the same by comparing them. An anchor that very many different
contexts have is split by the next least k-grams of each window, as many as it takes.

Anchors are polynomials over random values of the bytes, modulo 2 ** 64, from one running sum a text, so the hash of
any stretch is a subtraction and a product. Some texts (Thue-Morse words) always collide there; as anchors
that costs a comparison. Hashes that stand for their bytes (``strict``) are taken modulo a prime besides.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
PRIME, BASE = (1 << 31) - 1, 1_313_131_313
VALUES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
SMALL_VALUES = VALUES % np.uint64(PRIME)
#: Powers are kept for the task up to this length; longer texts have theirs made anew.
KEPT = 1 << 20
LOW = np.uint64(0xFFFFFFFF)
_powers: dict[str, np.ndarray] = {}


def _made(n: int, modulo: int | None, base: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64 or a prime below 2 ** 31; by doubling."""
    out = np.ones(n, np.uint64)
    have = 1
    while have < n:
        more = min(have, n - have)
        step = np.uint64(pow(base, have, modulo or 1 << 64))
        out[have : have + more] = out[:more] * step
        if modulo:
            out[have : have + more] %= np.uint64(modulo)
        have += more
    return out


KINDS = {"up": (None, MULTIPLIER), "down": (None, INVERSE), "small": (PRIME, BASE), "under": (PRIME, pow(BASE, -1, PRIME))}


def powers(kind: str, n: int) -> np.ndarray:
    """Powers i < n of the kind's base."""
    if n > KEPT:
        return _made(n, *KINDS[kind])
    if len(_powers.get(kind, ())) < n:
        _powers[kind] = _made(1 << (n - 1).bit_length(), *KINDS[kind])
    return _powers[kind][:n]


class Hashed:
    """Hashes of stretches of a byte string."""

    def __init__(self, data: bytes, strict: bool = False):
        b = np.frombuffer(data, np.uint8)
        n = len(b)
        self.down, self.sums = powers("down", n + 1), np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[b] * powers("up", n), out=self.sums[1:])
        self.rests = None
        if strict:
            self.under, self.rests = powers("under", n + 1), np.zeros(n + 1, np.uint64)
            # below 2 ** 31 each, so the sum fits for texts of up to 2 ** 32 bytes
            np.cumsum(SMALL_VALUES[b] * powers("small", n) % np.uint64(PRIME), out=self.rests[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        if self.rests is not None:
            h ^= mixed((self.rests[end] - self.rests[start]) % np.uint64(PRIME) * self.under[start] % np.uint64(PRIME))
        return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(MIX)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX)
    return h ^ (h >> np.uint64(32))


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` successive keys, by block-wise running minima."""
    n = len(keys)
    if width == 1:
        return keys
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


DIGEST = 16


def digests(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    view = memoryview(data)
    return [blake2b(view[a:b], digest_size=DIGEST).digest() for a, b in zip(starts.tolist(), ends.tolist())]


def contexts(data: bytes, starts: np.ndarray, ends: np.ndarray, window: int, gram: int, depth: int = 1):
    """(anchors, digests, first, last): of each run of windows that share an anchor position.

    ``first`` and ``last`` are the run's first and last window, as element numbers; the digest is that of all
    bytes that the run covers. With ``depth`` a run shares the positions of so many least k-grams, and the anchor
    is made of them all and of how they lie.
    """
    n = len(starts)
    if n < window:
        return None
    grams = Hashed(data).of(starts[: n - gram + 1], ends[gram - 1 :])
    keys = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width = window - gram + 1
    if depth == 1:
        at = (sliding_least(keys, width) & LOW).astype(np.int64)
        new = at[1:] != at[:-1]
    else:
        least = np.lib.stride_tricks.sliding_window_view(keys, width)
        least = np.sort(np.partition(least, depth - 1, axis=1)[:, :depth] if depth < width else least, axis=1)
        at = (least & LOW).astype(np.int64)
        new = (at[1:] != at[:-1]).any(axis=1)
    edge = np.flatnonzero(new) + 1
    first = np.concatenate(([0], edge))
    last = np.concatenate((edge, [n - window + 1])) - 1
    if depth == 1:
        anchor = grams[at[first]]
    else:
        anchor = np.zeros(len(first), np.uint64)
        for k in range(depth):
            place = at[first, k]
            anchor = mixed(anchor * np.uint64(MULTIPLIER) + (grams[place] ^ mixed((place - at[first, 0]).astype(np.uint64))))
    return anchor.view(np.int64), digests(data, starts[first], ends[last + window - 1]), first, last
