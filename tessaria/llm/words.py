"""Vectorised words and shingles: a word is a maximal run of a-z and 0-9 in the lower-cased text.

All texts of a part lie in one byte array; word hashes come from prefix sums of a polynomial hash modulo 2**64,
so nothing is done per word in Python.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_CLASS = np.zeros(256, dtype=bool)
_CLASS[48:58] = _CLASS[97:123] = True

#: Bytes of text worked off at once (a part holds whole texts, so one longer text makes a longer part).
PART = 1_500_000


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        p = np.ones(size, dtype=np.uint64)
        have = 1
        step = base
        while have < size:
            more = min(have, size - have)
            p[have : have + more] = p[:more] * step
            have += more
            with np.errstate(over="ignore"):
                step = step * step
        out.append(p)
    return out[0], out[1]


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up = 1 << max(21, (size - 1).bit_length())
    a, b = _powers(up)
    return a[:size], b[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps modulo 2**64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[b] - P[a] = the polynomial of data[a:b], shifted by a."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


class Words:
    """Words of several texts: byte spans, the text each belongs to, and 64-bit hashes."""

    def __init__(self, texts: list[str]) -> None:
        raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
        self.texts = len(raw)
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) + 1
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        inside = _CLASS[self.data]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]  # each text ends with a separator
        self.inside = inside
        self.text_end = np.cumsum(size) if len(raw) else np.empty(0, dtype=np.int64)
        self.text = np.searchsorted(self.text_end, self.start, side="right")

    def hashes(self) -> np.ndarray:
        p = prefix_hash(self.data)
        _, down = powers(len(self.data) + 1)
        return mix((p[self.end] - p[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.texts)


_WEIGHTS = [np.uint64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3)]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k consecutive words of one text, in order, and the text it is of."""
    h, t = words.hashes(), words.text
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total += h[i : i + n] * _WEIGHTS[i % len(_WEIGHTS)] * np.uint64(2 * i + 1)
    same = t[:n] == t[k - 1 :]
    return mix(total[same]), t[:n][same]


#: Bits of a shingle's hash that are kept where a text's number shares the word with it, and texts of a part.
HASH_BITS = 52
PART_TEXTS = 1 << (64 - HASH_BITS)
_LOW = np.uint64((1 << HASH_BITS) - 1)
_CUT = np.uint64(64 - HASH_BITS)
_UP = np.uint64(HASH_BITS)


def packed(h: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Text number (below PART_TEXTS) and the upper bits of the hash in one word, which sorts by both."""
    return (t.astype(np.uint64) << _UP) | (h >> _CUT)


def distinct_sorted(h: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, text), ordered by text and hash; of the hashes the upper HASH_BITS count."""
    k = np.sort(packed(h, t))
    if len(k):
        k = k[np.append(True, k[1:] != k[:-1])]
    return (k & _LOW) << _CUT, (k >> _UP).astype(np.int64)


def parts(sizes: np.ndarray, most: int = PART):
    """Ranges of consecutive texts with about ``most`` bytes each."""
    a, total = 0, 0
    for i, s in enumerate(sizes.tolist()):
        total += s
        if total >= most or i + 1 - a >= PART_TEXTS // 2:
            yield a, i + 1
            a, total = i + 1, 0
    if a < len(sizes):
        yield a, len(sizes)
