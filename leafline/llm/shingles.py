"""Hashes of words and of word shingles for whole batches of texts, in numpy."""

from __future__ import annotations

import numpy as np

#: White space of ASCII: what bytes.split() splits at.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ROOT = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Bytes handled at once.
AT_ONCE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, by doubling."""
    out, factor = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(factor)])
        factor = factor * factor & MASK
    return out[:n]


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ROOT and of its inverse, at least n of each."""
    size = max(n, AT_ONCE + 1)
    if size not in _tables:
        _tables.clear()
        _tables[size] = powers(ROOT, size), powers(pow(ROOT, -1, 1 << 64), size)
    return _tables[size]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words (uint64), and how many words each text has."""
    data = b" ".join(texts) + b" "
    raw = np.frombuffer(data, np.uint8)
    up, down = tables(len(raw) + 1)
    white = WHITE[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], white]).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64)])
    hashes = mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(stops, begin, "right")
    return hashes, np.bincount(owner, minlength=len(texts))


def shingle_sets(texts: list[bytes], size: int = 2) -> list[np.ndarray]:
    """Each text's set of shingles of that many words, as sorted distinct hashes; all words as one shingle if it has fewer."""
    hashes, counts = word_hashes(texts)
    joined = hashes
    for k in range(1, size):
        joined = mix(joined * np.uint64(0xD6E8FEB86659FD93) + np.concatenate([hashes[k:], np.zeros(min(k, len(hashes)), np.uint64)]))
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(joined[at : at + n - size + 1]))
        elif n:
            whole = hashes[at : at + 1]
            for k in range(1, n):
                whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + hashes[at + k : at + k + 1])
            out.append(mix(whole + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def slices(texts: list, at_once: int = AT_ONCE):
    """Ranges of texts of about at_once bytes; a longer text is a range of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < at_once):
            size += len(texts[end]) + 1
            end += 1
        yield at, end
        at = end
