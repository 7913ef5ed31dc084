"""Sets of hashed word shingles of whole texts, in numpy over many texts at a time.

A word is a run of bytes other than blank and tab to carriage return, A-Z
lower-cased.  Its 64-bit hash is a polynomial over random byte values, mixed
with its length; a shingle's hash is a mix of its words' hashes.  Sets are
told apart by these hashes: within one document of a million shingles two
of them collide with probability 3e-8.
"""

from __future__ import annotations

import re

import numpy as np

_RNG = np.random.default_rng(2024)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_STEP, _BACK = np.uint64(_P), np.uint64(pow(_P, -1, 1 << 64))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_IS_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_SPACE = re.compile(rb"[\x20\x09-\x0d]").search
_CHUNK = 1 << 20
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        one = np.ones(1, np.uint64)
        _powers = tuple(np.concatenate([one, np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (_STEP, _BACK))
    return _powers[0][:n], _powers[1]


def _hash_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(start, hash)`` of each word of lower-cased bytes."""
    b = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _IS_SPACE[b], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[::2], edge[1::2]
    forth, back = _power(len(b))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * forth, dtype=np.uint64)])
    return starts, _mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of one text, some at a time, cut where a word ends."""
    out, at = [], 0
    while at < len(data):
        stop = _SPACE(data, at + _CHUNK)
        stop = stop.start() if stop else len(data)
        out.append(_hash_words(data[at:stop])[1])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _set(words: np.ndarray, n: int, weights: np.ndarray) -> np.ndarray:
    if len(words) < n:
        if not len(words):
            return words
        return _mix((words * weights[:len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    k = len(words) - n + 1
    s = np.zeros(k, np.uint64)
    for j in range(n):
        s += words[j:j + k] * weights[j]
    return np.unique(_mix(s))


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of ``n`` words; a shorter text is one shingle, one without words has none."""
    weights = np.random.default_rng(n).integers(1, 1 << 62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, some, held = [], [], 0

    def flush():
        nonlocal some, held
        if some:
            firsts = np.cumsum([0, *(len(d) + 1 for d in some)])
            starts, hashes = _hash_words(b"\n".join(some))
            cuts = np.searchsorted(starts, firsts)
            out.extend(_set(hashes[a:b], n, weights) for a, b in zip(cuts, cuts[1:]))
        some, held = [], 0
    for t in texts:
        data = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if len(data) > _CHUNK:
            flush()
            out.append(_set(word_hashes(data), n, weights))
            continue
        some.append(data)
        held += len(data) + 1
        if held > _CHUNK:
            flush()
    flush()
    return out
