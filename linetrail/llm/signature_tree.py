"""Signature trees over sets of 64-bit hashes, and their dual traversal.

A leaf is a set, as its bitmap and size; a node holds the bitwise OR of the bitmaps below it, the
range of their sizes, and the most hashes of one set that share a bit with another of
it.  Two sets have no more in common than the bits that both bitmaps have
plus those hidden behind shared bits, so a pair of nodes whose bitmaps
have too little in common for the smallest sets below, or whose size
ranges are too far apart, holds no pair similar enough.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16


def similar(common: int, a: int, b: int, percent: int) -> bool:
    return 100 * common >= percent * (a + b - common)


class Roots:
    """Union-find over places."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def all(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def bits_for(size: int) -> int:
    """Bits of a set's bitmap: four to eight for each hash."""
    return max(256, 1 << (4 * size - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    """A set's bitmap in 64-bit words: the hashes' leading bits are the places."""
    out = np.zeros(bits // 64, np.uint64)
    at = s >> np.uint64(64 - bits.bit_length() + 1)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def halved(m: np.ndarray) -> np.ndarray:
    """The bitmap of the same set with half as many bits."""
    bits = np.unpackbits(m.view(np.uint8), bitorder="little").reshape(-1, 2).any(1)
    return np.packbits(bits, bitorder="little").view(np.uint64)


class Tree:
    def __init__(self, maps: np.ndarray, size: np.ndarray):
        hidden = size - np.bitwise_count(maps).sum(1)
        # levels[0] are the leaves; (bitmaps, least size, most size, most hidden)
        self.levels = [(maps, size, size, hidden)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, h = self.levels[-1]
            cut = np.arange(0, len(m), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(m, cut, axis=0), np.minimum.reduceat(lo, cut),
                                np.maximum.reduceat(hi, cut), np.maximum.reduceat(h, cut)))

    def pairs(self, percent: int, settled):
        """Pairs of leaves that may be similar enough.  Node pairs for which ``settled(a, b)``, slices of
        leaves, holds when their turn comes are passed over."""
        stack = [(len(self.levels) - 1, 0, 0)]
        while stack:
            level, i, j = stack.pop()
            span = FANOUT ** level
            if level == 0 or settled(slice(i * span, (i + 1) * span), slice(j * span, (j + 1) * span)):
                continue
            maps, lo, hi, hidden = self.levels[level - 1]
            a = np.arange(i * FANOUT, min((i + 1) * FANOUT, len(maps)))
            b = a if i == j else np.arange(j * FANOUT, min((j + 1) * FANOUT, len(maps)))
            shared = np.bitwise_count(maps[a][:, None, :] & maps[b][None, :, :]).sum(2).astype(np.int64)
            bound = np.minimum(shared + np.minimum(hidden[a][:, None], hidden[b][None, :]), np.minimum(hi[a][:, None], hi[b][None, :]))
            ok = 100 * bound >= percent * (lo[a][:, None] + lo[b][None, :] - bound)
            ok &= (100 * hi[a][:, None] >= percent * lo[b][None, :]) & (100 * hi[b][None, :] >= percent * lo[a][:, None])
            if i == j:
                ok &= a[:, None] <= b[None, :] if level > 1 else a[:, None] < b[None, :]
            found = [(int(a[x]), int(b[y])) for x, y in zip(*np.nonzero(ok))]
            if level > 1:
                stack += [(level - 1, x, y) for x, y in reversed(found)]
            else:
                yield from found


def candidates(maps: list[np.ndarray], size: np.ndarray, sides: np.ndarray | None, percent: int = 75) -> np.ndarray:
    """Which sets have another (of another side) that may be similar enough, by bitmaps of ``bits_for`` their sizes.

    Sets similar enough have bitmaps of equal length or one twice the other's: each length is compared with itself and
    with the next, halved.
    """
    keep = np.zeros(len(maps), dtype=bool)
    width = np.array([len(m) for m in maps])
    for w in np.unique(width):
        own = np.flatnonzero((width == w) | (width == 2 * w))
        rows = np.stack([maps[i] if width[i] == w else halved(maps[i]) for i in own])
        order = np.lexsort((rows[:, 1], rows[:, 0], size[own] // 8)) if rows.shape[1] > 1 else np.arange(len(own))
        own, rows = own[order], rows[order]
        for i, j in Tree(rows, size[own]).pairs(percent, lambda a, b, o=own: keep[o[a]].all() and keep[o[b]].all()):
            if sides is None or sides[own[i]] != sides[own[j]]:
                keep[own[i]] = keep[own[j]] = True
    return keep


def links(sets: list[np.ndarray], sides: np.ndarray | None, percent: int = 75) -> list[tuple[int, int]]:
    """Verified links that connect all that is connected among ``sets``.

    Pairs that are connected already are passed over.  ``sides``: sets of one side count as connected from
    the start, so that only pairs across sides are compared.
    """
    # Similar sets side by side: by their least hashes.
    order = sorted(range(len(sets)), key=lambda i: sets[i][:4].tolist())
    sets = [sets[i] for i in order]
    bits = min(1 << 16, bits_for(max(len(s) for s in sets)))
    tree = Tree(np.stack([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets]))
    roots, found = Roots(len(sets)), []
    if sides is not None:
        first = {}
        for i, o in enumerate(order):
            roots.join(first.setdefault(sides[o], i), i)

    def settled(a, b):
        up = roots.all()
        return up[a.start] == up[b.start] and (up[a] == up[a.start]).all() and (up[b] == up[b.start]).all()
    for x, y in tree.pairs(percent, settled):
        if roots.find(x) != roots.find(y):
            common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if similar(common, len(sets[x]), len(sets[y]), percent):
                roots.join(x, y)
                found.append((order[x], order[y]))
    return found
