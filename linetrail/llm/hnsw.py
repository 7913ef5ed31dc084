"""A hierarchical navigable small-world graph of one shard's vectors, in numpy.

Vectors are inserted in order, a block at a time: each takes its most
similar earlier vectors as neighbours, of two that are closer to each other
than to it only one, and becomes a neighbour of theirs in turn.  Each level
up holds about one in ``THIN`` of the vectors.  A search walks down from the top
and moves a beam for many queries at once.
"""

from __future__ import annotations

import numpy as np

OUT, BACK, SPREAD = 14, 14, 4  # links chosen, links in return, and those of them to the earliest
THIN = 16
_NEAR = 40
_BLOCK = 256


def unit(x: np.ndarray) -> np.ndarray:
    """Vectors of length one, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _link(x: np.ndarray, members: np.ndarray) -> np.ndarray:
    """Neighbours of each vector on the level of ``members`` (ascending), -1 where there are fewer."""
    n, v = len(x), x[members]
    m = len(v)
    out = np.full((m, OUT), -1, dtype=np.int32)
    for lo in range(0, m, _BLOCK):
        hi = min(m, lo + _BLOCK)
        sims = v[lo:hi] @ v[:hi].T
        sims[np.arange(hi)[None, :] >= np.arange(lo, hi)[:, None]] = -2
        k = min(_NEAR, hi)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        value = np.take_along_axis(sims, near, 1)
        among = np.einsum("bid,bjd->bij", v[near], v[near])
        chosen = np.zeros_like(value, dtype=bool)
        for j in range(k):
            crowd = (np.where(chosen, among[:, j, :], -2) > value[:, j:j + 1]).any(1)
            chosen[:, j] = ~crowd & (value[:, j] > -2) & (chosen.sum(1) < OUT)
        # The nearest of all comes in any case, then the others in order, to fill up.
        rank = np.where(chosen, 0, 1) * k + np.arange(k)[None, :]
        rank = np.where(value > -2, rank, 3 * k)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :OUT]
        ids = np.where(np.take_along_axis(value, pick, 1) > -2, np.take_along_axis(near, pick, 1), -1)
        out[lo:hi, :ids.shape[1]] = ids
    a, b = np.repeat(np.arange(m), OUT), out.ravel()
    a, b = a[b >= 0], b[b >= 0]
    sim = np.einsum("ed,ed->e", v[a], v[b])
    back = np.full((m, BACK + SPREAD), -1, dtype=np.int32)
    for order, at, width in ((np.lexsort((-sim, b)), 0, BACK), (np.lexsort((a, b)), BACK, SPREAD)):
        src, dst = a[order], b[order]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        ok = place < width
        back[dst[ok], at + place[ok]] = src[ok]
    links = np.concatenate([out, back], axis=1)
    full = np.full((n, links.shape[1]), -1, dtype=np.int32)
    full[members] = np.where(links >= 0, members[links], -1)
    return full


class Graph:
    def __init__(self, x: np.ndarray, links: list[np.ndarray], top: np.ndarray):
        """``x``: unit vectors; ``links``: by level, the lowest first; ``top``: members of the level above all."""
        self.x64, self.x, self.links, self.top = x, x.astype(np.float32), links, top

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 0) -> Graph:
        level = np.random.default_rng(seed).geometric(1 - 1 / THIN, len(x)) - 1
        links, members, at = [], np.arange(len(x)), 0
        x32 = x.astype(np.float32)
        while True:
            links.append(_link(x32, members))
            above = members[level[members] > at]
            if len(above) <= 8:
                return cls(x, links, above if len(above) else members[:8])
            members, at = above, at + 1

    def _beam(self, q: np.ndarray, links: np.ndarray, start: np.ndarray, width: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, similarities)`` of the ``width`` best found for each query, best first, -1 and -2 where there are fewer."""
        m, n = len(q), len(self.x)
        seen = np.zeros((m, n + 1), dtype=bool)
        rows = np.arange(m)[:, None]
        k = start.shape[1]
        ids = np.full((m, max(width, k)), -1, dtype=np.int64)
        ids[:, :k] = start
        sims = np.full(ids.shape, -2, dtype=np.float32)
        sims[:, :k] = np.where(start >= 0, np.einsum("bkd,bd->bk", self.x[start], q), -2)
        seen[rows, start] = True
        done = np.zeros(ids.shape, dtype=bool)
        while True:
            todo = np.where(done | (ids < 0), -3, sims)
            pick = np.argpartition(-todo, min(step, todo.shape[1]) - 1, axis=1)[:, :step]
            ok = np.take_along_axis(todo, pick, 1) > -3
            live = ok.any(1)
            if not live.any():
                break
            done[rows, pick] = True
            go = np.flatnonzero(live)
            near = np.where(ok[go][:, :, None], links[ids[go[:, None], pick[go]]], -1).reshape(len(go), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[go[:, None], near]
            width_now = int(fresh.sum(1).max())
            if not width_now:
                continue
            front = np.argsort(~fresh, axis=1, kind="stable")[:, :width_now]
            near, fresh = np.take_along_axis(near, front, 1), np.take_along_axis(fresh, front, 1)
            near = np.where(fresh, near, -1)
            seen[go[:, None], near] = True
            new = np.where(fresh, np.einsum("bkd,bd->bk", self.x[near], q[go]), -2)
            all_ids, all_sims = np.concatenate([ids[go], near], 1), np.concatenate([sims[go], new], 1)
            all_done = np.concatenate([done[go], np.zeros(near.shape, dtype=bool)], 1)
            keep = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, :ids.shape[1]]
            ids[go], sims[go], done[go] = (np.take_along_axis(z, keep, 1) for z in (all_ids, all_sims, all_done))
        by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, by, 1), np.take_along_axis(sims, by, 1)

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q = q.astype(np.float32)
        start = np.broadcast_to(self.top[:8], (len(q), len(self.top[:8])))
        for links in self.links[:0:-1]:
            start, _ = self._beam(q, links, start, 8)
        return self._beam(q, self.links[0], start, max(8, width))

    def within(self, q: np.ndarray, least: float, width: int) -> list[np.ndarray]:
        """Places found whose cosine, in double precision, is ``least`` or more.  A beam that is full of such is
        widened, so their number has no bound."""
        out: list = [None] * len(q)
        for lo in range(0, len(q), _BLOCK):
            todo, w = np.arange(lo, min(len(q), lo + _BLOCK)), width
            while len(todo):
                ids, sims = self.search(q[todo], w)
                full = (sims[:, -1] >= least - 1e-3) & (w < len(self.x))
                for i, row, s in zip(todo[~full], ids[~full], sims[~full]):
                    out[i] = row[(row >= 0) & (s >= least - 1e-3)]
                todo, w = todo[full], 4 * w
        hits = np.repeat(np.arange(len(q)), [len(o) for o in out])
        places = np.concatenate(out) if len(out) else np.zeros(0, np.int64)
        exact = np.einsum("ed,ed->e", q[hits], self.x64[places]) >= least if len(hits) else np.zeros(0, bool)
        cut = np.searchsorted(hits[exact], np.arange(len(q) + 1))
        places = places[exact]
        return [places[a:b] for a, b in zip(cut, cut[1:])]

def pack(g: Graph) -> bytes:
    parts = [np.array([len(g.links), len(g.top), g.links[0].shape[1]], np.int32), g.top.astype(np.int32), *(x.ravel() for x in g.links)]
    return np.concatenate(parts).astype(np.int32).tobytes()


def unpack(data: bytes, x: np.ndarray) -> Graph:
    a = np.frombuffer(data, np.int32)
    levels, top, width = a[:3]
    links = a[3 + top:].reshape(levels, len(x), width)
    return Graph(x, list(links), a[3:3 + top].astype(np.int64))
