"""The vectorised kernel of line history, run inside Spark tasks (mapInArrow).

Spark partitions, shuffles and sorts the work; this only walks over the rows
of a partition in order.  The module is shipped to executors by value, so
workers need no installed copy of the package.
"""

from pyspark import cloudpickle as _cp
import sys as _sys

# Traced lines per output batch (bounds the memory of one output batch).
FLUSH_LINES = 32768


def trace_kernel(key):
    """mapInArrow function for rows sorted by ``key``, ``_blk``, then the block's own row (``_kind`` 1), then
    its hunks (2), newest first.  A row of ``_kind`` 0 before them says that a new block begins; one without a row of its own is idle.

    The block's row brings the lines to trace, ``_first`` to ``_last`` or the
    list ``_want``, and the file's length ``_n``.  Lines that stand next to each other move as one run until a hunk
    cuts it, so a hunk costs what the runs cost, however many lines they have; a
    hunk is dropped as soon as it is applied, so a file's history may have
    any length.  Output is flushed every FLUSH_LINES lines.
    """
    return lambda batches: _trace(batches, key)


def _trace(batches, key):
    import numpy as np
    import pyarrow as pa

    out, block = _Out(key, np, pa), None
    for rb in batches:
        n = rb.num_rows
        if not n:
            continue
        col = {c: rb.column(c) for c in rb.schema.names}
        kind, s, o, added = (col[c].fill_null(0).to_numpy(zero_copy_only=False).tolist() for c in ("_kind", "s", "o", "n"))
        rep_all, ov = (col[c].fill_null(False).to_pylist() for c in ("rep_all", "ov"))
        heads = [i for i, x in enumerate(kind) if x < 2]
        cuts = [0, *heads, n] if not heads or heads[0] else [*heads, n]
        hits = []  # rows of this batch whose commit some line keeps
        for lo, hi in zip(cuts, cuts[1:]):
            at = lo
            if kind[lo] < 2:
                if block is not None:
                    out.add(block)
                    block = None
                    if out.lines >= FLUSH_LINES:
                        out.keep(col, hits)
                        hits = []
                        yield out.batch()
            if kind[lo] == 1:
                want = col["_want"][lo].as_py()
                lines = np.arange(col["_first"][lo].as_py(), col["_last"][lo].as_py() + 1) if want is None else np.array(want, dtype=np.int64)
                block = _Block([col[k][lo].as_py() for k in key], lines, col["_n"][lo].as_py(), np)
                at = lo + 1
            if block is None:
                continue
            for j in range(at, hi):
                if not block.live:
                    break
                block.step(s[j], o[j], added[j], rep_all[j], col["rep"], j, ov[j], out, hits)
        out.keep(col, hits)
    if block is not None:
        out.add(block)
    if out.lines:
        yield out.batch()


class _Block:
    """Lines of one block on their way back, as runs of neighbouring lines.

    Run i stands at the places ``q[i] ... q[i] + size[i] - 1``, ascending and apart; ``own[i]`` has the block's line
    at ``q[i]`` (the next lines stand behind it), or several such lines where a surplus added line took the history of the line
    that sat in its place: from there on they move as one.  Hunks are named by their number in the output's pool."""

    def __init__(self, key, lines, length, np):
        self.key, self.lines, self.length, self.np = key, lines, length, np
        first = np.flatnonzero(np.diff(lines, prepend=lines[0] - 2) != 1) if len(lines) else np.zeros(0, np.int64)
        self.m = len(first)
        self.q = np.concatenate([lines[first].astype(np.int64), np.zeros(len(first) + 64, np.int64)])
        self.size = np.diff(np.append(first, len(lines))).tolist()
        self.own = [(x,) for x in first.tolist()]
        self.live, self.hits = self.m > 0, []

    def _put(self, i, j, runs):
        """``runs`` of (q, size, own) in the place of runs i to j - 1."""
        m, more = self.m, len(runs) - (j - i)
        if m + more > len(self.q):
            self.q = self.np.concatenate([self.q, self.np.zeros(len(self.q) + more, self.np.int64)])
        if more:
            self.q[j + more:m + more] = self.q[j:m].copy()
        for x, r in enumerate(runs):
            self.q[i + x] = r[0]
        self.size[i:j] = [r[1] for r in runs]
        self.own[i:j] = [r[2] for r in runs]
        self.m = m + more

    def _cut(self, p):
        """The number of the first run from place ``p`` on; no run reaches over it."""
        i = int(self.q[:self.m].searchsorted(p))
        if i:
            q, size = int(self.q[i - 1]), self.size[i - 1]
            if q + size > p:
                left = p - q
                own = self.own[i - 1]
                self._put(i - 1, i, [(q, left, own), (p, size - left, tuple(a + left for a in own))])
        return i

    def step(self, s, o, n, rep_all, rep_col, j, ov, out, hits):
        """One hunk back.  ``length`` is the file's length before it from here on."""
        self.length -= n - o
        if n == 0:
            i = self._cut(s + 1)
            self.q[i:self.m] += o
            return
        i = self._cut(s)
        e = self._cut(s + n)
        if n != o:
            self.q[e:self.m] -= n - o
        if e == i:
            return
        hunk = out.pool + len(hits)
        hits.append(j)
        inside = list(zip(self.q[i:e].tolist(), self.size[i:e], self.own[i:e]))
        for q, size, own in inside:
            for a in own:
                self.hits.append((a, size, q - s, hunk))
        last = min(self.length, s + n - 1 if ov else s + o - 1)  # of the places whose lines go on
        if not o:
            kept = []
        elif rep_all:
            kept = [(s, last)]
        else:
            kept = [(a, min(b, last)) for a, b in _stretches(s, n, rep_col[j].as_py() or [])]
        stay = []
        for a, b in kept:
            for q, size, own in inside:
                x, y = max(q, a), min(q + size - 1, b)
                if x <= y:
                    stay.append((x, y - x + 1, own if x == q else tuple(v + x - q for v in own)))
        # Surplus lines may stand where later lines come to stand now: these runs become one.
        f = e
        if stay and e < self.m and stay[-1][0] + stay[-1][1] > self.q[e]:
            f = e + int(self.q[e:self.m].searchsorted(stay[-1][0] + stay[-1][1]))
            stay = _merged(stay + list(zip(self.q[e:f].tolist(), self.size[e:f], self.own[e:f])))
        self._put(i, f, stay)
        self.live = self.m > 0


def _stretches(s, n, ks):
    """Runs of neighbouring places of the added lines ``ks``."""
    out = []
    for k in sorted({k for k in ks if 0 <= k < n}):
        if out and out[-1][1] == s + k - 1:
            out[-1] = (out[-1][0], s + k)
        else:
            out.append((s + k, s + k))
    return out


def _merged(runs):
    """Overlapping runs cut at each other's ends, and those of the same places made one."""
    ends = sorted({x for q, size, _ in runs for x in (q, q + size)})
    at = {}
    for q, size, own in runs:
        for a, b in zip(ends, ends[1:]):
            if q <= a and b <= q + size:
                at.setdefault((a, b), []).extend(v + a - q for v in own)
    return [(a, b - a, tuple(own)) for (a, b), own in sorted(at.items())]


def _spread(np, starts, sizes):
    """``starts[i], starts[i] + 1, ...``, ``sizes[i]`` of them, for each i."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


class _Out:
    """Finished blocks, and the commits of the hunks that their lines keep."""

    def __init__(self, key, np, pa):
        self.key, self.np, self.pa = key, np, pa
        self.pool, self.commits, self.numbers = 0, [], []
        self.blocks, self.lines = [], 0

    def keep(self, col, hits):
        if hits or not self.commits:
            rows = self.pa.array(hits, self.pa.int64())
            self.commits.append(col["c"].take(rows))
            self.numbers.append(col["hunk_no"].take(rows))
            self.pool += len(hits)

    def add(self, block):
        self.blocks.append(block)
        self.lines += len(block.lines)

    def batch(self):
        np, pa = self.np, self.pa
        total, base = self.lines, 0
        hits, left = [np.zeros((0, 4), np.int64)], [np.zeros((0, 3), np.int64)]
        lines = np.concatenate([b.lines for b in self.blocks]).astype(np.int64)
        q, alive = -lines, np.zeros(total, bool)  # a line that ends on the way has no place: negative, and not all the same
        for b in self.blocks:
            if b.hits:
                hits.append(np.array(b.hits, np.int64) + [base, 0, 0, 0])
            if b.m:
                left.append(np.array([(a + base, q, size) for q, size, own in zip(b.q[:b.m].tolist(), b.size, b.own) for a in own], np.int64))
            base += len(b.lines)
        at, places, sizes = np.concatenate(left).T
        rows = _spread(np, at, sizes)
        alive[rows] = True
        q[rows] = _spread(np, places, sizes)
        # Hunks came newest first; each line wants them oldest first.
        starts, sizes, places, hunks = np.concatenate(hits)[::-1].T
        line, k, hunk = _spread(np, starts, sizes), _spread(np, places, sizes), np.repeat(hunks, sizes)
        order = np.argsort(line, kind="stable")
        k, hunk = k[order], hunk[order]
        counts = np.bincount(line, minlength=total)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        none = counts == 0
        newest = np.where(none, 0, offsets[1:] - 1)
        if not len(k):
            k, hunk = np.zeros(1, np.int64), np.zeros(1, np.int64)
        commits, numbers = pa.concat_arrays(self.commits), pa.concat_arrays(self.numbers)
        first = pa.array(hunk[newest], mask=none)
        owner = pa.array(np.repeat(np.arange(len(self.blocks)), [len(b.lines) for b in self.blocks]))
        columns = [pa.array([b.key[i] for b in self.blocks], pa.string()).take(owner) for i in range(len(self.key))]
        columns += [
            pa.array(lines), pa.array(q), pa.array(alive),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), commits.take(pa.array(hunk[:offsets[-1]]))),
            commits.take(first), numbers.take(first), pa.array(k[newest].astype(np.int32), mask=none)]
        self.blocks, self.lines, self.pool, self.commits, self.numbers = [], 0, 0, [], []  # no block is in hand
        return pa.RecordBatch.from_arrays(columns, names=[*self.key, "line_no", "q", "alive", "commit_ids", "_hc", "_hn", "_hk"])


_cp.register_pickle_by_value(_sys.modules[__name__])
