"""The vectorised kernel of replaced lines (O29), run inside Spark tasks (mapInArrow).

Of two texts within distance t, the longer than t one cut into t + 1 segments, one segment stands unchanged in the
other, so near its own place that on either side of it no more than the edits left for that side shift it.  So each text offers,
for each length that the cut one may have, the few pieces that can be such a segment; texts that meet by a piece's hash are
compared by their edit distance, which decides.  The module is shipped to executors by value.
"""

from pyspark import cloudpickle as _cp
import sys as _sys

# Lines that are compared at once, if they are not of one group; pairs that are; steps between looks at which pairs are still near.
GROUP_LINES, PAIRS, STEPS = 30_000, 1 << 17, 8
# Odd multipliers: of hashes by place, of what meets.
_BASE, _MEET = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407)


def similar_kernel(t):
    """mapInArrow function for rows ``_h, _s, is_new, k, text`` whose groups ``_h, _s`` follow one another: ``_h, k`` of the new
    lines within distance ``t`` of an old one of their group.  A group may reach over any number of batches."""
    return lambda batches: _similar(batches, t)


def _similar(batches, t):
    import numpy as np
    import pyarrow as pa

    held, lines, most = [], 0, GROUP_LINES
    for rb in batches:
        if not rb.num_rows:
            continue
        held.append(rb)
        lines += rb.num_rows
        if lines < most:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        begin = int(_begins(np, table)[-1])  # the last group may go on in the next batch
        if begin:
            yield _found(np, pa, table.slice(0, begin), t)
        held, lines = table.slice(begin).to_batches(), lines - begin
        most = max(GROUP_LINES, 2 * lines)
    if held:
        yield _found(np, pa, pa.Table.from_batches(held), t)


def _begins(np, table):
    h, s = (table.column(c).to_numpy() for c in ("_h", "_s"))
    return np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])]))


def _found(np, pa, table, t):
    group = np.zeros(table.num_rows, np.int64)
    group[_begins(np, table)[1:]] = 1
    group = np.cumsum(group)
    new = table.column("is_new").to_numpy(zero_copy_only=False).astype(bool)
    text = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks]).dictionary_encode()
    code, words = text.indices.to_numpy().astype(np.int64), _Words(np, pa, text.dictionary)
    # Each text once for a side of a group.
    each, of = np.unique((group * 2 + new) * max(1, len(words.size)) + code, return_inverse=True)
    side, code = np.divmod(each, max(1, len(words.size)))
    group, is_new, size = side >> 1, (side & 1).astype(bool), words.size[code]
    near, short = np.zeros(len(each), bool), size <= t
    # Texts of up to t characters have too few for t + 1 segments: two of them are near, and with a longer text the longer one is cut.
    near[is_new & short & np.isin(group, group[~is_new & short])] = True
    olds, news = np.flatnonzero(~is_new & ~short), np.flatnonzero(is_new & ~near)
    for a, b in _meetings(np, words, group, code, size, olds, news, t, near):
        near[b[_within(np, words, code[a], code[b], t)]] = True
    olds, news = np.flatnonzero(~is_new & short), np.flatnonzero(is_new & ~short & ~near)
    for a, b in _meetings(np, words, group, code, size, news, olds, t, near):
        near[a[_within(np, words, code[a], code[b], t)]] = True
    hits = new & near[of]
    return pa.RecordBatch.from_arrays([pa.array(table.column(c).to_numpy()[hits]) for c in ("_h", "k")], names=["_h", "k"])


class _Words:
    """Distinct texts as characters one behind another, and the sums that hashes of their pieces come from."""

    def __init__(self, np, pa, texts):
        raw = texts.cast(pa.large_binary())
        ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
        # A character is the number that its UTF-8 bytes make.
        first = (data & 0xC0) != 0x80
        at = np.flatnonzero(first)
        wide = np.diff(np.append(at, len(data)))
        chars = data[at].astype(np.uint32)
        for i in (1, 2, 3):
            more = wide > i
            chars[more] = (chars[more] << 8) | data[at[more] + i]
        before = np.concatenate([[0], np.cumsum(first)])
        self.begin = before[ends - ends[0]].astype(np.int64)
        self.size = np.diff(self.begin)
        self.begin, self.chars = self.begin[:-1], chars
        power = np.full(len(chars) + 1, _BASE, np.uint64)
        back = np.full(len(chars) + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.multiply.accumulate(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[:-1], dtype=np.uint64)])

    def piece(self, at, size):
        """A hash of the ``size`` characters from ``at``."""
        return (self.sums[at + size] - self.sums[at]) * self.back[at]


def _segment(n, i, t):
    """Begin and size of segment i of texts of n characters in t + 1 pieces of nearly equal length, the longer ones last."""
    short = (t + 1) - n % (t + 1)
    return i * (n // (t + 1)) + (i - short).clip(0), n // (t + 1) + (i >= short)


def _meetings(np, words, group, code, size, cut, other, t, near):
    """Pairs of one of ``cut`` and one of ``other`` of the same group that may be within distance ``t``, PAIRS or so at a time;
    those of which one was found ``near`` in the meantime are left out."""
    if not len(cut) or not len(other):
        return
    m1, m2, m3 = (np.uint64(x) for x in _MEET[:3])

    def meet(g, n, i, piece):
        return piece * m1 + g.astype(np.uint64) * m2 + n.astype(np.uint64) * m3 + np.uint64(i * _MEET[3] % (1 << 64))
    table = []
    for i in range(t + 1):
        begin, long = _segment(size[cut], i, t)
        keys = meet(group[cut], size[cut], i, words.piece(words.begin[code[cut]] + begin, long))
        order = np.argsort(keys)
        table.append((keys[order], cut[order]))
    for shift in sorted(range(-t, t + 1), key=abs):
        for i in range(t + 1):
            keys, whose = table[i]
            for moved in sorted(range(max(-i, shift - (t - i)), min(i, shift + (t - i)) + 1), key=abs):
                own = other[~near[other]]
                n = size[own] - shift
                own, n = own[n > t], n[n > t]
                begin, long = _segment(n, i, t)
                at = begin + moved
                fits = (at >= 0) & (at + long <= size[own])
                own, n, at, long = own[fits], n[fits], at[fits], long[fits]
                wanted = meet(group[own], n, i, words.piece(words.begin[code[own]] + at, long))
                low = np.searchsorted(keys, wanted, "left")
                count = np.searchsorted(keys, wanted, "right") - low
                own, low, count = own[count > 0], low[count > 0], count[count > 0]
                ends, done = np.cumsum(count), 0
                while done < len(own):
                    upto = max(done + 1, int(np.searchsorted(ends, ends[done] - count[done] + PAIRS, "right")))
                    c = count[done:upto]
                    b = np.repeat(own[done:upto], c)
                    a = whose[np.repeat(low[done:upto] - (np.cumsum(c) - c), c) + np.arange(len(b))]
                    done = upto
                    same = (group[a] == group[b]) & (size[a] + shift == size[b]) & ~near[a] & ~near[b]
                    a, b = a[same], b[same]
                    for first in range(0, len(a), PAIRS):  # one text may meet more
                        yield a[first:first + PAIRS], b[first:first + PAIRS]


def _within(np, words, a, b, t):
    """Which pairs of texts, whose lengths differ by ``t`` at most, are within edit distance ``t``: the diagonals around the main
    one, character by character, for all pairs at once; pairs that have left the distance behind drop out."""
    out = np.zeros(len(a), bool)
    size = words.size[a]
    order = np.argsort(-size, kind="stable")
    size, last = size[order], (words.size[b] - words.size[a])[order] + t
    chars = np.concatenate([np.zeros(t + 1, np.uint32), words.chars, np.zeros(2 * t + 2, np.uint32)])
    a, b = words.begin[a[order]] + t + 1, words.begin[b[order]] + t + 1
    away, d = 4 * t + 2 * STEPS + 9, np.arange(-t, t + 1)
    cur = np.repeat(np.where(d < 0, away, d).astype(np.int32 if t > 4000 else np.int16)[:, None], len(a), axis=1)
    by = np.stack([chars[b + x] for x in range(-t, t + 1)]) if len(a) else np.zeros((2 * t + 1, 0), np.uint32)
    i = 0
    while len(size):
        i += 1
        if i > 1:
            by = np.concatenate([by[1:], chars[b + (i - 1 + t)][None]])
        nxt = cur + (by != chars[a + (i - 1)])
        np.minimum(nxt[:-1], cur[1:] + 1, out=nxt[:-1])
        if i <= t:
            nxt[:t - i] = away
            nxt[t - i] = i
        for x in range(1, 2 * t + 1):
            np.minimum(nxt[x], nxt[x - 1] + 1, out=nxt[x])
        cur = nxt
        left = int(np.searchsorted(-size, -i, "left"))  # those that go on
        if left < len(size):
            out[order[left:]] = cur[last[left:], np.arange(left, len(size))] <= t
        keep = slice(0, left) if i % STEPS else np.flatnonzero(cur[:, :left].min(axis=0) <= t)
        if left < len(size) or not i % STEPS:
            size, last, order, a, b, cur, by = size[keep], last[keep], order[keep], a[keep], b[keep], cur[:, keep], by[:, keep]
    return out


_cp.register_pickle_by_value(_sys.modules[__name__])
