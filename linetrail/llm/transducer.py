"""Minimal acyclic transducers: sorted terms to their ordinals, in numpy arrays."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


class _State:
    __slots__ = ("final", "next", "count", "number")

    def __init__(self):
        self.final, self.next, self.count, self.number = False, {}, 0, -1

    def key(self):
        return self.final, tuple((b, id(s)) for b, s in self.next.items())


@dataclass
class Transducer:
    """States are numbers, the start is 0.  A transition is one entry of the sorted ``codes`` (state * 256 + byte) with the
    state that it leads to and the ordinals that it skips; a term's ordinal is the sum of these along its bytes."""

    codes: np.ndarray  # int64, ascending
    target: np.ndarray  # int32
    skipped: np.ndarray  # int64
    final: np.ndarray  # bool, by state
    size: int  # terms

    def nbytes(self) -> int:
        return self.codes.nbytes + self.target.nbytes + self.skipped.nbytes + self.final.nbytes

    def to_bytes(self) -> bytes:
        head = np.array([len(self.codes), len(self.final), self.size], "<i8").tobytes()
        return head + self.codes.astype("<i8").tobytes() + self.skipped.astype("<i8").tobytes() + self.target.astype("<i4").tobytes() + self.final.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        n, m, size = np.frombuffer(data, "<i8", 3).tolist()
        at = 24
        codes = np.frombuffer(data, "<i8", n, at)
        skipped = np.frombuffer(data, "<i8", n, at + 8 * n)
        target = np.frombuffer(data, "<i4", n, at + 16 * n)
        return cls(codes, target, skipped, np.frombuffer(data, bool, m, at + 20 * n), size)

    def ordinals(self, terms: list[bytes]) -> np.ndarray:
        """Each term's ordinal, -1 if it is none of the terms: all of them move through the states side by side, a byte a step."""
        lengths = np.fromiter(map(len, terms), np.int64, len(terms))
        data = np.frombuffer(b"".join(terms), np.uint8).astype(np.int64)
        starts = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])[:-1]
        out = np.full(len(terms), -1, np.int64)
        who, state, total, k = np.arange(len(terms)), np.zeros(len(terms), np.int64), np.zeros(len(terms), np.int64), 0
        while len(who):
            over = lengths[who] == k
            if over.any():
                done = over & self.final[state]
                out[who[done]] = total[done]
                who, state, total = who[~over], state[~over], total[~over]
            if not len(who) or not len(self.codes):
                break
            code = (state << 8) + data[starts[who] + k]
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            on = self.codes[at] == code
            at, who = at[on], who[on]
            state, total, k = self.target[at].astype(np.int64), total[on] + self.skipped[at], k + 1
        return out

    def term(self, ordinal: int) -> bytes:
        """The term of an ordinal."""
        out, state = bytearray(), 0
        while True:
            if self.final[state]:
                if ordinal == 0:
                    return bytes(out)
            a, b = np.searchsorted(self.codes, [state << 8, (state + 1) << 8])
            if a == b:
                raise IndexError("no such ordinal")
            i = a + int(np.searchsorted(self.skipped[a:b], ordinal, "right")) - 1
            if i < a:
                raise IndexError("no such ordinal")
            ordinal -= int(self.skipped[i])
            out.append(int(self.codes[i]) & 255)
            state = int(self.target[i])


def build(terms: Iterable[bytes]) -> Transducer:
    """The minimal transducer of ascending distinct terms.  States behind the last common prefix are closed as soon as the next term
    leaves it: an equal closed state takes their place, so besides the result only one term's states are open."""
    start, closed = _State(), {}
    path, last, size = [start], None, 0

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            state, above = path.pop(), path[-1]
            state.count = state.final + sum(s.count for s in state.next.values())
            same = closed.setdefault(state.key(), state)
            if same is not state:
                above.next[last[len(path) - 1]] = same
    for term in terms:
        if last is not None and term <= last:
            raise ValueError("terms must ascend")
        common = 0
        if last is not None:
            most = min(len(last), len(term))
            while common < most and last[common] == term[common]:
                common += 1
            close(common)
        for b in term[common:]:
            state = _State()
            path[-1].next[b] = state
            path.append(state)
        path[-1].final = True
        last, size = term, size + 1
    close(0)
    start.number, order = 0, [start]
    for state in order:  # grows while it is walked
        for s in state.next.values():
            if s.number < 0:
                s.number = len(order)
                order.append(s)
    codes, target, skipped = [], [], []
    for state in order:
        before = int(state.final)
        for b, s in sorted(state.next.items()):
            codes.append((state.number << 8) + b)
            target.append(s.number)
            skipped.append(before)
            before += s.count
    return Transducer(np.array(codes, np.int64), np.array(target, np.int32), np.array(skipped, np.int64), np.array([s.final for s in order], bool), size)
