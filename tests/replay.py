"""Plain forward replay of hunks, the brute-force model the Spark fold is
checked against.  One dict per file, hunks applied in order in new-side
"""

from __future__ import annotations


def apply_hunk(state: list, commit, s: int, o: int, n: int, added: list, replaced: set,
               inherit_overflow: bool = True) -> list:
    """state: list of (text, [commits]) for lines 1..len.  Returns the new state."""
    if not state:
        return [(added[k], [commit]) for k in range(n)]
    if n == 0:
        # lines s+1 .. s+o vanish
        return state[:s] + state[s + o:]
    before = state
    head = before[:s - 1]
    tail = before[s - 1 + o:]
    new_lines = []
    for k in range(n):
        pos = s + k  # 1-based position before the hunk that sits at s+k
        if o > 0 and k in replaced and pos <= len(before) and (inherit_overflow or k < o):
            txt, commits = before[pos - 1]
            new_lines.append((added[k], commits + [commit]))
        else:
            new_lines.append((added[k], [commit]))
    return head + new_lines + tail


def replay(hunks: list[dict]) -> list:
    """hunks: dicts with commit, s, o, n, added, replaced (set of k) in apply order."""
    state: list = []
    for h in hunks:
        state = apply_hunk(state, h["commit"], h["s"], h["o"], h["n"], h["added"],
                           h["replaced"])
    return state
