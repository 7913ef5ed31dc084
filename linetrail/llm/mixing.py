"""Mixing documents to target shares by iterative proportional fitting.

Tokens are counted by cell (source, language, topic) in one partial
aggregation.  A value that a target names is a class of its own, all others of its
column are one class, so the number of cells is bounded by the targets given, not by
the data, whatever a single source holds.  The cell weights are raked until each
marginal has its target shares.  A cell's probability is its weight over its
tokens; cells that would need more than they have stay whole and the rest is raked again.
``met`` tells whether that reached all targets.  With ``shrink``, where they cannot all be met at the share asked for, the greatest
smaller share at which they can is found from the cells and taken; where there is none, the share stays.  ``outcome`` gives the target and the share reached of every value.
Each document is kept if a hash of its id and text, even on 0 to 1, is below the probability of its cell.

Defined results: a null value is in the class of the unnamed ones; a target value that no document has is
left out and the shares of its column are scaled to the rest; null text has
no tokens, and documents without tokens are kept like the others of their
cell; rows that repeat in id and text share one fate; an empty table gives no
row; columns named as one of the results are replaced, other columns pass through.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

OTHER = "(other)"
RESULTS = ["n_tokens", "cell", "probability", "kept", "met"]
#: A target is met where the share reached differs from it by this much of all tokens kept, or less.
TOLERANCE = 0.005


def n_words(text: Column) -> Column:
    """White-space separated words."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"\S+")).cast("long")


def topic(text: Column) -> Column:
    """What kind of text it is, from its characters."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.lit(1), F.octet_length(t))

    def share(chars):
        return sum((n - F.octet_length(F.replace(t, F.lit(c), F.lit(""))) for c in chars), F.lit(0)) / n
    return F.when(share("|") > 0.01, "table").when(share("*#$%&") > 0.03, "symbols").when(share("!") > 0.03, "shouting").otherwise("prose")


def classed(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*(k for k in targets if k != OTHER)), value).otherwise(F.lit(OTHER))


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], tokens: float, rounds: int = 200, tol: float = 1e-9) -> dict[tuple, float]:
    """Probability of each cell so that about ``tokens`` tokens are kept with the target shares.

    ``cells``: tokens of each combination of classes.  Weights are at most the cell's tokens.
    """
    keys = [k for k, n in cells.items() if n > 0]
    if not keys:
        return {k: 1.0 for k in cells}
    have = np.array([cells[k] for k in keys], dtype=float)
    tokens = min(tokens, have.sum())
    members, goals = [], []
    for d, shares in enumerate(targets):
        names = sorted({k[d] for k in keys})
        goal = np.array([max(0.0, shares.get(n, 0.0)) for n in names])
        goal = goal / goal.sum() if goal.sum() else np.full(len(names), 1 / len(names))
        members.append(np.array([names.index(k[d]) for k in keys]))
        goals.append(goal * tokens)
    w = have * tokens / have.sum()
    full = np.zeros(len(keys), dtype=bool)
    for _ in range(len(keys) + 1):
        for _ in range(rounds):
            before = w.copy()
            for who, goal in zip(members, goals):
                rest = np.maximum(goal - np.bincount(who, np.where(full, w, 0), len(goal)), 0)
                now = np.bincount(who, np.where(full, 0, w), len(goal))
                factor = np.divide(rest, now, out=np.zeros_like(rest), where=now > 0)
                w = np.where(full, w, w * factor[who])
            if np.abs(w - before).max() <= tol * tokens:
                break
        over = ~full & (w > have * (1 + 1e-12))
        if not over.any():
            break
        w, full = np.where(over, have, w), full | over
    return {k: 1.0 for k in cells} | {k: float(min(1.0, x / n)) for k, x, n in zip(keys, w, have)}


def outcome(cells: dict[tuple, float], p: dict[tuple, float], targets: dict[str, dict[str, float]]) -> list[tuple[str, str, float, float, bool]]:
    """``(column, value, target, reached, met)`` of every class that tokens or targets name: shares of the tokens that are kept on average."""
    kept = {k: p[k] * n for k, n in cells.items()}
    total, out = sum(kept.values()), []
    for d, (column, shares) in enumerate(targets.items()):
        there = {k[d] for k, n in cells.items() if n > 0}
        scale = sum(max(0.0, shares.get(v, 0.0)) for v in there)
        for v in sorted(there):
            goal = max(0.0, shares.get(v, 0.0)) / scale if scale else 1 / len(there)
            got = sum(n for k, n in kept.items() if k[d] == v) / total if total else 0.0
            out.append((column, v, goal, got, not total or abs(got - goal) <= TOLERANCE))
        out += [(column, v, goal, 0.0, goal <= 0) for v, goal in sorted(shares.items()) if v not in there]
    return out


def _met(cells: dict, p: dict, targets: dict) -> bool:
    """Whether all classes that have tokens reach their targets."""
    there = [{k[d] for k, n in cells.items() if n > 0} for d in range(len(targets))]
    names = list(targets)
    return all(met for column, v, _, _, met in outcome(cells, p, targets) if v in there[names.index(column)])


def fitted(cells: dict[tuple, float], targets: dict[str, dict[str, float]], share: float, shrink: bool) -> tuple[dict[tuple, float], float, bool]:
    """``(probabilities, share, met)``: raked to ``share`` of all tokens, or with ``shrink`` to the greatest smaller share, to a
    thousandth of it, that meets all targets."""
    total, goals = sum(cells.values()), list(targets.values())
    p = rake(cells, goals, share * total)
    met = _met(cells, p, targets)
    if met or not shrink:
        return p, share, met
    lo, hi, best = 0.0, share, None
    while hi - lo > share / 1000:
        mid = (lo + hi) / 2
        now = rake(cells, goals, mid * total)
        if _met(cells, now, targets):
            lo, best = mid, now
        else:
            hi = mid
    return (p, share, False) if best is None else (best, lo, True)


def _counted(docs: DataFrame, columns: dict[str, Column], targets: dict[str, dict[str, float]], text_col: str) -> dict[tuple, float]:
    """Tokens of each cell; at most the product of the numbers of classes comes to the driver."""
    cell, n = (unused(docs, c) for c in ("_cell", "_n"))
    rows = docs.select(F.array(*(classed(columns[c], targets[c]) for c in targets)).alias(cell), n_words(F.col(text_col)).alias(n))
    return {tuple(r[0]): float(r[1] or 0) for r in rows.groupBy(cell).agg(F.sum(n)).collect()}


def shares(docs: DataFrame, columns: dict[str, Column], targets: dict[str, dict[str, float]], share: float, text_col: str = "text",
           shrink: bool = False) -> DataFrame:
    """``(marginal, value, target, reached, met)`` that ``mix`` gives with the same arguments, by the probabilities."""
    cells = _counted(docs, columns, targets, text_col)
    rows = outcome(cells, fitted(cells, targets, share, shrink)[0], targets)
    return docs.sparkSession.createDataFrame(rows, "marginal string, value string, target double, reached double, met boolean")


def mix(docs: DataFrame, columns: dict[str, Column], targets: dict[str, dict[str, float]], share: float, id_col: str = "doc_id",
        text_col: str = "text", seed: int = 17, shrink: bool = False) -> DataFrame:
    """All columns with ``n_tokens, cell, probability, kept, met``; ``met``: whether the kept tokens have the target shares.

    ``columns``: the value of each marginal; ``targets``: its shares by value,
    ``OTHER`` for all that are not named; ``share``: of all tokens, to keep.
    """
    cells = _counted(docs, columns, targets, text_col)
    p, _, met = fitted(cells, targets, share, shrink)
    # One literal for the whole table: at most the product of the numbers of classes.
    known = F.create_map(*itertools.chain.from_iterable((F.lit("\x1f".join(k)), F.lit(x)) for k, x in p.items())) if p \
        else F.create_map(F.lit(""), F.lit(1.0))
    cell, n, even = (unused(docs, c) for c in ("_cell", "_n", "_even"))
    rows = docs.withColumns({
        cell: F.array_join(F.array(*(classed(columns[c], targets[c]) for c in targets)), "\x1f"), n: n_words(F.col(text_col)),
        even: F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / float(1 << 40)})
    out = rows.drop(*(c for c in RESULTS if c not in (id_col, text_col))) \
        .withColumns({"n_tokens": F.col(n), "cell": F.col(cell), "probability": F.try_element_at(known, F.col(cell))})
    return out.withColumns({"kept": F.col(even) < F.col("probability"), "met": F.lit(met)}).drop(cell, n, even)
