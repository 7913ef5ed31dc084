"""Packing documents into sequences of at most ``window`` tokens.

A document fills whole windows first; the rest is a piece shorter than a
window.  The histogram of the rests' lengths (at most ``window`` - 1 numbers, all that
reaches the driver) is written as repeats of shallow combinations, two or
three lengths that fill a window exactly: non-negative least squares, rounded
down to what is there.  Left-over rests are packed greedily end to end, and the one that
meets a window's end is cut in two, so only the last sequence has room.

A rest finds its place by its rank among those of its length: ranks are
counted within each input partition and summed over partitions, so a length
that a third of all documents share is one number, not one task.

Defined results: null text counts as empty and has the end id alone; repeated
rows and ids are documents of their own; an empty table gives no row; columns
other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy, with_row_id, written
from .tokens import WordEncoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Words that each Python worker keeps the ids of, about 150 MB.
WORDS = 600_000
#: Rows that a task encodes at a time.
ROWS = 1000
_LEN = 1 << 40  # a slot's key: length * _LEN + rank


@dataclass
class Plan:
    """Slots of the rests, by length and rank, and the stream of those left over."""

    window: int
    keys: np.ndarray      # length * _LEN + first rank, ascending
    firsts: np.ndarray    # first rank of the slot
    sequences: np.ndarray  # sequence of that rank; -1: the stream
    offsets: np.ndarray   # offset in the sequence, or place in the stream
    combined: int         # sequences made of combinations
    streamed: int         # sequences of the stream

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, offset)`` of each rest; one that reaches beyond its window goes on in the next sequence at 0."""
        at = np.searchsorted(self.keys, lengths * _LEN + ranks, "right") - 1
        k = ranks - self.firsts[at]
        spot = self.offsets[at] + k * lengths
        stream = self.sequences[at] < 0
        return (np.where(stream, self.combined + spot // self.window, self.sequences[at] + k),
                np.where(stream, spot % self.window, self.offsets[at]))


def combinations(hist: np.ndarray, window: int, frequent: int = 64) -> np.ndarray:
    """Shallow combinations of present lengths that fill the window: all pairs, and the triples that
    start with two of the ``frequent`` most common lengths.  Columns of lengths, 0 where there is none."""
    here = np.flatnonzero(hist[:window])
    a = here[(here > 0) & (here <= window // 2)]
    a = a[hist[window - a] > 0]
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    top = np.sort(here[np.argsort(-hist[here], kind="stable")][:frequent])
    x, y = np.meshgrid(top, top, indexing="ij")
    x, y = x[x <= y], y[x <= y]
    z = window - x - y
    ok = (z > 0) & (hist[np.clip(z, 0, window - 1)] > 0)
    triples = np.unique(np.sort(np.stack([x, y, z], 1)[ok], 1), axis=0) if ok.any() else np.zeros((0, 3), int)
    return np.concatenate([pairs, triples]).astype(np.int64)


def nnls(cols: np.ndarray, hist: np.ndarray, steps: int = 3000) -> np.ndarray:
    """Repeats ``x >= 0`` of each combination that bring the lengths used near ``hist``: accelerated projected gradient."""
    n = len(hist)
    real = cols > 0

    def forward(x):
        return np.bincount(cols[real], np.broadcast_to(x[:, None], cols.shape)[real], n)

    def back(r):
        return np.where(real, r[cols], 0).sum(1)
    v = np.ones(len(cols))
    for _ in range(30):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(cols))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - hist) / (1.05 * norm))
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        y, x = new + (before - 1) / t * (new - x), new
    return x


def make_plan(hist: np.ndarray, window: int) -> Plan:
    """``hist[l]``: rests of length ``l``, for 0 < ``l`` < ``window``."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    cols = combinations(left, window)
    slots, seqs = [], 0
    used = np.zeros(window, dtype=np.int64)
    if len(cols):
        x = nnls(cols, left.astype(float))
        for j in np.argsort(-x, kind="stable"):
            lengths = [int(v) for v in cols[j] if v]
            need = {v: lengths.count(v) for v in lengths}
            times = min(int(x[j] + 0.5), *(int(left[v]) // c for v, c in need.items()))
            if times <= 0:
                continue
            offset = 0
            for v in lengths:
                slots.append((v, int(used[v]), seqs, offset))
                used[v] += times
                left[v] -= times
                offset += v
            seqs += times
    at = 0
    for v in np.flatnonzero(left)[::-1]:  # longest first, end to end
        slots.append((int(v), int(used[v]), -1, at))
        at += int(v) * int(left[v])
    slots.sort()
    s = np.array(slots or [(0, 0, -1, 0)], dtype=np.int64)
    return Plan(window, s[:, 0] * _LEN + s[:, 1], s[:, 1], s[:, 2], s[:, 3], seqs, -(-at // window))


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``(rid, doc_id, n, ids)`` written to the shared folder: each text is encoded once."""
    width = WordEncoder.load(tokenizer).dtype

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = WordEncoder.load(tokenizer, words), np.array([end_id], dtype=width).tobytes()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = [x + end for x in enc.stream(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                batch.column("rid"), batch.column("doc_id"), pa.array([len(x) // width.itemsize for x in ids], pa.int64()),
                pa.array(ids, pa.binary())], ["rid", "doc_id", "n", "ids"])
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return written(rows.select("rid", "doc_id", "text").mapInArrow(tidy(encode), "rid long, doc_id long, n long, ids binary"), "pack-ids")


def _running(rows: DataFrame, by: list[str], what: str, name: str) -> DataFrame:
    """``name``: sum of ``what`` over earlier rows of equal ``by``, counted within
    each input partition (``part``) and then over the partitions before it."""
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = rows.groupBy(*by, "part").agg(F.sum(what).alias("_s"))
    parts = parts.select(*by, "part", F.coalesce(F.sum("_s").over(Window.partitionBy(*by).orderBy("part").rowsBetween(*before)), zero).alias("_base"))
    within = F.coalesce(F.sum(what).over(Window.partitionBy(*by, "part").orderBy("rid").rowsBetween(*before)), zero)
    return rows.withColumn("_in", within).join(parts, [*by, "part"]).withColumn(name, F.col("_in") + F.col("_base")).drop("_in", "_base")


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         words: int = WORDS) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``
    (``ids``: the piece's ids as little-endian unsigned 32-bit integers).  ``words``: those that a worker keeps the ids of;
    it changes memory and time, not the result."""
    tokens = tokenised(docs, tokenizer, end_id, id_col, text_col, words)
    rows = tokens.select("rid", (F.col("n") % window).alias("rest"), F.expr(f"n div {window}").alias("whole"), F.shiftright("rid", 33).alias("part"))
    counted = rows.groupBy("rest").agg(F.count("*").alias("c"), F.sum("whole").alias("w")).collect()
    hist = np.zeros(window, dtype=np.int64)
    for r in counted:
        hist[r.rest] = r.c
    plan = make_plan(hist, window)
    one = F.lit(1).cast("long")
    rows = _running(rows.withColumn("one", one), ["rest"], "one", "rank").drop("one")
    rows = _running(rows.withColumn("all", F.lit(0)), ["all"], "whole", "whole_before").drop("all")
    width, first_whole = WordEncoder.load(tokenizer).dtype, plan.combined + plan.streamed

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "whole", "rank", "whole_before", "n")}
            rest, whole, n = col["rest"], col["whole"], col["n"]
            seq, off = plan.place(rest, col["rank"])
            head = np.minimum(rest, window - off)  # of the rest, before a cut
            k = whole + (rest > 0) + (rest > head)
            row = np.repeat(np.arange(len(n)), k)
            i = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)  # piece of its document
            over = i - whole[row]  # below 0: a whole window; 0: the rest; 1: what was cut off
            length = np.where(over < 0, window, np.where(over == 0, head[row], (rest - head)[row]))
            start = np.minimum(i, whole[row]) * window + np.where(over == 1, head[row], 0)
            ids = [np.frombuffer(b, width).astype("<u4").tobytes() for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(n[row]),
                pa.array(np.where(over < 0, first_whole + col["whole_before"][row] + i, seq[row] + (over == 1))),
                pa.array(np.where(over == 0, off[row], 0)),
                pa.array([ids[r][4 * s:4 * (s + m)] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())], pa.binary())],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
    return tokens.join(rows.drop("part"), "rid").mapInArrow(tidy(cut), PIECES)
