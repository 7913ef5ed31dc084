"""Language of whole texts by averaged hashed subword embeddings and a linear softmax.

Features are the byte 2-, 3- and 4-grams of the lower-cased text, within words
and with the word's edges, hashed to ``BUCKETS``.  A text is the average of its
features' embeddings; a linear softmax turns it into scores.  Both are trained
together by stochastic gradient descent in numpy, on at most ``per_language``
labelled rows of each language (of which one in five only calibrates: a temperature for the scores, and the
score below which a text is rejected, which one in a thousand of the texts that are
predicted right falls below, as it is found, without a ceiling; so the shorter a text of another language, the
more often it still passes).  Averages are linear, so for prediction
embedding and softmax are one table of ``BUCKETS`` x languages, the only
thing broadcast.

Defined results: a text that is null or has no letter is ``und``, with score 0,
and rejected; so is every text if no row has a label.  Training texts and predicted texts count by all their
features; long ones are read in pieces that end where words end, so where they are cut changes nothing.  Rows are judged one by one, so repeated rows get
equal results; an empty table gives no row; a column that is named as one of the
results is replaced, other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, unused

BUCKETS = 1 << 15
#: Rows that a task scores at a time.
ROWS = 512
GRAMS = (2, 3, 4)
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)
# ASCII without letters is an edge of words.
_EDGE = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))
_AT_EDGE = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]").search


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """``(positions, buckets)`` of the features of lower-cased UTF-8 bytes."""
    b = np.frombuffer(data.translate(_EDGE), np.uint8).astype(np.uint32)
    edge = b == 32
    at, out = [], []
    for n in GRAMS:
        m = len(b) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ b[i:i + m]) * _MIX[i % 4]
            h ^= h >> np.uint32(15)
        inside = ~edge[1:m + 1] if n > 2 else ~(edge[:m] & edge[1:m + 1])
        for i in range(2, n - 1):
            inside &= ~edge[i:i + m]
        at.append(np.flatnonzero(inside))
        out.append(h[inside] & np.uint32(BUCKETS - 1))
    return (np.concatenate(at), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def prepared(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace") + b" "


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Prepared text in pieces of ``size`` bytes or more, cut at edges of words; the edge belongs to both sides, so every feature is in
    exactly one piece."""
    at, size = 0, max(2, size)  # a piece goes beyond the edge that it begins with
    while len(data) - at > size:
        edge = _AT_EDGE(data, at + size - 1)
        if edge is None or edge.start() >= len(data) - 1:
            break
        yield data[at:edge.start() + 1]
        at = edge.start()
    yield data[at:] if at else data


def weights(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a training text and their shares; there are at most ``BUCKETS``."""
    buckets, counts = np.unique(features(prepared(text))[1], return_counts=True)
    return buckets, (counts / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    reject_below: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], dim: int = 16, epochs: int = 8,
        rate: float = 2.0, seed: int = 5, reject_share: float = 0.001) -> Model:
    """``rows``: label number, buckets, shares."""
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    soft = np.zeros((dim, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    order = rng.permutation(len(rows))
    held, learn = order[:len(rows) // 5], order[len(rows) // 5:]
    size = np.bincount([rows[i][0] for i in learn], minlength=len(languages)) if len(learn) else np.ones(len(languages))
    share = np.clip(len(learn) / np.maximum(size, 1) / len(languages), 0.2, 5.0)
    total, step = epochs * len(learn), 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            y, idx, w = rows[i]
            if len(idx) > 8 and rng.random() < 0.5:  # part of the features, as a short text has them
                pick = rng.choice(len(idx), rng.integers(4, len(idx)), replace=False)
                idx, w = idx[pick], w[pick] / w[pick].sum()
            x = w @ emb[idx]
            g = _softmax(x @ soft + bias)
            g[y] -= 1
            lr = np.float32(rate * share[y] * (1 - step / total))
            back = soft @ g
            soft -= lr * np.outer(x, g)
            bias -= lr * 0.1 * g
            emb[idx] -= lr * np.outer(w, back)
            step += 1
    table = (emb @ soft).astype(np.float32)
    # In double precision, as texts are scored: single precision makes scores near 1 equal to 1.
    z = np.array([rows[i][2].astype(np.float64) @ table[rows[i][1]] + bias for i in held], dtype=np.float64).reshape(len(held), len(languages))
    y = np.array([rows[i][0] for i in held], dtype=int)
    heat = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).sum() for t in heat]
    t = heat[int(np.argmin(loss))]
    p = _softmax(z / t)
    right = p.max(axis=1)[p.argmax(axis=1) == y] if len(y) else np.zeros(0)
    low = float(np.quantile(right, reject_share)) if len(right) else 0.0
    return Model(languages, table, bias, t, low)


def train(docs: DataFrame, use: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          per_language: int = 600) -> Model:
    """Fit on rows where ``use`` holds and the label is not null, ``per_language`` at most of each label: those
    of the smallest hash of the id.  Features are taken on the executors; a row brings at most ``BUCKETS``."""
    space = 1 << 40
    rows = docs.where(use & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")) \
        .select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(space)).alias("h"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    near = rows.join(F.broadcast(counts), "lang").where(F.col("h") < F.least(F.lit(1.0), 1.3 * per_language / F.col("n")) * float(space))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.length("text"), "text"))
    chosen = near.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [weights(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "lang": batch.column("lang"), "idx": pa.array([i.astype("<u4").tobytes() for i, _ in got], pa.binary()),
                "w": pa.array([w.astype("<f4").tobytes() for _, w in got], pa.binary())})
    got = sorted((r.lang, bytes(r.idx), bytes(r.w)) for r in chosen.mapInArrow(take, "lang string, idx binary, w binary").collect())
    languages = sorted({r[0] for r in got})
    model = fit([(languages.index(n), np.frombuffer(i, "<u4"), np.frombuffer(w, "<f4")) for n, i, w in got], languages)
    del got
    give_back()  # the driver's part: the features of the training rows are no longer needed
    return model


def scores(texts: list[str], model: Model, chunk: int = 400_000) -> np.ndarray:
    """Scores of whole texts, some at a time; the sums of a long text's pieces are added."""
    sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    data, owners, held = [], [], 0

    def flush():
        nonlocal data, owners, held
        if not data:
            return
        starts = np.cumsum([0, *map(len, data)])[:-1]
        at, buckets = features(b"".join(data))
        if len(at):
            who = np.searchsorted(starts, at, "right") - 1
            n = np.bincount(who, minlength=len(data))
            for k in range(len(model.languages)):
                np.add.at(sums[:, k], owners, np.bincount(who, model.table[buckets, k], len(data)))
            np.add.at(counts, owners, n)
        data, owners, held = [], [], 0

    for i, t in enumerate(texts):
        for piece in pieces(prepared(t), chunk):
            data.append(piece)
            owners.append(i)
            held += len(piece)
            if held >= chunk:
                flush()
    flush()
    return _softmax((sums / np.maximum(counts, 1)[:, None] + model.bias) / model.temperature)


_VERDICT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])


def classify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred``, ``score`` and ``accepted``.  Only texts with letters go through Python, some at a time, and
    only verdicts come back; the other columns stay where they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    results = _VERDICT.names
    docs = docs.drop(*(c for c in results if c != text_col))

    def some(texts: pa.Array, m: Model) -> pa.Array:
        ok = [t.is_valid and bool(m.languages) for t in texts]
        p = scores([t.as_py() for t, x in zip(texts, ok) if x], m) if any(ok) else np.zeros((0, 1))
        best, top = iter(p.argmax(axis=1).tolist()), iter(p.max(axis=1).tolist())
        pred = [m.languages[next(best)] if x else "und" for x in ok]
        score = [next(top) if x else 0.0 for x in ok]
        return pa.StructArray.from_arrays([pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                           pa.array([x and s >= m.reject_below for x, s in zip(ok, score)], pa.bool_())], results)

    @F.arrow_udf(_VERDICT)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        try:
            for texts in batches:
                yield pa.concat_arrays([some(texts.slice(at, ROWS), m) for at in range(0, len(texts), ROWS)] or [some(texts, m)])
        finally:
            give_back()
    judged = judged.asNondeterministic()  # or a filter on a verdict would have it computed twice
    verdict = unused(docs, "verdict")
    text = F.col(text_col)
    return docs.withColumn(verdict, judged(F.when(text.rlike(r"\p{L}"), text))).select(*docs.columns, *(F.col(f"{verdict}.{c}").alias(c) for c in results if c != text_col))
