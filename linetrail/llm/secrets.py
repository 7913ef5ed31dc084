"""Secrets in texts: three fixed patterns and two character Markov models.

The patterns are a fixed contract.  The models are first-order Markov chains
over the characters of ``ALPHABET``, one of random strings and one of
ordinary identifiers.  A run of 20 or more such characters is a secret of
kind ``markov`` where the log-likelihood ratio for each character is above a
threshold that at most one in a thousand ordinary labelled strings of the
held-out half reaches.  Labelled samples: random strings drawn by rule from the alphabets of
common keys; ordinary ones are words of a bounded sample of the texts, as
they are and joined in the ways identifiers are.

Defined results: null text counts as empty; rows are judged one by one, so
repeated rows and repeated ids give repeated results; an empty table gives
no row (the models then rest on the words of ``WORDS``); other columns are
ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample

KINDS = ["assign", "access", "hex", "markov"]
SPANS = "doc_id long, spans array<struct<kind: string, start: long, end: long, score: double>>"

# The patterns and least lengths that results must follow.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
# A text without any of these in lower case has no match of ASSIGN.
ASSIGN_HINTS = ("passw", "secret", "token", "api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_LEAST = 20
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN_LEAST)
_CODE = np.full(128, len(ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))

WORDS = ("account active address array average base buffer build cache call channel check class client code column common config "
         "connection content context count create current data database date default delete description directory document element "
         "error event example file filter first format function group handler header index input instance item iterator key label "
         "language length level library line list local manager message method model module name node number object option order "
         "output package page parameter parent path pattern performance position process project property query range record "
         "reference request response result return schema search section server service session setting size source state status "
         "stream string style system table target template test text time title type update user value version view window").split()


def _codes(s: str) -> np.ndarray:
    return _CODE[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]


@dataclass
class Model:
    """Log-likelihood ratio of each step between two characters (random over ordinary), and the threshold."""

    steps: np.ndarray
    threshold: float

    def score(self, s: str) -> float:
        c = _codes(s)
        return float(self.steps[c[:-1], c[1:]].mean())


def _log_steps(samples: list[str], add: float = 0.5) -> np.ndarray:
    n = len(ALPHABET) + 1
    counts = np.full((n, n), add)
    for s in samples:
        c = _codes(s)
        np.add.at(counts, (c[:-1], c[1:]), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def labelled_samples(words: list[str], n: int, seed: int = 11) -> tuple[list[str], list[str]]:
    """``(random, ordinary)`` strings of 20 to 60 characters, the same for the same words."""
    rng = random.Random(seed)
    letters, digits = ALPHABET[:52], ALPHABET[52:62]
    kinds = [ALPHABET[:64], letters + digits, ALPHABET[26:62], ALPHABET[:26] + digits, "abcdef" + digits]
    strange = ["".join(rng.choice(kinds[i % len(kinds)]) for _ in range(rng.randint(20, 60))) for i in range(n)]
    words, plain = sorted(set(words)) or WORDS, []
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(x.capitalize() for x in w),
             lambda w: "_".join(w).upper(), lambda w: "".join(w), lambda w: "".join(w).upper(), lambda w: "_".join(w) + str(rng.randint(0, 9999)),
             lambda w: w[0][:3] + "_" + "=".join(w), lambda w: w[0] + str(rng.randint(1, 99)) + "-" + "-".join(w)]
    for i in range(n):
        parts = []
        while sum(map(len, parts)) < 20:
            parts.append(rng.choice(words if i % 3 else WORDS))
        plain.append(joins[i % len(joins)](parts)[:60])
    return strange, plain


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 1000, samples: int = 6000) -> Model:
    """Fit on words of at most ``sample_docs`` texts and ``samples`` strings of either label."""
    some = bounded_sample(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), sample_docs, "doc_id")
    runs = some.select(F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("([A-Za-z]{3,19})"), 1))).alias("w"))
    words = [r.w for r in runs.groupBy("w").count().orderBy(F.desc("count"), "w").limit(20_000).collect()]
    strange, plain = labelled_samples(words, samples)
    half = samples // 2
    steps = _log_steps(strange[:half]) - _log_steps(plain[:half])
    model = Model(steps, 0.0)
    model.threshold = max(0.0, float(np.quantile([model.score(s) for s in plain[half:]], 0.999)))
    return model


def find(text: str | None, model: Model | None) -> list[tuple[int, int, int, float]]:
    """``(start, kind, end, score)`` of every span, in order; ``kind`` is the place in ``KINDS``."""
    if not text:
        return []
    out, low = [], text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [(m.start(), 0, m.end(), 0.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if max(map(len, text.split()), default=0) >= RUN_LEAST:
        runs = list(RUN.finditer(text))
        for r in runs:  # a hexadecimal run of the least length lies within one of these
            out += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text, r.start(), r.end()) if m.end() - m.start() >= HEX_LEAST]
        if model:
            # Runs and known spans both ascend: of those that start before a run ends, the farthest end tells whether one meets it.
            known, at, farthest = sorted((s, e) for s, _, e, _ in out), 0, 0
            for r in runs:
                while at < len(known) and known[at][0] < r.end():
                    farthest, at = max(farthest, known[at][1]), at + 1
                if farthest <= r.start() and (score := model.score(r[0])) > model.threshold:
                    out.append((r.start(), 3, r.end(), score))
    return sorted(out)


def scan(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``: spans of whole texts in code points, end not included, in order of start, then kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "score": x} for s, k, e, x in find(t, model)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)
