"""Source divergence audit: which sources of a language differ from each other and from the language, and by which terms.

1. Terms in many documents of a language are its vocabulary, sorted; a term's place is its ordinal.
2. Each run of ``SEGMENT`` ordinals becomes a minimal acyclic transducer (``transducer.py``), built by one task.
3. The texts are streamed through the transducers, which give ordinals; what is counted, shuffled and ranked from here on are
   ordinals, and they decide ties, as they are in the order of the terms.  Transducers reach the tasks ``BROADCAST_BYTES``
   at a time: a larger vocabulary takes more readings of its languages' texts, and the same memory.
4. A term's share ``p`` in a group is ``1 + floor(SCALE * (count + 5) / (N + 5 V))``, in whole numbers.  The distance of two sources
   is the sum of ``|p - q|`` over all terms, counted in blocks of ``BLOCK`` ordinals and pairs of ``TILE`` sources,
   so that no task holds all of a language's sources and terms.

Defined results: null text, language and source count as empty strings; a term is a run of letters A-Z, lower-cased, and of
characters beyond ASCII; a language without kept terms has pairs of value 0 and no terms; repeated rows count again; an empty
table gives no row; further columns are not read.  Exact while a group has fewer than 9e15 terms.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, written
from .ranks import ranked
from .transducer import Transducer, build

#: Documents of a language that a kept term occurs in.
LEAST_DOCUMENTS = 30
#: Terms of one transducer.
SEGMENT = 1 << 16
#: Transducers that a task holds at a time.
BROADCAST_BYTES = 64 << 20
BLOCK, TILE = 512, 64
SCALE_STEPS, PRIOR = 3, 5  # the scale is 1000 to the power of the steps
_HELD = 300_000
_LONG = 1 << 22

_TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(data: bytes) -> Iterator[bytes] | list[bytes]:
    """The terms of UTF-8 text, A-Z lower-cased; those of a long text one by one."""
    data = data.lower()  # of bytes: ASCII alone
    return _TERM.findall(data) if len(data) < _LONG else (m.group() for m in _TERM.finditer(data))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    column = batch.column("text").cast(pa.binary())
    return (x.as_py() for x in column)


def _plain(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _utf8(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def vocabulary(rows: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``lang, term, rank, n``: each language's terms in ``least_documents`` of its documents or more, with their ordinals and their number."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out():
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), _utf8(list(c)), pa.array(list(c.values()), pa.int64())],
                                                 ["lang", "term", "docs"])
            held.clear()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch)):
                held.setdefault(lang, Counter()).update(set(terms(text)))
            if sum(map(len, held.values())) > _HELD:
                yield from out()
        yield from out()
    found = rows.select("lang", "text").mapInArrow(count, "lang string, term string, docs long") \
        .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents).select("lang", "term")
    return ranked(written(found, "kept-terms"), ["lang"], ["term"], "term-ordinals")


def transducers(vocab: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``lang, first_rank, first_term, data``: a transducer for each ``segment`` ordinals of a language."""
    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by("rank")
        t = build(x.as_py() for x in part["term"].cast(pa.binary()))
        return pa.table({**{to: part[c][:1] for to, c in (("lang", "lang"), ("first_rank", "rank"), ("first_term", "term"))}, "data": pa.array([t.to_bytes()], pa.binary())})
    return vocab.withColumn("segment", F.expr(f"rank div {segment}")).groupBy("lang", "segment") \
        .applyInArrow(one, "lang string, first_rank long, first_term string, data binary")


class _Lookup:
    """Terms to ordinals by some transducers of several languages, each with its first ordinal and term."""

    def __init__(self, parts: list[tuple[str, int, bytes, bytes]]):
        self.langs: dict[str, list[tuple[bytes, int, Transducer]]] = {}
        for lang, rank, first, data in sorted(parts, key=lambda p: (p[0], p[1])):
            self.langs.setdefault(lang, []).append((first, rank, Transducer.from_bytes(data)))

    def counts(self, lang: str, found: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Ordinals of the terms that are in the vocabulary, and their counts."""
        parts, some = self.langs[lang], sorted(found)
        cuts = [bisect_left(some, first) for first, _, _ in parts] + [len(some)]
        ranks, numbers = [], []
        for (_, rank, t), a, b in zip(parts, cuts, cuts[1:]):
            r = t.ordinals(some[a:b])
            ok = r >= 0
            ranks.append(r[ok] + rank)
            numbers.append(np.fromiter((found[x] for x in some[a:b]), np.int64, b - a)[ok])
        return np.concatenate(ranks), np.concatenate(numbers)


def _recounted(rows: DataFrame, parts: list[tuple[str, int, bytes, bytes]]) -> DataFrame:
    """``lang, source, rank, n`` of the ordinals of ``parts``, one row or more for each."""
    shared = rows.sparkSession.sparkContext.broadcast(parts)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, held = _Lookup(shared.value), {}

        def out():
            for (lang, source), c in held.items():
                ranks, n = lookup.counts(lang, c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()),
                                                  pa.array(ranks), pa.array(n)], ["lang", "source", "rank", "n"])
            held.clear()
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _texts(batch)):
                held.setdefault((lang, source), Counter()).update(terms(text))
            if sum(map(len, held.values())) > _HELD:
                yield from out()
        yield from out()
    langs = sorted({p[0] for p in parts})
    return rows.where(F.col("lang").isin(langs)).mapInArrow(stream, "lang string, source string, rank long, n long")


def recount(rows: DataFrame, built: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``lang, source, rank, n``: occurrences of every kept term in every group that has it."""
    sizes = sorted((r.lang, r.first_rank, r.size) for r in built.select("lang", "first_rank", F.octet_length("data").alias("size")).collect())
    some, held, out = [], 0, []

    def read():
        keys = F.array(*(F.struct(F.lit(lang).alias("lang"), F.lit(rank).cast("bigint").alias("first_rank")) for lang, rank in some))
        at = built.where(F.array_contains(keys, F.struct("lang", "first_rank")))
        parts = [(r.lang, r.first_rank, r.first_term.encode(), bytes(r.data)) for r in at.collect()]
        out.append(written(_recounted(rows, parts).groupBy("lang", "source", "rank").agg(F.sum("n").alias("n")), "term-counts"))
    for lang, rank, size in sizes:
        if some and held + size > broadcast_bytes:
            read()
            some, held = [], 0
        some.append((lang, rank))
        held += size
    if some:
        read()
    if not out:
        return rows.sparkSession.createDataFrame([], "lang string, source string, rank long, n long")
    total = out[0]
    for x in out[1:]:
        total = total.union(x)
    return total


def share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE * (count + 5) / (n + 5 v))`` by long division, three digits at a time; null without terms."""
    of, rest, quotient = F.nullif(n + PRIOR * v, F.lit(0)), count + PRIOR, F.lit(0).cast("bigint")

    def div(a, b):
        return F.call_function("div", a, b)
    for _ in range(SCALE_STEPS):
        scaled = rest * 1000
        quotient, rest = quotient * 1000 + div(scaled, of), scaled % of
    return quotient + 1


def _distances(part: pa.Table) -> pa.Table:
    """Partial distances of all pairs of one tile pair in one block of ordinals.  Rows without a source are counts."""
    counts = part.filter(pc.is_null(part["source"]))
    heads = part.filter(pc.is_valid(part["source"])).sort_by("idx")
    idx, names = heads["idx"].to_numpy(), np.array(heads["source"].to_pylist(), object)
    lang, a, b, width, size = (heads[c][0].as_py() for c in ("lang", "a", "b", "width", "tile_size"))
    p = np.repeat(heads["p"].to_numpy()[:, None], width, axis=1)
    p[np.searchsorted(idx, counts["idx"].to_numpy()), counts["at"].to_numpy()] = counts["p"].to_numpy()
    left, right = np.flatnonzero(idx // size == a), np.flatnonzero(idx // size == b)
    i, j, value = [], [], []
    for x in left:
        others = right[right > x] if a == b else right
        i += [names[x]] * len(others)
        j += names[others].tolist()
        value += np.abs(p[others] - p[x]).sum(axis=1).tolist()
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "i": pa.array(i, pa.string()), "j": pa.array(j, pa.string()), "value": pa.array(value, pa.int64())})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_documents: int = LEAST_DOCUMENTS,
          top: int = 50, segment: int = SEGMENT, broadcast_bytes: int = BROADCAST_BYTES, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: for each group (language and source)

    * part ``pair``: every other source of the language with the distance of their shares;
    * part ``term``: the ``top`` terms that stand out from the language, with the difference of the shares;

    ranked from 1 by value, then by item.
    """
    rows = _plain(docs, text_col, lang_col, source_col)
    vocab = vocabulary(rows, least_documents)
    built = written(transducers(vocab, segment), "transducers")
    counts = recount(rows, built, broadcast_bytes)
    forget(built, docs.sparkSession)
    # Groups, numbered by source within their language.
    known = vocab.groupBy("lang").agg(F.max("n").alias("v"))
    by_lang = Window.partitionBy("lang")
    groups = rows.select("lang", "source").distinct() \
        .join(counts.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(known, "lang", "left") \
        .withColumns({"total": F.coalesce("total", F.lit(0)), "v": F.coalesce("v", F.lit(0))}) \
        .withColumn("idx", F.row_number().over(by_lang.orderBy("source")) - 1) \
        .withColumns({"sources": F.count(F.lit(1)).over(by_lang), "lang_total": F.sum("total").over(by_lang)})
    groups = written(groups, "groups")
    p = share(F.col("n"), F.col("total"), F.col("v"))
    shares = counts.join(groups.drop("v").join(known, "lang"), ["lang", "source"]).withColumn("p", p)
    # Terms that stand out.
    q = share(F.sum("n").over(Window.partitionBy("lang", "rank")), F.col("lang_total"), F.col("v"))
    ahead = shares.select("lang", "source", "rank", "p", q.alias("q")).where("p > q").select("lang", "source", F.col("rank").alias("ordinal"), (F.col("p") - F.col("q")).alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal"))
    best = ahead.withColumn("rank", place).where(F.col("rank") <= top)
    named = best.join(vocab.select("lang", F.col("rank").alias("ordinal"), F.col("term").alias("item")), ["lang", "ordinal"]) \
        .select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    # Distances of all pairs of sources.
    tiles = F.sequence(F.lit(0).cast("bigint"), F.expr(f"(sources - 1) div {tile}"))
    mine, other = F.expr(f"idx div {tile}"), F.col("other")
    ends = [F.least(mine, other).alias("a"), F.greatest(mine, other).alias("b")]
    heads = groups.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"greatest(v - 1, 0) div {block}")))).withColumn("other", F.explode(tiles)) \
        .select("lang", "block", *ends, "source", "idx", F.coalesce(share(F.lit(0), F.col("total"), F.col("v")), F.lit(0)).alias("p"), F.lit(0).cast("bigint").alias("at"),
                F.least(F.lit(block), F.col("v") - F.col("block") * block).alias("width"), F.lit(tile).alias("tile_size"))
    cells = shares.withColumn("other", F.explode(tiles)) \
        .select("lang", F.expr(f"rank div {block}").alias("block"), *ends, F.lit(None).cast("string").alias("source"), "idx", "p", F.expr(f"rank % {block}").alias("at"),
                F.lit(None).cast("bigint").alias("width"), F.lit(None).cast("int").alias("tile_size"))
    found = heads.union(cells).groupBy("lang", "block", "a", "b").applyInArrow(_distances, "lang string, i string, j string, value long") \
        .groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = found.select("lang", "value", F.explode(F.array(F.struct(F.col("i").alias("source"), F.col("j").alias("item")),
                                                           F.struct(F.col("j").alias("source"), F.col("i").alias("item")))).alias("e"))
    pairs = both.select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value",
                        F.row_number().over(Window.partitionBy("lang", "e.source").orderBy(F.desc("value"), "e.item")).alias("rank"))
    return pairs.union(named)
