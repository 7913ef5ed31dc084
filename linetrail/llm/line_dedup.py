"""Fuzzy line duplicates across all documents by MinHash; DataFrame functions only.

A line's set is its distinct shingles of ``SHINGLE`` characters (lower-cased,
outer blanks trimmed; a shorter line is one shingle).  Equal lines
are one class from the start, and only its first text is cut.  Each class gets ``MINIMA`` minima of
all its hashed shingles, each under another shift and bit mask, taken by one
aggregation over the exploded shingles.  A band is ``ROWS`` of the minima, a minimum stands in several bands.  Classes
that agree on a band are candidates; exact Jaccard similarity of the sets decides (shingles told apart by 64 bits), with links from
``MIN_PERCENT`` on; connected components are found by distributed union-find.  Of each
component the first line stays (smallest ``doc_id``, then first in the
text), in all documents together.

No pairs are formed within a bucket at first: each class is compared with one of
its buckets' first classes.  What is then connected needs no
further comparison.  Then, ``ROUNDS`` times, one class of each component in a bucket is compared with one of the bucket's first
component, another one each time.  Of components that share buckets even then one pair is compared, then all
pairs that are still apart, so no candidate is lost and a large group of similar lines costs
about one comparison a line.  Pairs still apart are judged within their bucket first, by bitmaps of their shingles, which tell
surely that most of them have too little in common; texts are brought for the others alone.

So lines of similarity 0.75 become candidates with probability 0.995, of 0.8 with 0.999, of 0.9
with 0.99999; if one of them has fewer than ``SHORT`` shingles, with 0.9987, 0.9998 and 0.9999999, whether it has blanks or
not; equal ones always.  Lines that have little in common hardly ever do: of similarity 0.05, one pair in 6,000.

Defined results: a null text stays null, and blank lines always stay; a text
whose lines all go becomes empty (``n_lines`` tells it from one that was);
null ``doc_id`` come first; rows that repeat an id are told apart by the order read; an empty
table gives no row; columns named as one of the results are replaced, other
columns pass through.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_shuffles, forget, key_bitmaps, maybe_among, unused, with_stable_id, written
from .components import connected_components

SHINGLE = 8
MINIMA, ROWS = 36, 4
#: Bands of every line, and of one that has fewer than SHORT shingles or may be similar to such a line.
BANDS, SHORT_BANDS = 18, 30
SHORT = 240
MIN_PERCENT = 75
ROUNDS = 1
#: Shingles in a row when minima are taken.
STEP = 8
#: Longs of a line's bitmap.
WORDS = 32
RESULTS = ["n_lines", "n_dropped"]


def _masks(n: int) -> list[int]:
    rng = random.Random(20)
    return [rng.getrandbits(64) - (1 << 63) for _ in range(n)]


def _bands() -> list[list[int]]:
    """The minima of each band.  All stand in equally many bands, give or take one, and two bands have few in common."""
    best = None
    for seed in range(20):
        rng, uses, bands = random.Random(seed), [0] * MINIMA, []
        for _ in range(SHORT_BANDS):
            band = sorted(range(MINIMA), key=lambda i: (uses[i], rng.random()))[:ROWS]
            for i in band:
                uses[i] += 1
            bands.append(sorted(band))
        common = sum(len({*x} & {*y}) ** 3 for i, x in enumerate(bands) for y in bands[:i])
        best = min(best or (common, bands), (common, bands))
    return best[1]


def _lines(docs: DataFrame) -> DataFrame:
    """``(rid, pos, line)`` of the lines that are not blank, normalised."""
    lines = docs.select("rid", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    return lines.select("rid", "pos", F.lower(F.trim("line")).alias("line")).where("line <> ''")


def _keys() -> tuple[Column, Column]:
    return F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2")


def _n_shingles(line: str) -> Column:
    return F.greatest(F.length(line) - SHINGLE + 1, F.lit(1))


def _wide(line: str) -> Column:
    """Four bytes a character, so that a shingle is found at its place."""
    return F.encode(line, "UTF-32")


def _shingle(wide: Column, place) -> Column:
    """Hash of the shingle that begins at a place; of a shorter line itself."""
    return F.xxhash64(F.substring(wide, 4 * place + 1, F.lit(4 * SHINGLE)))


def _set(line: str) -> Column:
    """The distinct shingles of a line.  The outer array has one element, which the inner function holds instead of copying it at every place."""
    def of(wide):
        last = F.greatest(F.octet_length(wide) / 4 - SHINGLE, F.lit(0)).cast("int")
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda p: _shingle(wide, p)))
    return F.transform(F.array(_wide(line)), of)[0]


def _signatures(lines: DataFrame) -> DataFrame:
    """``(k1, k2, n, copies, bands array<long>)`` of each distinct line; ``n``: its shingles, repeated ones too."""
    every = lines.select(*_keys(), "line").groupBy("k1", "k2").agg(F.first("line").alias("line"), F.count("*").alias("copies"))
    rows = every.select("k1", "k2", "copies", _n_shingles("line").cast("int").alias("n"), _wide("line").alias("w"))
    # A row has STEP shingles, so that the group is looked up and its minima are changed once for all of them; after the last place it is taken again.
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STEP))).alias("p"))
    rows = rows.select("k1", "k2", "n", "copies", *(_shingle(F.col("w"), F.least(F.col("p") + j, F.col("n") - 1)).alias(f"h{j}") for j in range(STEP)))

    def low(i, mask):
        # Shifted before it is masked: under masks alone the minima depend on each other, and fewer pairs become candidates.
        return F.min(F.least(*(F.shiftleft(f"h{j}", i).bitwiseXOR(F.lit(mask)) for j in range(STEP)))).alias(f"m{i}")
    least = rows.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.max("copies").alias("copies"), *(low(i, m) for i, m in enumerate(_masks(MINIMA))))
    bands = [F.xxhash64(F.lit(b), *(f"m{i}" for i in band)) for b, band in enumerate(_bands())]
    more = F.when(MIN_PERCENT * F.col("n") < 100 * SHORT, F.array(*bands[BANDS:])).otherwise(F.array().cast("array<bigint>"))
    return least.select("k1", "k2", "n", "copies", F.concat(F.array(*bands[:BANDS]), more).alias("bands"))


def _bitmaps(texts: DataFrame) -> DataFrame:
    """``(lid, d, free, w0, w1, ...)``: a bit is set where a shingle's hash falls, and ``free`` shingles fall on a bit that another one has set."""
    rows = texts.select("lid", "d", _n_shingles("line").cast("int").alias("n"), _wide("line").alias("w"))
    rows = rows.select("lid", "d", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p")).select("lid", "d", _shingle(F.col("w"), F.col("p")).alias("h"))
    place = F.expr(f"cast(pmod(h, {64 * WORDS}) as int)")
    rows = rows.select("lid", "d", F.shiftright(place, 6).alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), place % 64).alias("bit"))
    words = rows.groupBy("lid", "d", "i").agg(F.bit_or("bit").alias("bits")).groupBy("lid", "d") \
        .agg(*(F.coalesce(F.max(F.when(F.col("i") == i, F.col("bits"))), F.lit(0).cast("long")).alias(f"w{i}") for i in range(WORDS)))
    return words.select("lid", "d", (F.col("d") - sum(F.bit_count(f"w{i}") for i in range(WORDS))).alias("free"), *(f"w{i}" for i in range(WORDS)))


def _as(rows: DataFrame, side: str) -> DataFrame:
    return rows.select(*(F.col(c) if c == "band" else F.col(c).alias(side + c) for c in rows.columns))


def _most_common() -> Column:
    """At least as many shingles as the lines x and y have in common: a bit that only one of them has set is a shingle that the other lacks."""
    return F.least("xfree", "yfree") + sum(F.bit_count(F.col(f"xw{i}").bitwiseAND(F.col(f"yw{i}"))) for i in range(WORDS))


def _may_link() -> Column:
    """False only of lines x and y that are surely not similar enough.  Sizes are judged first, which costs least."""
    fit = 100 * F.least("xd", "yd") >= MIN_PERCENT * F.greatest("xd", "yd")
    return fit & ((100 + MIN_PERCENT) * _most_common() >= MIN_PERCENT * (F.col("xd") + F.col("yd")))


def _possible(pairs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` that may link."""
    both = pairs.join(_as(bitmaps, "x"), F.col("a") == F.col("xlid")).join(_as(bitmaps, "y"), F.col("b") == F.col("ylid"))
    return both.where(_may_link()).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets are similar enough.  ``texts``: ``lid, line, d``; ``d`` is the size of the
    line's set, and sets of too unequal sizes are never similar, so their texts are not brought."""
    size = texts.select("lid", "d")
    near = pairs.join(size.toDF("a", "da"), "a").join(size.toDF("b", "db"), "b") \
        .where(100 * F.least("da", "db") >= MIN_PERCENT * F.greatest("da", "db"))
    line = texts.select("lid", "line")
    both = near.join(line.toDF("a", "x"), "a").join(line.toDF("b", "y"), "b").repartition("a", "b")
    both = both.select("a", "b", "da", "db", F.size(F.array_intersect(_set("x"), _set("y"))).alias("c"))
    return both.where(100 * F.col("c") >= MIN_PERCENT * (F.col("da") + F.col("db") - F.col("c"))).select("a", "b")


def _pair(a, b) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(k1, k2, lid, copies)`` of each distinct line, and ``(node, component)`` of the linked ones.
    ``docs``: ``rid, _text``."""
    spark = docs.sparkSession
    lines = _lines(docs)
    signed = written(_signatures(lines).withColumn("lid", F.monotonically_increasing_id()), "line-signatures")
    # Members of the buckets with two classes or more; a bucket's first class, without holding the bucket.
    w = Window.partitionBy("band").orderBy("lid")
    members = signed.select("lid", F.explode("bands").alias("band")) \
        .select("band", "lid", F.first("lid").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lead("lid").over(w).alias("next")) \
        .where("head < lid or next is not null").select("band", "lid", "head")
    members = written(members, "line-buckets")
    classes = written(signed.select("k1", "k2", "lid", "copies"), "line-classes")
    forget(signed, spark)
    drop_shuffles(spark)
    # Texts of the candidates, and the sizes of their sets.
    wanted = written(members.select("lid").distinct().join(classes.drop("copies"), "lid"), "line-candidates")
    near = maybe_among(lines.select(*_keys(), "line"), "k1", key_bitmaps(wanted, "k1"), "maybe").where("maybe")
    near = near.join(wanted, ["k1", "k2"]).groupBy("lid").agg(F.first("line").alias("line"))
    texts = written(near.select("lid", "line", F.size(_set("line")).alias("d")), "line-texts")
    # First each class with the head that it shares the most bands with.
    first = members.where("head < lid").groupBy("lid", "head").agg(F.count("*").alias("c")) \
        .groupBy("lid").agg(F.max_by("head", F.struct(F.col("c"), -F.col("head"))).alias("a")).select("a", F.col("lid").alias("b"))
    tried = [written(first, "line-tried")]
    links = written(_verified(tried[0], texts), "line-links")
    found = connected_components(links)

    def apart(rows: DataFrame) -> DataFrame:
        """``(band, lid, c)`` of the buckets that classes of two components or more share."""
        placed = rows.join(found.withColumnRenamed("node", "lid"), "lid", "left").select("band", "lid", F.coalesce("component", "lid").alias("c"))
        mixed = placed.groupBy("band").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("band")
        return written(placed.join(mixed, "band", "left_semi"), "line-open")

    def untried(pairs: DataFrame) -> DataFrame:
        for t in tried:
            pairs = pairs.join(t, ["a", "b"], "left_anti")
        return pairs
    open_ = apart(members.select("band", "lid"))
    forget(members, spark)
    bitmaps = written(_bitmaps(texts.join(open_.select("lid").distinct(), "lid", "left_semi")), "line-bitmaps")
    for turn in range(ROUNDS):
        # One class of each component in a bucket with one of the bucket's first component, in another order each time.
        one = open_.groupBy("band", "c").agg(F.min_by("lid", F.xxhash64(F.lit(turn), "lid")).alias("lid"))
        w = Window.partitionBy("band").orderBy(F.xxhash64(F.lit(turn), "c"), "c")
        pairs = one.select("c", "lid", F.first("c").over(w).alias("hc"), F.first("lid").over(w).alias("head")).where("c <> hc") \
            .select(F.least("c", "hc").alias("ca"), F.greatest("c", "hc").alias("cb"), *_pair("lid", "head"))
        best = untried(pairs).groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p"))
        tried.append(written(best.select("p.a", "p.b"), "line-tried"))
        new = written(_verified(_possible(tried[-1], bitmaps), texts), "line-links")
        if new.isEmpty():
            break
        links = written(links.union(new), "line-links")
        found = connected_components(links)
        before, open_ = open_, apart(open_.select("band", "lid"))
        forget(before, spark)
    drop_shuffles(spark)
    # All pairs that share a bucket, are not connected yet and may link by their bitmaps, which come along with the members, so that no
    # row is made for the other pairs: of each two components one pair, then those that are still apart.
    rows = open_.join(bitmaps, "lid")
    rows = rows.select(*(F.coalesce(c, F.lit(0)).alias(c) for c in rows.columns))  # no column is null, and the join need not look
    rest = _as(rows, "x").join(_as(rows, "y"), "band").where((F.col("xc") < F.col("yc")) & _may_link()) \
        .select(*_pair("xlid", "ylid"), F.col("xc").alias("ca"), F.col("yc").alias("cb")).distinct()
    rest = written(untried(rest), "line-rest")
    best = written(rest.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.xxhash64("a", "b")).alias("p")).select("p.a", "p.b"), "line-best")
    links = written(links.union(_verified(best, texts)), "line-links")
    found = connected_components(links)
    last = rest.select("a", "b").join(best, ["a", "b"], "left_anti")
    for side in "ab":
        last = last.join(found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side, "left")
    last = last.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    found = connected_components(links.union(_verified(last, texts)))
    for t in (texts, bitmaps, open_, rest, best, wanted, *tried):
        forget(t, spark)
    drop_shuffles(spark)
    return classes, found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns, the text without the lines that go, and ``n_lines, n_dropped`` (blank lines not counted)."""
    docs = docs.drop(*(c for c in RESULTS if c not in (id_col, text_col)))
    rid, maybe, places = (unused(docs, c) for c in ("_rid", "_maybe", "_gone"))
    rows = with_stable_id(docs, "line-docs", rid)
    base = rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    classes, found = line_classes(base.select("rid", "_text"))
    ids = base.select("rid", "doc_id")
    # A line that stands once and is linked with none stays; only the others are placed.
    cls = classes.join(found.withColumnRenamed("node", "lid"), "lid", "left").where("copies > 1 or component is not null") \
        .select("k1", "k2", F.coalesce("component", "lid").alias("c"))
    cls = written(cls, "line-repeated")
    spots = maybe_among(_lines(base).select("rid", "pos", *_keys()), "k1", key_bitmaps(cls, "k1"), "maybe").where("maybe")
    spots = written(spots.join(cls, ["k1", "k2"]).select("rid", "pos", "c").join(ids, "rid"), "line-spots")
    firsts = spots.groupBy("c").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = spots.join(firsts, "c").where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos"))) \
        .groupBy(F.col("rid").alias(rid)).agg(F.collect_list("pos").alias(places))
    gone = written(gone, "line-gone")
    split = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(places, i)), "\n")
    marked = maybe_among(rows, rid, key_bitmaps(gone, rid), maybe)
    n_lines = F.coalesce(F.size(F.filter(split, lambda line: F.trim(line) != "")), F.lit(0))
    touched = marked.where(maybe).join(gone, rid, "left") \
        .withColumns({"n_lines": n_lines, "n_dropped": F.coalesce(F.size(places), F.lit(0))}) \
        .withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept))
    whole = marked.where(~F.col(maybe)).withColumns({"n_lines": n_lines, "n_dropped": F.lit(0)})
    names = [*rows.columns, *RESULTS]
    return touched.select(*names).union(whole.select(*names)).drop(rid)
