"""Document fingerprints: bottom-k sketches of word shingles.

The sketch of a set is the ``K`` smallest of its members' 64-bit hashes, in ascending order.  Sketches merge: the ``K``
smallest hashes of two sketches are the sketch of the union, so documents may be sketched part by part and
sources document by document.  Of two sketches, the share of the ``K`` smallest of the union that lie in both
estimates the resemblance (Jaccard) without bias, with a standard error under ``1 / (2 sqrt(K))``, 0.045; below
``K`` shingles in the union it is exact.  The place of the ``K``-th hash estimates how many distinct shingles there are.

A document's shingles are its runs of five words (A-Z lower-cased, cut at blanks and tabs to carriage returns); a shorter
text is one shingle, a text without words has none.  All of it is SQL expressions on whole texts.

Defined results: null text counts as empty; empty sketches resemble each other (1.0) and nothing else (0.0); equal texts have equal
sketches, in whatever place they stand; null ids come first; rows with one id are ordered by their texts; equal rows are
alike, so which of them comes first makes no difference; an empty table gives no row; further columns pass by unread.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_az

#: Hashes of a sketch.
K = 128
#: Words of a shingle.
WORDS = 5
#: Bytes of text that one window holds at a time, about; it spills beyond memory.
WINDOW_BYTES = 256 << 20
_SPAN = 2.0 ** 64


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of the shingles of a text, as often as they stand there."""
    found = F.filter(F.split(lower_az(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")

    def of(h):
        n = F.size(h)
        runs = F.transform(F.sequence(F.lit(1), n - (words - 1)), lambda i: F.xxhash64(*(F.element_at(h, i + j) for j in range(words))))
        return F.when(n >= words, runs).when(n > 0, F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))) \
            .otherwise(F.array().cast("array<bigint>"))
    return _bound(F.transform(found, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The sketch of a text's shingles: ascending distinct hashes, ``k`` at most."""
    return _bound(shingle_hashes(text, words), lambda h: _smallest(h, k))


def _smallest(hashes: Column, k: int) -> Column:
    """The ``k`` smallest distinct hashes.  Of many, those under a line that four times as many as wanted should pass are sorted
    alone, and all of them only if too few do."""
    def pick(h):
        return F.slice(F.array_sort(F.array_distinct(h)), 1, k)
    line = (F.lit(-(1 << 63)).cast("double") + _SPAN * 4 * k / F.size(hashes)).cast("bigint")
    few = _bound(F.filter(hashes, lambda x: x < line), pick)
    return F.when(F.size(hashes) > 16 * k, _bound(few, lambda f: F.when(F.size(f) == k, f).otherwise(pick(hashes)))).otherwise(pick(hashes))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two sketched sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``by, sketch``: the sketch of all sets of each group.  Every task keeps ``k`` hashes of a group, so a group of any
    size meets in one task with ``k`` hashes of each."""
    seen = df.select(*by, F.explode(sketch_col).alias("_h"))
    w = Window.partitionBy(*by).orderBy("_h")
    least = seen.withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k).groupBy(*by) \
        .agg(F.array_sort(F.collect_set("_h")).alias(sketch_col))
    groups = df.select(*by).distinct()
    same = [groups[c].eqNullSafe(least[c]) for c in by]
    return groups.join(least, same, "left").select(*(groups[c] for c in by), F.coalesce(sketch_col, F.array().cast("array<bigint>")).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of two sketched sets, from 0 to 1."""
    least = merged(a, b, k)
    return _bound(least, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of members: exact under ``k``, else from the place of the ``k``-th smallest hash."""
    place = (F.element_at(a, -1).cast("double") + _SPAN / 2 + 1) / _SPAN
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the members of ``a`` that are in ``b``, from 0 to 1; 1 if ``a`` has none."""
    both = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def from_text(c: Column) -> Column:
    """The inverse of ``as_text``."""
    digits = F.regexp_extract_all(c, F.lit("([0-9A-F]{16})"), 1)

    def number(d):
        high, low = (F.conv(F.substring(d, at, 8), 16, 10).cast("bigint") for at in (1, 9))
        return F.shiftleft(high, 32).bitwiseOR(low)
    return F.transform(digits, number)


def _place(id_value: Column, text: Column) -> Column:
    """The id and the text's hash as 32 hexadecimal digits in the same order; a null id comes first."""
    def digits(x):
        return F.lpad(F.hex(x.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(digits(F.coalesce(id_value.cast("bigint"), F.lit(-(1 << 63)))), digits(F.xxhash64(text)))


def _bucket(place: Column, borders: Column, n: int) -> Column:
    """How many of the ``n`` ascending ``borders`` are at or before ``place``, by coarse steps first."""
    step = max(1, isqrt(n))
    heads = F.transform(F.sequence(F.lit(0), F.lit((n - 1) // step)), lambda i: F.element_at(borders, i * step + 1))
    coarse = F.size(F.filter(heads, lambda b: b <= place))
    rest = F.slice(borders, F.greatest(coarse - 1, F.lit(0)) * step + 1, step)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + F.size(F.filter(rest, lambda b: b <= place))).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None,
              window_bytes: int = WINDOW_BYTES, least_windows: int | None = None) -> DataFrame:
    """``id, text, next_text``, and each of ``carry`` (name to an expression over ``docs``) with its ``next_`` value:
    every row with the one that follows it by ascending id; after the last comes the first.

    Rows are dealt once, into ranges of ids.  A range's first rows also go to the range before it, where they end the
    window, so that no window spans two ranges and no table is joined.  There is a range for ``window_bytes`` of text, and four for each
    shuffle partition at least; the driver holds a border of 32 bytes for each.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = _place(F.col(id_col), text)
    light = docs.select(place.alias("p"), F.octet_length(text).alias("size"))
    size, least, rows_in = light.agg(F.sum("size"), F.min("p"), F.count("*")).first()
    least_windows = least_windows or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    n = min(rows_in, max(least_windows, (size or 0) // window_bytes + 1))
    borders = []
    if n > 1:
        parts = light.select("p").repartitionByRange(n, "p").groupBy(F.spark_partition_id().alias("part")).agg(F.min("p").alias("p"))
        borders = sorted(r.p for r in parts.collect())[1:]
    held = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), place.alias("p"), *(c.alias(h) for h, c in zip(held, carry.values())))
    known = F.split(F.lit(",".join(borders)), ",")
    rows = rows.withColumn("bucket", _bucket(F.col("p"), known, len(borders)) if borders else F.lit(0))
    first = F.when(F.col("bucket") == 0, F.col("p") == F.lit(least)).otherwise(F.col("p") == F.get(known, F.col("bucket") - 1))
    before = F.when(F.col("bucket") == 0, F.lit(len(borders))).otherwise(F.col("bucket") - 1)
    own, ahead = (F.struct(b.alias("bucket"), F.lit(i).alias("last")) for i, b in enumerate((F.col("bucket"), before)))
    rows = rows.withColumn("at", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own)))) \
        .select("id", "text", "p", *held, "at.bucket", "at.last")
    w = Window.partitionBy("bucket").orderBy("last", "p", "text")
    rows = rows.select("*", *(F.lead(c).over(w).alias("next_" + c) for c in ("text", *held)))
    return rows.where("last = 0").select(F.col("id").alias(id_col), "text", "next_text", *(F.col(h).alias(c) for h, c in zip(held, carry)),
                                         *(F.col(f"next_{h}").alias(f"next_{c}") for h, c in zip(held, carry)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """``id, n_chars, sketch, n_shingles``: the sketch of every whole text and the estimated number of its distinct shingles."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    return rows.select(F.col("id").alias(id_col), F.length("text").cast("bigint").alias("n_chars"), "sketch", distinct_count(F.col("sketch"), k).alias("n_shingles"))


def edit_audit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """How the fingerprints answer to edits: ``id, n_chars, edited, sketch, edited_sketch, near_edited, near_next``.

    ``edited``: the text with its second half (of an odd number of characters, the smaller one) replaced by as many
    characters of the next document, or all that it has.  Hashes travel with the texts, so every text is sketched once
    and every edited one once.
    """
    rows = with_next(docs, id_col, text_col, {"sketch": sketch(F.coalesce(text_col, F.lit("")), k)}, window_bytes)
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.select(id_col, "n_chars", "sketch", "next_sketch", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - cast(n_chars div 2 as int))"),
                                                                             F.substring("next_text", F.lit(1), half)).alias("edited"))
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(id_col, "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                       resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
