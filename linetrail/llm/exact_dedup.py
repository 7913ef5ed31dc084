"""Exact duplicates by deterministic block naming.

Texts (A-Z lower-cased, as UTF-8) are cut into blocks of ``BLOCK`` bytes.
The distinct blocks are sorted and numbered: a block's number is its name.
Then names of neighbouring blocks are paired, the distinct pairs sorted and
numbered again, and so on until every document has one name.  Two documents
are equal if and only if they have as many blocks and the same last name:
names stand for contents, so nothing rests on a hash being free of
collisions.  Hashes only carry names back to the rows; a hash that two
contents share is found, and its blocks are matched by content instead.

Copies are reduced to one block before the shuffle (map-side), and rows that
travel with the names are a few bytes, so a large group of copies does not
fill one task.

Defined results: null text counts as empty, and empty texts are equal; of
equal texts the largest ``doc_id`` stays, and among rows that share it the
last one read (exactly one row of a group is ``kept``); a null ``doc_id`` is
smaller than any other; an empty table gives no row; further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, lower_az, with_stable_id, written

BLOCK = 8192
_NONE = -(1 << 63)  # no name: the right half of a last, odd block


def _blocks(docs: DataFrame, id_col: str, text_col: str, block: int) -> DataFrame:
    """``(rid, doc_id, n, pos, sha, block)``: one row for each block, ``sha`` at ``pos`` 0."""
    rows = docs.select(F.col("_rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.select("rid", "doc_id", F.encode(lower_az(F.coalesce("text", F.lit(""))), "UTF-8").alias("all")) \
        .withColumn("n", F.greatest(F.lit(1), F.ceil(F.length("all") / block)).cast("int"))
    rows = rows.select("rid", "doc_id", "n", "all", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos"))
    return rows.select("rid", "doc_id", "n", "pos", F.when(F.col("pos") == 0, F.sha2("all", 256)).alias("sha"),
                       F.substring("all", F.col("pos") * block + 1, F.lit(block)).alias("block"))


def _numbered(distinct: DataFrame, *cols: str) -> DataFrame:
    """Each row's place in the sorted partition as its name."""
    return distinct.sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id())


def name_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                   hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(rid, doc_id, sha, n, name)``: documents are equal where ``(n, name)`` is."""
    spark = docs.sparkSession
    docs = with_stable_id(docs.select(id_col, text_col), "block-docs", "_rid")
    blocks = _blocks(docs, id_col, text_col, block).withColumn("h", hashed(F.col("block")))
    # 1. Names of the distinct blocks; hashes with two contents apart.
    names = written(_numbered(blocks.groupBy("h", "block").agg(F.count("*").alias("n")).drop("n"), "h", "block")
                    .select("h", "name").groupBy("h").agg(F.min("name").alias("name"), F.count("*").alias("contents")), "block-names")
    rows = blocks.drop("block").join(names, "h")
    shared = names.where("contents > 1").select("h")
    if not shared.isEmpty():
        same_hash = blocks.join(shared, "h", "left_semi")
        apart = _numbered(same_hash.select("h", "block").distinct(), "h", "block").withColumn("name", -1 - F.col("name"))
        by_content = same_hash.join(apart, ["h", "block"]).select("rid", "pos", F.col("name").alias("own"))
        rows = rows.join(by_content, ["rid", "pos"], "left").withColumn("name", F.coalesce("own", "name"))
    rows = written(rows.select("rid", "doc_id", "n", "pos", "sha", "name"), "block-rows")
    # 2. Names of pairs, until one is left.
    most = rows.agg(F.max("n")).first()[0] or 0
    done = [rows.where("n = 1").select("rid", "n", "name")]
    now, width = rows.where("n > 1").select("rid", "n", "pos", "name"), 1
    while width < most:
        width *= 2
        half = F.col("pos") % 2 == 0
        pairs = now.groupBy("rid", "n", F.expr("pos div 2").cast("int").alias("pos")) \
            .agg(F.max(F.when(half, F.col("name"))).alias("l"),
                 F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(_NONE)).alias("r"))
        named = _numbered(pairs.select("l", "r").distinct(), "l", "r")
        level = written(pairs.join(named, ["l", "r"]).select("rid", "n", "pos", "name"), "pair-rows")
        done.append(level.where(F.col("n") <= width).select("rid", "n", "name"))
        now = level.where(F.col("n") > width)
    last = done[0]
    for x in done[1:]:
        last = last.union(x)
    forget(names, spark)
    return rows.where("pos = 0").select("rid", "doc_id", "sha").join(last, "rid")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK,
                     hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each input row."""
    named = name_documents(docs, id_col, text_col, block, hashed)
    groups = named.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "rid")).alias("keep")) \
        .where("group_size > 1")
    return named.join(groups, ["n", "name"], "left") \
        .select("doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"))
