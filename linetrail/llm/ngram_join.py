"""Exact Jaccard join of whole texts on word shingles, by signature trees.

1. Each text becomes the set of its distinct shingles.  Equal sets are one
   class; one document stands for it.
2. Sets that are similar enough share a shingle among the first quarter or so of
   their shingles in any common order (prefix filter), so those alone
   are shuffled.  The order puts widespread shingles last; it only decides how much work is done.
3. Blocks: each set with the first set of a shingle that it shares.  In a
   block a signature tree of bitmaps is traversed against itself; sets without a possible partner go.  The texts of the others
   are brought, their tree is traversed, and exact sizes of the intersections decide.
   What is linked is connected by distributed union-find.
4. Shingles that sets of different components still share: a few components
   are compared in pairs, tree against tree, up to their first link; where many share a shingle, in one tree.  So no
   pair that shares a prefix shingle is left out, and a large group of similar texts costs
   about one comparison a text.

Blocks are split by number of sets and by total size, so no group is gathered in
one task.  Only counts and a bounded table of widespread shingles reach the
driver.

Defined results: texts without words (null and empty ones too) have an empty set and link
with nothing; ``component`` is the smallest non-null id that can be reached; rows that
repeat an id are documents of their own; an empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import signature_tree
from .common import forget, key_bitmaps, maybe_among, tidy, unused, with_stable_id, written
from .components import connected_components
from .shingles import shingle_sets

BLOCK_SETS = 512
BLOCK_SHINGLES = 1_000_000
#: Shingles that are put last in the order: those that the most documents of a partition share.
WIDESPREAD = 200_000
WIDESPREAD_LEAST = 2
#: Components that share a shingle are compared in pairs up to this number, else as one block.
FEW = 8


def _some(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _sized(docs: DataFrame, n: int) -> DataFrame:
    """``(rid, doc_id, size, key, bits)`` of each document (``bits``: size and bitmap), and from each partition one row whose ``hot``
    holds the shingles that several of its documents share, with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0
        tokens, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            every = np.concatenate([tokens, *seen])
            ones = np.concatenate([counts, np.ones(len(every) - len(counts), np.int64)])
            u, back = np.unique(every, return_inverse=True)
            return u, np.bincount(back, ones, len(u)).astype(np.int64)
        for whole in batches:
            for batch in _some(whole):
                sets = shingle_sets(batch.column("text").to_pylist(), n)
                seen += sets
                held += sum(map(len, sets))
                if held > 4_000_000:  # what one document alone has is let go
                    tokens, counts = merged()
                    keep = counts > 1
                    tokens, counts, seen, held = tokens[keep], counts[keep], [], 0
                yield pa.RecordBatch.from_arrays([
                    batch.column("rid"), batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s).to_bytes(8, "little") + signature_tree.bitmap(s, signature_tree.bits_for(len(s))).tobytes() for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.binary())], ["rid", "doc_id", "size", "key", "bits", "hot"])
        tokens, counts = merged()
        keep = counts >= WIDESPREAD_LEAST
        hot = np.stack([tokens[keep].view(np.int64), counts[keep]], 1).tobytes()
        one = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([one, one, one, pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.array([hot], pa.binary())],
                                         ["rid", "doc_id", "size", "key", "bits", "hot"])
    return docs.mapInArrow(tidy(run), "rid long, doc_id long, size long, key binary, bits binary, hot binary")


def _widespread(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``WIDESPREAD`` shingles with the most documents, sorted, and their place in the order."""
    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column("hot").to_pylist():
                x = np.frombuffer(b, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["t", "n"])
    rows = sized.where("hot is not null").select("hot").mapInArrow(unpack, "t long, n long") \
        .groupBy("t").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "t").limit(WIDESPREAD).toPandas()
    t = rows["t"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(t)
    return t[by], rows["n"].to_numpy(np.int64)[by]


def prefix_length(size: int, percent: int) -> int:
    """Sets of this size and any other that are similar enough share one of so many first shingles."""
    return size - -(-percent * size // 100) + 1


def _prefixes(docs: DataFrame, wide: tuple[np.ndarray, np.ndarray], n: int, percent: int) -> DataFrame:
    """``(rid, prefix array<long>)``."""
    shared = docs.sparkSession.sparkContext.broadcast(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        for whole in batches:
            for batch in _some(whole):
                out = []
                for s in shingle_sets(batch.column("text").to_pylist(), n):
                    k = prefix_length(len(s), percent) if len(s) else 0
                    if len(tokens) and k:
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        rank = np.where(tokens[at] == s, counts[at], 0)
                        s = s[np.argsort(rank, kind="stable")]
                    out.append(s[:k].view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, pa.list_(pa.int64()))], ["rid", "prefix"])
    return docs.mapInArrow(tidy(run), "rid long, prefix array<long>")


def _without_copies(docs: DataFrame, sized: DataFrame, reps: DataFrame) -> DataFrame:
    """``docs`` but for those whose set another one stands for.  Only what may be such a copy is shuffled."""
    copies = written(sized.where("size > 0").select("rid").join(reps.select("rid"), "rid", "left_anti"), "join-copies")
    marked = maybe_among(docs, "rid", key_bitmaps(copies, "rid"), "maybe")
    return marked.where("maybe").join(copies, "rid", "left_anti").select(*docs.columns).union(marked.where("not maybe").select(*docs.columns))


def _groups(rows: DataFrame) -> DataFrame:
    """``(t, rid, head)`` of the shingles that two sets or more share; ``head`` is the first of them."""
    w = Window.partitionBy("t").orderBy("rid")
    return rows.select("t", "rid", F.first("rid").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("head"), F.lead("rid").over(w).alias("next")) \
        .where("head < rid or next is not null").select("t", "rid", "head")


def _by_block(rows: DataFrame, payload: str, solve, out: str) -> DataFrame:
    """``solve(key, rids, sides, payloads)`` -> lists of the columns of ``out``, for each block ``(x, y, z)`` in turn."""
    names = [c.split(" ")[0] for c in out.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, results = None, ([], [], []), []

        def close():
            if block[0]:
                results.append(solve(now, *block))

        def batch():
            columns = [[v for r in results for v in r[i]] for i in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
        for whole in batches:
            for some in _some(whole):
                keys = zip(*(some.column(c).to_pylist() for c in "xyz"))
                for key, *row in zip(keys, *(some.column(c).to_pylist() for c in ("rid", "side", payload))):
                    if key != now:
                        close()
                        now, block = key, ([], [], [])
                    for part, value in zip(block, row):
                        part.append(value)
            yield batch()
            results = []
        close()
        yield batch()
    return rows.select("x", "y", "z", "rid", "side", payload).repartition("x", "y", "z") \
        .sortWithinPartitions("x", "y", "z").mapInArrow(tidy(run), out)


def _tree_links(blocks: DataFrame, maps: DataFrame, docs: DataFrame, n: int, percent: int, sided: bool) -> DataFrame:
    """Links ``(a, b)`` found within each block of ``blocks(x, y, z, rid, side)``, written; with ``sided`` across sides alone.
    ``maps``: ``rid, bits``."""
    def may(key, rids, sides, data):
        bitmaps = [np.frombuffer(b[8:], np.uint64) for b in data]
        size = np.array([int.from_bytes(b[:8], "little") for b in data])
        keep = signature_tree.candidates(bitmaps, size, np.array(sides) if sided else None, percent).nonzero()[0]
        return [*([v] * len(keep) for v in key), [rids[i] for i in keep], [sides[i] for i in keep]]

    def link(key, rids, sides, texts):
        if len(rids) < 2:
            return [], []
        found = signature_tree.links(shingle_sets(texts, n), sides if sided else None, percent)
        return [rids[i] for i, _ in found], [rids[j] for _, j in found]
    left = written(_by_block(blocks.join(maps, "rid"), "bits", may, "x long, y long, z long, rid long, side long"), "join-may")
    near = maybe_among(docs.select("rid", "text"), "rid", key_bitmaps(left.select("rid").distinct(), "rid"), "maybe").where("maybe")
    found = written(_by_block(left.join(near, "rid"), "text", link, "a long, b long"), "join-links")
    forget(left, docs.sparkSession)
    return found


def _pieces(of: str = "rid"):
    """Number of the block's part that a set falls in; ``parts`` of them."""
    return F.pmod(F.xxhash64(of), F.col("parts"))


def _parts(sets: str, shingles: str):
    return F.greatest(F.lit(1), F.ceil(F.col(sets) / BLOCK_SETS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("long")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """``(rid, doc_id, n_shingles, root, component)``, one row for each input row: ``rid`` is its place in the
    input, ``root`` the same for all rows of a component and no others, ``component`` their smallest id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return _components(with_stable_id(docs, "join-docs").select("rid", "doc_id", "text"), n, percent)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` but for those whose component has another with a smaller id (of equal ids, an earlier row)."""
    rid, maybe = unused(docs, "_rid"), unused(docs, "_maybe")
    rows = with_stable_id(docs, "join-docs", rid)
    found = _components(rows.select(F.col(rid).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), n, percent)
    found = written(found.select("rid", "doc_id", "root"), "join-found")
    stays = found.groupBy("root").agg(F.min(F.struct("doc_id", "rid")).alias("stays"), F.count("*").alias("c")).where("c > 1")
    gone = written(found.join(stays, "root").where("rid <> stays.rid").select(F.col("rid").alias(rid)), "join-gone")
    marked = maybe_among(rows, rid, key_bitmaps(gone, rid), maybe)
    left = marked.where(maybe).join(gone, rid, "left_anti").select(*rows.columns)
    return left.union(marked.where(~F.col(maybe)).select(*rows.columns)).drop(rid)


def _components(docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    sized = written(_sized(docs, n), "join-sizes")
    wide = _widespread(sized)
    sized = sized.where("rid is not null").drop("hot")
    maps = sized.select("rid", "bits")
    # 1. Classes of equal sets.
    classes = written(sized.where("size > 0").groupBy("key").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least"), F.first("size").alias("size")),
                      "join-classes")
    reps = classes.select(F.col("rep").alias("rid"), "size")
    # 2. Sets that share a prefix shingle, and the first of those that do.
    prefixes = _prefixes(_without_copies(docs.select("rid", "text"), sized, reps), wide, n, percent)
    shared = written(_groups(prefixes.select("rid", F.explode("prefix").alias("t"))), "join-shared")
    # 3. One block for each first set.
    first = shared.where("head < rid").groupBy("rid").agg(F.min("head").alias("x")).join(reps, "rid")
    blocks = first.groupBy("x").agg(F.count("*").alias("m"), F.sum("size").alias("s"))
    blocks = first.join(blocks, "x").withColumn("parts", _parts("m", "s")).withColumn("z", _pieces())
    blocks = blocks.select("x", F.lit(0).cast("long").alias("y"), "z", "rid", F.lit(0).cast("long").alias("side"))
    blocks = blocks.union(blocks.select("x", "y", "z", F.col("x").alias("rid"), "side").distinct())
    links = _tree_links(blocks, maps, docs, n, percent, False)
    found = connected_components(links)
    # 4. Components that still share a shingle, in pairs.
    placed = shared.select("t", "rid").join(found.withColumnRenamed("node", "rid"), "rid", "left") \
        .select("t", "rid", F.coalesce("component", "rid").alias("c"))
    mixed = placed.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t")
    open_ = written(placed.join(mixed, "t", "left_semi").join(reps, "rid"), "join-open")
    forget(shared, spark)
    comps = written(open_.groupBy("t", "c").agg(F.min("size").alias("lo"), F.max("size").alias("hi")), "join-comps")
    tokens = comps.groupBy("t").agg(F.count("*").alias("n")).join(
        open_.groupBy("t").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("rid")).alias("who")), "t")
    few = comps.join(tokens.where(F.col("n") <= FEW).select("t"), "t")
    pairs = few.select("t", F.col("c").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi")) \
        .join(few.select("t", F.col("c").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi")), "t") \
        .where(f"x < y and 100 * xhi >= {percent} * ylo and 100 * yhi >= {percent} * xlo").select("t", "x", "y")
    across = [open_.join(pairs, "t").where(F.col("c") == F.col(s)).select("x", "y", "rid", "size", F.lit(i).cast("long").alias("side"))
              for i, s in enumerate("xy")]
    across = written(across[0].union(across[1]).distinct(), "join-across")
    sides = across.groupBy("x", "y", "side").agg(F.count("*").alias("m"), F.sum("size").alias("s")).withColumn("parts", _parts("m", "s"))
    other = sides.select("x", "y", (1 - F.col("side")).alias("side"), F.col("parts").alias("others"))
    tiles = across.join(sides.select("x", "y", "side", "parts"), ["x", "y", "side"]).join(other, ["x", "y", "side"]) \
        .withColumn("own", _pieces()).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    tiles = tiles.withColumn("z", F.when(F.col("side") == 0, F.col("own") * F.col("others") + F.col("o"))
                             .otherwise(F.col("o") * F.col("parts") + F.col("own"))).select("x", "y", "z", "rid", "side")
    # A shingle that many components share is a block of its own, the same for all shingles of the same sets.
    crowd = open_.join(tokens.where(F.col("n") > FEW).select("t", F.col("who").alias("x"), (-F.col("m")).alias("y")), "t") \
        .select("x", "y", "rid", "size", F.col("c").alias("side")).distinct()
    crowd = written(crowd, "join-crowd")
    for t in (open_, comps):  # tiles read what is written from them
        forget(t, spark)
    parts = crowd.groupBy("x", "y").agg(F.count("*").alias("m"), F.sum("size").alias("s")).withColumn("parts", _parts("m", "s"))
    crowd_tiles = crowd.join(parts.select("x", "y", "parts"), ["x", "y"]).withColumn("own", _pieces()) \
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    crowd_tiles = crowd_tiles.withColumn("z", F.least("own", "o") * F.col("parts") + F.greatest("own", "o")).select("x", "y", "z", "rid", "side")
    tiles = tiles.union(crowd_tiles)
    more = _tree_links(tiles, maps, docs, n, percent, True)
    found = connected_components(links.union(more))
    # Back to all documents.
    named = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    least = named.groupBy("c").agg(F.min("least").alias("smallest"))
    named = named.join(least, "c").select("key", "smallest", F.col("c").alias("root"))
    for t in (links, more, across, crowd):
        forget(t, spark)
    empty = sized.where("size = 0").select("rid", "doc_id", F.col("size").alias("n_shingles"), F.col("rid").alias("root"), F.col("doc_id").alias("component"))
    return sized.where("size > 0").join(named, "key") \
        .select("rid", "doc_id", F.col("size").alias("n_shingles"), "root", F.col("smallest").alias("component")) \
        .union(empty)
