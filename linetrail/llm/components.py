"""Connected components of a link table by alternating large and small stars.

Each round is two joins on the smaller end of the links.  Links only ever
move to smaller ends, and after the last round every node links to the
smallest node that it can reach.  No link is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links(a long, b long)`` -> ``(node, component)``.

    ``component`` is the smallest node reachable.  Nodes without links, and
    links with a null end or to themselves, give no row.
    """
    spark = links.sparkSession
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, state = written(e, "links"), None
    for _ in range(max_rounds):
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b") % 1000003)).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        step = written(_small_star(_large_star(e)), "links")
        forget(e, spark)
        e = step
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
