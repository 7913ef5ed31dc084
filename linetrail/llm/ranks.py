"""Places of rows in a sorted order, without one task that sees them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_IN_PART = (1 << 33) - 1


def ranked(rows: DataFrame, group: list[str], order: list[str], table_name: str, rank: str = "rank", total: str = "n") -> DataFrame:
    """``rows`` as a written table with ``rank``, each row's place from 0 in its ``group`` by ``order`` (nulls
    first, text bytewise), and ``total``, the rows of its group.

    The rows are sorted by range, so a group of any size spreads over tasks, and each part's count of a group gives the
    offset of the next.  There are at most parts + groups counts.  Rows equal in ``order`` stand in any order, so all that
    tells rows apart should be in it.
    """
    placed = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order) \
        .withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PART)))
    placed = written(placed, table_name)
    w = Window.partitionBy(*(group or [F.lit(0)]))
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_m"), F.min("_place").alias("_first"))
    counts = counts.withColumn(total, F.sum("_m").over(w)) \
        .withColumn("_offset", F.coalesce(F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    counts = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), "_offset", "_first", total)
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)], F.col("_part") == F.col("_p"))
    return placed.join(counts, same).withColumn(rank, F.col("_place") - F.col("_first") + F.col("_offset")) \
        .select(*rows.columns, rank, total)
