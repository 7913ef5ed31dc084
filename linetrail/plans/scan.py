"""Per-key running numbers, sums and previous values that never put one
hot key in one task.

A window partitioned by a key sends all rows of that key to one task.  Here
a key of more than ``chunk_rows`` rows is cut into contiguous chunks; every
chunk is scanned on its own, and offsets of the chunks before it are added.
The borders of a hot key are taken from a sample of its rows by hash, in the whole
order, so outliers, ties in the first column and orders by text are cut
evenly too.  The chunk of a row depends on the row and its key's rows alone:
retries, lost executors and a plan read twice assign the same one.
All of this is part of the plan; nothing runs while it is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of one key scanned by one task.  The table of hot keys and its borders
# have at most rows / CHUNK_ROWS entries each, which bounds what is broadcast.
CHUNK_ROWS = 4_000_000
# Sampled rows for each chunk.
PROBES = 32
# Borders that a row is compared with at a time: it finds its chunk in three steps, each among a few borders only.
FAN = 32


def _borders(df: DataFrame, key: list[str], place, chunk_rows: int) -> DataFrame:
    """``key, _borders``: of the keys with more than ``chunk_rows`` rows, the first place of each chunk but the first."""
    step = max(1, chunk_rows // PROBES)
    probe = F.when(F.pmod(F.xxhash64(place), F.lit(step)) == 0, place)
    hot = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.collect_list(probe).alias("_p")).where(F.col("_n") > int(chunk_rows))
    # As many chunks as the count asks for, evenly over the sample.  Places are counted in bigint: chunks times sampled rows pass an int.
    hot = hot.withColumn("_p", F.sort_array("_p")).withColumn("_c", F.ceil(F.col("_n") / int(chunk_rows)).cast("int"))
    at = F.transform(F.sequence(F.lit(1), F.col("_c") - 1), lambda i: F.get("_p", F.floor(i.cast("bigint") * F.size("_p") / F.col("_c")).cast("int")))
    return hot.select(*key, F.filter(at, lambda b: b.isNotNull()).alias("_borders"))


def _chunked(df: DataFrame, key: list[str], place, borders: DataFrame) -> DataFrame:
    """``df`` with ``_chunk``, how many of its key's borders are not after the row's place; null if the key is not hot.

    The borders form a tree: every FAN * FAN-th at the top, below each of them every FAN-th, then those in between.  A row meets
    one short array in each step, so it never carries all borders of its key."""
    borders = borders.select(*key, F.posexplode_outer("_borders").alias("_i", "_border")).withColumn("_i", F.col("_i") + 1)
    for level in (FAN * FAN, FAN, 1):
        up = level * FAN if level < FAN * FAN else None
        node = F.lit(0) if up is None else F.floor(F.col("_i") / up).cast("int")
        mine = F.col("_i") % level == 0 if up is None else (F.col("_i") % level == 0) & (F.col("_i") % up != 0)
        found = F.sort_array(F.collect_list(F.when(mine, F.col("_border")))).alias("_b")
        # A hot key has a row at the top even if all its borders stand below; elsewhere no row means no border.
        arrays = borders.groupBy(*key) if up is None else borders.where(mine).groupBy(*key, node.alias("_node"))
        arrays = F.broadcast(arrays.agg(found))
        passed = F.coalesce(F.size(F.filter("_b", lambda b: b <= place)), F.lit(0))
        if up is None:
            df = df.join(arrays, key, "left").withColumn("_chunk", F.when(F.col("_b").isNotNull(), passed * level))
        else:
            df = df.withColumn("_node", F.floor(F.col("_chunk") / up).cast("int")).join(arrays, [*key, "_node"], "left") \
                .withColumn("_chunk", F.col("_chunk") + passed * level).drop("_node")
        df = df.drop("_b")
    return df


def keyed_scan(df: DataFrame, key: list[str], order: list[str], *,
               number: str | None = None, running_sum=None,
               previous: tuple[str, str] | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add, per key in ``order`` (column names; rows of a key must be unique by them):

    * ``number``: 1-based row number;
    * ``running_sum=(src, out)`` or a list of such pairs: sum of ``src`` over
      the rows *before* this one;
    * ``previous=(src, out)``: ``src`` of the row before (null for the first).
    """
    sums = [] if running_sum is None else ([running_sum] if isinstance(running_sum, tuple) else list(running_sum))
    names = df.columns
    place = F.struct(*[F.col(c) for c in order])
    r = _chunked(df, key, place, _borders(df, key, place, chunk_rows))
    # Offsets of the chunks of hot keys.
    aggs = [F.count(F.lit(1)).alias("_cnt")]
    aggs += [F.sum(src).alias(f"_csum{i}") for i, (src, _) in enumerate(sums)]
    if previous:
        aggs.append(F.max_by(F.col(previous[0]), place).alias("_clast"))
    chunks = r.where("_chunk is not null").groupBy(*key, "_chunk").agg(*aggs)
    wc = Window.partitionBy(*key).orderBy("_chunk")
    before = wc.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("_ocnt", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    for i in range(len(sums)):
        chunks = chunks.withColumn(f"_osum{i}", F.coalesce(F.sum(f"_csum{i}").over(before), F.lit(0)))
    if previous:
        chunks = chunks.withColumn("_oprev", F.lag("_clast").over(wc))
    keep = [*key, "_chunk", "_ocnt"] + [f"_osum{i}" for i in range(len(sums))] + (["_oprev"] if previous else [])
    # Each chunk is scanned on its own; cold keys are one chunk without offsets.
    w = Window.partitionBy(*key, "_chunk").orderBy(*order)
    r = r.withColumn("_chunk", F.coalesce("_chunk", F.lit(0))).withColumn("_lrn", F.row_number().over(w))
    for i, (src, _) in enumerate(sums):
        r = r.withColumn(f"_lcum{i}", F.coalesce(F.sum(src).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if previous:
        r = r.withColumn("_lprev", F.lag(previous[0]).over(w))
    out = r.join(F.broadcast(chunks.select(*keep)), [*key, "_chunk"], "left")
    if number:
        out = out.withColumn(number, (F.col("_lrn") + F.coalesce(F.col("_ocnt"), F.lit(0))).cast("bigint"))
    for i, (_, dst) in enumerate(sums):
        out = out.withColumn(dst, F.col(f"_lcum{i}") + F.coalesce(F.col(f"_osum{i}"), F.lit(0)))
    if previous:
        out = out.withColumn(previous[1], F.when(F.col("_lrn") == 1, F.col("_oprev")).otherwise(F.col("_lprev")))
    added = ([number] if number else []) + [dst for _, dst in sums] + ([previous[1]] if previous else [])
    return out.select(*[c for c in names if c not in added], *added)
