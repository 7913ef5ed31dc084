"""Helpers shared by the operators of this package.

Intermediate tables are written under the shared folder of the session
(``spark.checkpoint.dir``), so a lost executor never takes results with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_table_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for one intermediate table in the shared folder."""
    return scratch_table_path(spark, f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df_or_path, spark: SparkSession) -> None:
    """Delete an intermediate table that no later plan reads."""
    paths = [df_or_path] if isinstance(df_or_path, str) else \
        {f.rsplit("/", 1)[0] for f in df_or_path.inputFiles()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def drop_shuffles(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files once the driver's JVM has collected the plan that made it, often long after its last use;
    this lets it do so between the steps of a long job.  Plans still held keep their files."""
    import gc
    gc.collect()
    spark._jvm.System.gc()


def give_back() -> None:
    """Return what a Python worker has freed to the system.  Workers are used again, and what one operator's tasks held would
    otherwise count beside the next one's."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def tidy(run):
    """A ``mapInArrow`` function that gives memory back when its task ends."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str = "rid") -> DataFrame:
    """One distinct long for each row, by its place in the input.  Where a plan
    reads ``df`` more than once, it has to be ``with_stable_id``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def _from_parquet(df: DataFrame) -> bool:
    """Whether the rows come straight from Parquet files, each read once."""
    nodes, plain = [df._jdf.queryExecution().analyzed()], True
    while nodes and plain:
        node = nodes.pop()
        plain = node.nodeName() in ("LogicalRelation", "Project", "Filter", "SubqueryAlias") and node.deterministic()
        if plain and node.nodeName() == "LogicalRelation":
            files = node.relation()
            plain = files.getClass().getSimpleName() == "HadoopFsRelation" and files.fileFormat().getClass().getSimpleName() == "ParquetFileFormat" \
                and files.location().rootPaths().distinct().size() == files.location().rootPaths().size()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return plain


#: Files whose numbers are sent to every task that reads them; more are joined as Spark sees fit.
MANY_FILES = 100_000


def with_stable_id(df: DataFrame, table_name: str, name: str = "rid") -> DataFrame:
    """One distinct long for each row, the same at every reading, however the files are split: the number of the row's file, by
    path, and its place in the file.  Rows that do not come straight from Parquet files are written first.  The paths
    are numbered in a written table, of which only the number of rows reaches the driver."""
    df = df if _from_parquet(df) else written(df, table_name)
    meta = df.metadataColumn("_metadata")
    path, at = (unused(df, c) for c in ("_rid_path", "_rid_place"))
    numbers = written(df.select(meta["file_path"].alias("_rid_path")).distinct().repartitionByRange("_rid_path").sortWithinPartitions("_rid_path")
                      .withColumn("_rid_at", F.monotonically_increasing_id()), "file-numbers")
    # Partition number and place in it, folded into 23 bits: the parts' sizes are summed up, part by part.
    part, place = F.shiftright("_rid_at", 33), F.col("_rid_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = numbers.groupBy(part.alias("_rid_part")).agg(F.count(F.lit(1)).alias("_rid_n"))
    before = F.coalesce(F.sum("_rid_n").over(Window.orderBy("_rid_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbers = numbers.withColumn("_rid_part", part).join(sizes.select("_rid_part", before.alias("_rid_before")), "_rid_part") \
        .select("_rid_path", (F.col("_rid_before") + place).alias("_rid_file"))
    number = unused(df, "_rid_file")
    numbers = numbers.select(F.col("_rid_path").alias(path), F.col("_rid_file").alias(number))
    numbers = F.broadcast(numbers) if numbers.count() <= MANY_FILES else numbers
    placed = df.select("*", meta["file_path"].alias(path), meta["row_index"].alias(at))
    return placed.join(numbers, path, "left") \
        .withColumn(name, F.shiftleft(F.col(number).cast("long"), 40) + F.col(at)).drop(path, number, at)


def lower_az(text: Column) -> Column:
    """A-Z lower-cased, all else as it is.  ``lower`` does just that on ASCII
    text, and faster than ``translate``, which the other texts need."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)) \
        .otherwise(F.translate(text, UPPER, UPPER.lower()))


def bounded_sample(df: DataFrame, rows: int, key: str, salt: int = 0) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``key``: the bounded
    training sample of a classifier.  A threshold on the hash, from the row
    count, comes first, so no task sends the driver more than its share."""
    n, space = df.count(), 1 << 40
    h = F.pmod(F.xxhash64(F.lit(salt), F.col(key)), F.lit(space))
    near = df.withColumn("_h", h)
    if n > rows:
        near = near.where(F.col("_h") < int(space * min(1.0, 1.3 * rows / n)))
    return near.orderBy("_h", key).limit(rows).drop("_h")


#: Places of the bitmaps below: 8 MB in all, whatever the number of keys.
BITMAP_PLACES = 1 << 26


def key_bitmaps(keys: DataFrame, key: str) -> DataFrame:
    """Bitmaps of the hashed places of ``key`` (a long): at most ``BITMAP_PLACES`` / 32768 rows of 4 KB."""
    v = F.pmod(F.xxhash64(key), F.lit(BITMAP_PLACES)) + 1
    return keys.select(v.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("_bucket")) \
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("_bits"))


def maybe_among(df: DataFrame, key: str, bitmaps: DataFrame, flag: str) -> DataFrame:
    """``flag``: false only where ``key`` is surely not among the keys.  A join on the
    keys that remain decides; this only keeps the other rows out of its shuffle."""
    place = f"pmod(xxhash64({key}), {BITMAP_PLACES})"
    bucket, bits = unused(df, "_bucket"), unused(df, "_bits")
    byte = f"conv(hex(substring({bits}, 1 + cast({place} % 32768 div 8 as int), 1)), 16, 10)"
    maps = bitmaps.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits))
    return df.withColumn(bucket, F.expr(f"bitmap_bucket_number({place} + 1)")).join(F.broadcast(maps), bucket, "left") \
        .withColumn(flag, F.expr(f"coalesce(shiftright(cast({byte} as int), cast({place} % 8 as int)) & 1 = 1, false)")) \
        .drop(bucket, bits)
