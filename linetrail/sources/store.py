"""Persisted line index and watermark log (O9-O11): plain Parquet tables.

The index lies in folders ``generation=G/n_buckets=N/bucket=B``, ``B = pmod(hash(file), N)``, so the place of a file's rows
follows from its watermark and its name.  Every write is one generation: a number that grows by one, claimed by creating
a file that must not exist yet (``claims.py``), so no clock decides which write is the newer one.
The watermark log says what is published: its last row for a file (of the highest generation) names the generation that holds
the file's rows and its number of buckets, the commit and place (``seq``) up to which they go, and the file's length
(``n_lines``, 0 for a file that is empty or gone).  It is written after the rows, so rows of a write
that did not finish belong to no watermark and are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import file_key
from ..operators.status import last_indexed
from . import claims

DEFAULT_BUCKETS = 64
#: What locates the rows of a file.
PLACE = ["generation", "n_buckets", "bucket"]


def watermark_schema(commit_type: str = "bigint", repo: bool = False) -> T.StructType:
    """([repo], path, commit_id, indexed_ts, seq, generation, n_lines, n_buckets); the commit id keeps the type of the history."""
    return T.StructType([
        *([T.StructField("repo", T.StringType())] if repo else []),
        T.StructField("path", T.StringType()),
        T.StructField("commit_id", T._parse_datatype_string(commit_type)),
        T.StructField("indexed_ts", T.TimestampNTZType()),
        T.StructField("seq", T.LongType()),
        T.StructField("generation", T.LongType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_buckets", T.LongType()),
    ])


def bucket_of(key: list[str], n_buckets):
    return F.pmod(F.hash(*key), F.lit(n_buckets) if isinstance(n_buckets, int) else n_buckets)


def write_line_index(history: DataFrame, root: str, n_buckets: int = DEFAULT_BUCKETS,
                     generation: int | None = None) -> int:
    """Write ``history`` (path, line_no, commit_ids, ...) as a new generation.

    Returns the generation number: the next free one, claimed here, or the given one, whose rows of an earlier try are replaced.
    Dealt by bucket and rebalanced: a bucket of any size is written by as many tasks as its bytes call for, and small ones
    share a task, so neither a large bucket nor a large file ends up in a single task.  ``history`` is computed once (a range
    partitioning would compute it a second time, for its sample).  Each file comes out sorted, so that readers skip row groups.
    """
    spark, k = history.sparkSession, file_key(history)
    gen = claims.claim_generation(spark, root) if generation is None else int(generation)
    out = history.drop(*PLACE).withColumn("n_buckets", F.lit(int(n_buckets))).withColumn("bucket", bucket_of(k, int(n_buckets)))
    claims.mark_layout(spark, root, int(n_buckets))
    out.hint("rebalance", "bucket").sortWithinPartitions("bucket", *k, "line_no") \
        .write.mode("overwrite").partitionBy("n_buckets", "bucket").parquet(f"{root}/generation={gen}")
    return gen


def asked_places(spark: SparkSession, root: str, asked: DataFrame) -> DataFrame:
    """``k, n_buckets, bucket``: where rows of the asked files may lie, for every number of buckets in use."""
    k = file_key(asked)
    layouts = F.array(*map(F.lit, claims.layouts(spark, root))).cast("array<int>")
    return asked.select(*k, F.explode(layouts).alias("n_buckets")).withColumn("bucket", bucket_of(k, F.col("n_buckets")))


def pruned(df: DataFrame, places: DataFrame) -> DataFrame:
    """The rows of ``df`` in the folders that ``places`` (some of ``PLACE``, and the file's key) names.

    A join on the partition columns whose small side Spark evaluates first and prunes the scan by.  That side has one row
    for a folder of the table at most, which bounds what is broadcast, and nothing is collected.  Dynamic pruning
    needs a selective condition on that side; that a file has a name is one.
    """
    on = [c for c in PLACE if c in places.columns]
    folders = places.where(F.length("path") >= 1).select(*on).distinct()
    return df.join(F.broadcast(folders), on, "left_semi")


def published_places(watermarks: DataFrame) -> DataFrame:
    """``k, generation, n_buckets, bucket`` of each file's published rows."""
    k, last = file_key(watermarks), last_indexed(watermarks)
    if "n_buckets" not in last.columns:
        return last.select(*k, "generation")
    return last.select(*k, "generation", "n_buckets", bucket_of(k, F.col("n_buckets")).alias("bucket"))


def read_line_index(spark: SparkSession, root: str, paths=None, resolve: str = "path",
                    watermarks: DataFrame | None = None, keep_place: bool = False) -> DataFrame:
    """Read the index.

    ``watermarks``: the log; of each file the rows of the generation that its last entry names are
    read, and no others.  Without a log generations resolve by themselves: ``resolve="path"``: per file only its
    latest generation counts, so a re-indexed file that got shorter loses its old tail;
    ``resolve="line"``: per line the latest generation that holds it wins
    (lines only in older generations stay), the merge rule of the shards.
    ``paths``: optional list of paths or a DataFrame with the file's key; only their folders are opened.
    ``keep_place``: the columns ``PLACE`` stay.
    """
    df = spark.read.parquet(root)
    k = file_key(df)
    wanted = None
    if paths is not None:
        if not isinstance(paths, DataFrame):
            paths = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
        wanted = paths.select(*k)
    if watermarks is not None:
        if wanted is not None:
            watermarks = watermarks.join(wanted, k, "left_semi")
        places = published_places(watermarks)
        df = pruned(df, places).join(places.select(*k, "generation"), [*k, "generation"], "left_semi")
    else:
        if wanted is not None:
            df = pruned(df, asked_places(spark, root, wanted)).join(wanted, k, "left_semi")
        by = k if resolve == "path" else [*k, "line_no"]
        df = df.join(df.groupBy(*by).agg(F.max("generation").alias("generation")), [*by, "generation"], "left_semi")
    df = df if keep_place else df.drop("n_buckets", "bucket")
    return df.withColumn("generation", F.col("generation").cast("bigint"))


def read_generation(spark: SparkSession, root: str, generation: int, like: DataFrame) -> DataFrame:
    """The rows of one write, from its own folder; none, with the columns of ``like``, if it had none."""
    at = f"{root}/generation={generation}"
    return spark.read.parquet(at).drop("n_buckets", "bucket") if claims.has_data(spark, at) else spark.createDataFrame([], like.schema)


def compact_line_index(spark: SparkSession, root: str, new_root: str, n_buckets: int = DEFAULT_BUCKETS,
                       watermarks: DataFrame | None = None) -> None:
    """The rows that are read from ``root`` now, written to ``new_root``; generations stay."""
    live = read_line_index(spark, root, watermarks=watermarks)
    live.withColumn("n_buckets", F.lit(int(n_buckets))).withColumn("bucket", bucket_of(file_key(live), int(n_buckets))) \
        .write.partitionBy(*PLACE).parquet(new_root)
    claims.mark_layout(spark, new_root, int(n_buckets))


def append_watermarks(df: DataFrame, root: str) -> None:
    """Append ([repo], path, commit_id, indexed_ts, [seq], [generation], [n_lines], [n_buckets]) rows to the watermark log."""
    def long(c):
        return (F.col(c) if c in df.columns else F.lit(None)).cast("bigint").alias(c)
    df.select(*file_key(df), "commit_id", F.col("indexed_ts").cast("timestamp_ntz").alias("indexed_ts"),
              long("seq"), long("generation"), long("n_lines"), long("n_buckets")).write.mode("append").parquet(root)


def read_watermarks(spark: SparkSession, root: str, commit_type: str = "bigint", repo: bool = False) -> DataFrame:
    """The watermark log; a missing or empty log is an empty table."""
    schema = watermark_schema(commit_type, repo)
    return spark.read.schema(schema).parquet(root) if claims.has_data(spark, root) else spark.createDataFrame([], schema)


def has_rows(spark: SparkSession, root: str) -> bool:
    """Whether any write of the index had rows."""
    return any(claims.has_data(spark, f"{root}/generation={g}") for g in claims.generations(spark, root))


def read_published(spark: SparkSession, root: str, watermarks: DataFrame | None, paths: DataFrame | None = None) -> DataFrame | None:
    """The published rows, or None while there is no index."""
    return read_line_index(spark, root, paths, watermarks=watermarks) if has_rows(spark, root) else None


def read_places(spark: SparkSession, root: str, places: DataFrame) -> DataFrame | None:
    """The rows of the files of ``places`` (the file's key and ``PLACE``) in their generation; None while there is no index."""
    if not has_rows(spark, root):
        return None
    df = spark.read.parquet(root)
    k = file_key(df)
    here = places.where("generation is not null")
    return pruned(df, here).join(here.select(*k, "generation"), [*k, "generation"], "left_semi").drop(*PLACE)
