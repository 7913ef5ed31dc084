"""O55 as a stream: keep the line index current as hunk files land.

``readStream`` over the landing folder; ``foreachBatch`` updates only the
files a micro-batch touches, and its cost follows the batch, not the
whole history:

* the batch's hunks are kept in a hunk store partitioned by file bucket,
  one folder per epoch written with overwrite, so a replayed epoch
  replaces its own files instead of adding copies; the number of buckets is part of the folders, so it may change;
* a file whose watermark is older than all its
  new hunks continues incrementally: one fold
  over the batch's hunks plus an equi-join to its old lines, read from
  their folders of the index alone;
* a file with a late hunk (at or before its watermark) or without an
  index is rebuilt from its full history in the hunk store, of which again only
  its folders are read;
* an epoch claims one generation and notes it, so a replay writes the same one.  Rows are written first,
  watermarks that name them last.  If the batch dies in between, the replay replaces its rows; if it
  dies after, the generation is in the log and the replay has nothing to do.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import file_key
from ..plans import jobs
from ..session import scratch_table_path
from ..sources import claims, store


def read_hunk_store(spark: SparkSession, store_dir: str, paths: DataFrame) -> DataFrame:
    """Full hunk history of ``paths`` from the store (only their folders are opened, one row per hunk)."""
    k = file_key(paths)
    h = store.pruned(spark.read.parquet(store_dir), store.asked_places(spark, store_dir, paths)) \
        .join(paths, k, "left_semi").drop("n_buckets", "bucket", "epoch")
    return h.dropDuplicates([*k, "commit_id"] + (["hunk_no"] if "hunk_no" in h.columns else []))


def epoch_generation(spark: SparkSession, index_dir: str, store_dir: str, epoch: str) -> int:
    """The generation of an epoch: claimed the first time, the same one on a replay."""
    note = f"{store_dir}/_generations/{epoch}"
    held = claims.read_text(spark, note)
    if not held:
        held = str(claims.claim_generation(spark, index_dir))
        claims.create_new(spark, note, held)
    return int(held)


def _stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, and where it lies."""
    at = scratch_table_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at), at


def _batch_update(spark: SparkSession, batch: DataFrame, epoch: int | str, hunk_schema: StructType,
                  index_dir: str, wm_dir: str, store_dir: str, n_buckets: int, progress: jobs.Progress | None = None) -> None:
    k = file_key(batch)
    gen = epoch_generation(spark, index_dir, store_dir, str(epoch))
    log = store.read_watermarks(spark, wm_dir, hunk_schema["commit_id"].dataType.simpleString(), "repo" in k)
    if not log.where(F.col("generation") == gen).isEmpty():
        return  # published before it was given again
    at = f"{store_dir}/epoch={epoch}"
    claims.mark_layout(spark, store_dir, n_buckets)
    (batch.withColumn("n_buckets", F.lit(int(n_buckets))).withColumn("bucket", store.bucket_of(k, n_buckets))
     .write.mode("overwrite").partitionBy("n_buckets", "bucket").parquet(at))
    new = spark.read.schema(batch.schema).parquet(at).select(*batch.columns)
    paths = new.select(*k).distinct()
    wm = log.join(paths, k, "left_semi")
    old = store.read_published(spark, index_dir, wm, paths)
    state = jobs.file_state(wm) if old is not None else jobs.file_state(wm).where(F.lit(False))
    # A file continues when its watermark is before all its hunks of the batch.
    first = new.groupBy(*k).agg(F.min("seq").alias("_first")).join(state, k).where("_first > _wm_seq").select(*k, "_wm_len")
    first, at_first = _stored(first, "continuing")
    if first.isEmpty():
        old = None  # no old lines are wanted, so the new ones need not be dealt out to meet them
    rebuilt = read_hunk_store(spark, store_dir, paths.join(first, k, "left_anti")).select(*new.columns)
    # Written once: lengths, lines and texts each read it, and would find the files' history in the store again.
    todo, at_todo = _stored(new.join(first, k).unionByName(rebuilt.withColumn("_wm_len", F.lit(None).cast("bigint"))), "todo")
    rows, new_wm = jobs.continue_index(old, todo)
    jobs.publish(spark, rows, new_wm, index_dir, wm_dir, n_buckets, gen, progress, epoch=str(epoch))
    for folder in (at_first, at_todo):
        claims.remove(spark, folder)


def stream_index(spark: SparkSession, hunk_dir: str, hunk_schema: StructType, index_dir: str,
                 wm_dir: str, stream_checkpoint: str, n_buckets: int = store.DEFAULT_BUCKETS,
                 available_now: bool = True, processing_time: str | None = None,
                 store_dir: str | None = None, progress: jobs.Progress | None = None):
    """Start the stream; with ``available_now`` it processes what has landed and stops.

    ``progress`` is called after each micro-batch with the files and lines that it published; how many hunks landed
    is in the query's own progress, as observed metric ``landed``.

    ``store_dir``: the bucketed hunk store kept by the stream (default next
    to the index).  ``n_buckets`` may differ from what earlier runs had.  Epochs are counted by the stream's checkpoint,
    and named after it, so a stream that is begun anew adds to the store.
    """
    store_dir = store_dir or index_dir.rstrip("/") + "_hunks"
    src = spark.readStream.schema(hunk_schema).parquet(hunk_dir).observe("landed", F.count(F.lit(1)).alias("hunks"))

    name = hashlib.sha256(stream_checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def run(batch_df: DataFrame, epoch_id: int) -> None:
        _batch_update(spark, batch_df, f"{name}-{epoch_id}", hunk_schema, index_dir, wm_dir, store_dir, n_buckets, progress)

    w = src.writeStream.foreachBatch(run).option("checkpointLocation", stream_checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
