"""Index bookkeeping: latest commits, watermarks, freshness, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_key
from ..functions.text import line_count

FRESH, STALE, NEVER, NO_COMMITS = STATUSES = ("fresh", "stale", "never", "no_commits")


def latest_commit(touches: DataFrame, order: str = "commit_ts") -> DataFrame:
    """Newest commit per file; ``touches`` carries (path, commit_id, <order>)."""
    return touches.groupBy(*file_key(touches)).agg(
        F.max_by("commit_id", F.struct(F.col(order), F.col("commit_id"))).alias("latest_commit_id"))


def last_indexed(watermarks: DataFrame) -> DataFrame:
    """Last log entry per file: of the highest ``generation`` where the log has
    generations, else by indexed_ts, then commit_id.  ``indexed_commit_id``, and
    ``indexed_seq``, ``generation``, ``n_lines`` and ``n_buckets`` where the log carries them."""
    order = F.struct(*[F.col(c) for c in ("generation", "indexed_ts", "commit_id") if c in watermarks.columns])
    names = {"commit_id": "indexed_commit_id", "seq": "indexed_seq", "generation": "generation", "n_lines": "n_lines", "n_buckets": "n_buckets"}
    have = {c: out for c, out in names.items() if c in watermarks.columns}
    k = file_key(watermarks)
    last = watermarks.groupBy(*k).agg(F.max_by(F.struct(*have), order).alias("_l"))
    return last.select(*k, *(F.col(f"_l.{c}").alias(out) for c, out in have.items()))


def line_counts(snapshots: DataFrame) -> DataFrame:
    """Lines per file version; a final newline adds none."""
    return snapshots.select(*file_key(snapshots), "version", line_count("text").alias("n_lines"))


def index_status(files: DataFrame, latest: DataFrame, indexed: DataFrame) -> DataFrame:
    """Per file ``fresh`` (watermark = latest commit), ``stale``, ``never`` or ``no_commits``."""
    k = file_key(files)
    j = (files.select(*k).distinct()
         .join(latest.select(*k, "latest_commit_id"), k, "left")
         .join(indexed.select(*k, "indexed_commit_id"), k, "left"))
    st = (F.when(F.col("latest_commit_id").isNull(), F.lit(NO_COMMITS))
          .when(F.col("indexed_commit_id").isNull(), F.lit(NEVER))
          .when(F.col("indexed_commit_id") == F.col("latest_commit_id"), F.lit(FRESH))
          .otherwise(F.lit(STALE)))
    return j.withColumn("status", st)


def index_progress(status: DataFrame) -> DataFrame:
    """Files per status and in total, per folder ('' is the root)."""
    folder = F.regexp_extract(F.col("path"), r"^(.*)/[^/]*$", 1)

    def n(s):
        return F.sum(F.when(F.col("status") == s, 1).otherwise(0)).cast("bigint")
    return status.groupBy(*file_key(status)[:-1], folder.alias("folder")).agg(
        n(FRESH).alias("n_fresh"), n(STALE).alias("n_stale"), n(NEVER).alias("n_never"),
        n(NO_COMMITS).alias("n_no_commits"), F.count(F.lit(1)).cast("bigint").alias("n_files"))


def merge_line_commits(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per line the commit list of ``a`` followed by that of ``b``;
    order and duplicates kept."""
    k = file_key(a)
    u = (a.select(*k, "line_no", F.lit(0).alias("_g"), "commit_ids")
         .unionByName(b.select(*k, "line_no", F.lit(1).alias("_g"), "commit_ids")))
    g = u.groupBy(*k, "line_no").agg(
        F.sort_array(F.collect_list(F.struct("_g", "commit_ids"))).alias("_l"))
    return g.select(*k, "line_no",
                    F.flatten(F.transform("_l", lambda x: x["commit_ids"])).alias("commit_ids"))
