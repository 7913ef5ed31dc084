"""Stream and batch index maintenance: late hunks rebuild their file,
fresh files are skipped, re-indexing replaces only its files."""

import random

from pyspark.sql import functions as F

from linetrail.operators import lineage as lin
from linetrail.plans import jobs
from linetrail.sources import store
from linetrail.streaming.index_stream import stream_index
from test_lineage import SCHEMA, _df, random_history


def _hist(df):
    return {(r.path, r.line_no): (r.content, list(r.commit_ids)) for r in df.collect()}


def test_stream_with_late_hunks(spark, tmpdir_path):
    rng = random.Random(21)
    hunks = []
    for i in range(12):
        hunks += random_history(rng, f"s{i}", rng.randint(3, 8))
    df = _df(spark, hunks)
    land, idx, wm, ck = (f"{tmpdir_path}/{x}" for x in ("land", "idx", "wm", "ck"))
    # drop 1: everything except seq 2 of the first three files and the last commits of all files
    late = F.col("path").isin("s0", "s1", "s2") & (F.col("seq") == 2)
    last = F.col("seq") >= 4
    drops = [df.where(~late & ~last), df.where(last & ~late), df.where(late)]
    for d in drops:
        d.write.mode("append").parquet(land)
        stream_index(spark, land, df.schema, idx, wm, ck, n_buckets=4).awaitTermination()
    got = _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, 'string')))
    assert got == _hist(lin.line_history(df))


def test_build_and_reindex(spark, tmpdir_path):
    rng = random.Random(8)
    hunks = []
    for i in range(10):
        hunks += random_history(rng, f"b{i}", rng.randint(3, 8))
    df = _df(spark, hunks)
    idx, wm = f"{tmpdir_path}/idx", f"{tmpdir_path}/wm"
    files = df.select("path").distinct()
    old = df.where(F.col("seq") <= 2)
    checks = jobs.build_index(spark, files, old, idx, wm, n_buckets=4)
    assert all(r.ok for r in checks.collect())
    # second build: all files fresh, nothing written
    assert jobs.build_index(spark, files, old, idx, wm, n_buckets=4).count() == 0
    # new history arrives: incremental update of stale files
    jobs.build_index(spark, files, df, idx, wm, n_buckets=4)
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, 'string'))) == _hist(lin.line_history(df))
    # re-index two files from scratch; the others keep their rows
    jobs.reindex_files(spark, spark.createDataFrame([("b1",), ("b2",)], "path string"), df, idx, wm, n_buckets=4)
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, 'string'))) == _hist(lin.line_history(df))
    assert SCHEMA


def test_late_hunks_are_brought_together_once(spark, tmpdir_path, monkeypatch):
    """A batch that rebuilds all its files reads their history once, and does not deal out its lines to meet old ones."""
    rng, seen, own = random.Random(3), [], jobs.continue_index

    def noted(index, todo, *args):
        seen.append((index, todo._jdf.queryExecution().optimizedPlan().toString()))
        return own(index, todo, *args)
    monkeypatch.setattr(jobs, "continue_index", noted)
    df = _df(spark, random_history(rng, "x", 6) + random_history(rng, "y", 6))
    land, idx, wm, ck = (f"{tmpdir_path}/once-{x}" for x in ("land", "idx", "wm", "ck"))
    for d in (df.where("seq <> 2"), df.where("seq = 2")):
        d.write.mode("append").parquet(land)
        stream_index(spark, land, df.schema, idx, wm, ck, n_buckets=4).awaitTermination()
    assert seen and seen[-1][0] is None and all("Join" not in plan and "Aggregate" not in plan for _, plan in seen)
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, 'string'))) == _hist(lin.line_history(df))
