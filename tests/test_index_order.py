"""Which write counts: claimed generations, replays, bucket counts, and which folders a look-up opens."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from linetrail.operators import lineage as lin
from linetrail.plans import jobs
from linetrail.sources import claims, store
from linetrail.streaming import index_stream
from test_lineage import SCHEMA, _df, random_history


def _hist(df):
    return {(r.path, r.line_no): list(r.commit_ids) for r in df.collect()}


@pytest.fixture(scope="module")
def hunks(spark):
    rng = random.Random(4)
    return _df(spark, [h for i in range(12) for h in random_history(rng, f"f{i}", rng.randint(3, 7))]).cache()


def test_a_file_is_created_once(spark, tmpdir_path):
    at = f"{tmpdir_path}/a/b"
    assert claims.read_text(spark, at) is None
    assert [claims.create_new(spark, at, "x"), claims.create_new(spark, at, "y")] == [True, False] and claims.read_text(spark, at) == "x"


def test_claims_are_distinct_and_ascend(spark, tmpdir_path):
    got = []
    threads = [threading.Thread(target=lambda: got.extend(claims.claim_generation(spark, tmpdir_path) for _ in range(4))) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(set(got)) == len(got) == 20
    assert claims.claim_generation(spark, tmpdir_path) == max(got) + 1


def test_the_later_claim_counts_whatever_the_clock_says(spark, hunks, tmpdir_path):
    idx, wm = f"{tmpdir_path}/idx", f"{tmpdir_path}/wm"
    files = hunks.select("path").distinct()
    jobs.build_index(spark, files, hunks.where("seq <= 2"), idx, wm, n_buckets=4)
    back = F.localtimestamp() - F.expr("interval 10 minutes")
    jobs.build_index(spark, files, hunks, idx, wm, n_buckets=4, now=back)
    log = store.read_watermarks(spark, wm, "string")
    assert _hist(store.read_line_index(spark, idx, watermarks=log)) == _hist(lin.line_history(hunks))
    # The writer that claimed first publishes last; the other one's rows stay.
    first, second = claims.claim_generation(spark, idx), claims.claim_generation(spark, idx)
    old = hunks.where("seq = 1")
    jobs.publish(spark, lin.line_history(hunks), jobs.new_watermarks(hunks), idx, wm, 4, second)
    jobs.publish(spark, lin.line_history(old), jobs.new_watermarks(old), idx, wm, 4, first)
    assert _hist(store.read_line_index(spark, idx, watermarks=log)) == _hist(lin.line_history(hunks))


def test_an_epoch_keeps_its_generation(spark, hunks, tmpdir_path):
    idx, wm, hs = (f"{tmpdir_path}/{x}" for x in ("idx", "wm", "hunks"))

    def run(df, epoch, log, n=4):
        index_stream._batch_update(spark, df, epoch, hunks.schema, idx, log, hs, n)
    run(hunks.where("seq <= 2"), 0, wm)
    run(hunks.where("seq > 2"), 1, wm + "-lost")  # rows and a log that nobody reads: it died in between
    run(hunks.where("seq > 2"), 1, wm, 8)
    rows = store.read_watermarks(spark, wm, "string").count()
    run(hunks.where("seq > 2"), 1, wm)
    assert store.read_watermarks(spark, wm, "string").count() == rows and claims.generations(spark, idx) == [2, 1]
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, "string"))) == _hist(lin.line_history(hunks))


def test_hunk_store_with_two_bucket_counts(spark, hunks, tmpdir_path):
    idx, wm, hs = (f"{tmpdir_path}/{x}" for x in ("idx", "wm", "hunks"))
    index_stream._batch_update(spark, hunks.where("seq <> 2"), 0, hunks.schema, idx, wm, hs, 4)
    index_stream._batch_update(spark, hunks.where("seq = 2"), 1, hunks.schema, idx, wm, hs, 16)
    some = hunks.where("path <> 'f3'").select("path").distinct()
    assert index_stream.read_hunk_store(spark, hs, some).count() == hunks.where("path <> 'f3'").count()
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, "string"))) == _hist(lin.line_history(hunks))


def test_an_index_of_emptied_files(spark, tmpdir_path):
    idx, wm = f"{tmpdir_path}/idx", f"{tmpdir_path}/wm"
    rows = [("e", "c1", 1, 1, 1, 0, 2, ["a", "b"], []), ("e", "c2", 2, 1, 0, 2, 0, [], [])]
    h = spark.createDataFrame(rows, SCHEMA)
    files = h.select("path").distinct()
    assert jobs.build_index(spark, files, h, idx, wm, n_buckets=2).count() == 0
    assert store.read_published(spark, idx, store.read_watermarks(spark, wm, "string")) is None
    more = h.union(spark.createDataFrame([("e", "c3", 3, 1, 1, 0, 1, ["z"], [])], SCHEMA))
    jobs.build_index(spark, files, more, idx, wm, n_buckets=2)
    assert _hist(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wm, "string"))) == {("e", 1): ["c3"]}


def test_waves_and_progress(spark, hunks, tmpdir_path):
    idx, wm = f"{tmpdir_path}/idx", f"{tmpdir_path}/wm"
    files, told = hunks.select("path").distinct(), []
    checks = jobs.build_index(spark, files, hunks, idx, wm, n_buckets=4, waves=3, progress=told.append)
    n = files.count()
    assert checks.count() == n and told[0] == {"status": {"fresh": 0, "stale": 0, "never": n, "no_commits": 0}}
    assert [t["wave"] for t in told[1:]] == [0, 1, 2] and sum(t["files"] for t in told[1:]) == n
    log = store.read_watermarks(spark, wm, "string")
    lines = store.read_line_index(spark, idx, watermarks=log).count()
    assert sum(t["lines"] for t in told[1:]) == sum(t["lines_written"] for t in told[1:]) == lines
    told.clear()
    jobs.build_index(spark, files, hunks, idx, wm, n_buckets=4, progress=told.append)
    assert told[0]["status"]["fresh"] == n and told[1]["files"] == 0


def test_look_ups_open_the_asked_folders(spark, hunks, tmpdir_path):
    idx, wm = f"{tmpdir_path}/idx", f"{tmpdir_path}/wm"
    jobs.build_index(spark, hunks.select("path").distinct(), hunks.where("seq <= 2"), idx, wm, n_buckets=16)
    jobs.build_index(spark, spark.createDataFrame([("f1",), ("f2",)], "path string"), hunks, idx, wm, n_buckets=8)
    log = store.read_watermarks(spark, wm, "string")
    reqs = spark.createDataFrame([(1, "f1", 1, 0), (2, "f5", 1, 3), (3, "gone", 1, 9)], "req_id int, path string, start_line int, end_line int")
    touches = hunks.select("path", "commit_id").distinct()
    got = jobs.query_context(reqs, idx, touches, hunks=hunks, watermarks=log)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    want = jobs.query_context(reqs, lin.line_history(hunks), touches)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    for rows in (store.read_line_index(spark, idx, ["f1"], watermarks=log), store.read_line_index(spark, idx, ["f1"])):
        assert "dynamicpruning" in rows._jdf.queryExecution().executedPlan().toString()
        assert _hist(rows) == {x: c for x, c in _hist(lin.line_history(hunks)).items() if x[0] == "f1"}
