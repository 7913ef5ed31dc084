"""Parsers and round trips of the sources."""

from pyspark.sql import functions as F

from linetrail.sources import history as src
from linetrail.sources import store

DIFF = "\n".join([
    "diff --git a/src/x.rs b/src/x.rs",
    "index 1234567..89abcde 100644",
    "--- a/src/x.rs",
    "+++ b/src/x.rs",
    "@@ -2,2 +2,3 @@ fn main() {",
    "-old two",
    "-old three",
    "+new two",
    "+new three",
    "++plus kept",
    "\\ No newline at end of file",
    "@@ -9 +10,0 @@",
    "-gone",
    "@@@ -1,1 -1,1 +1,1 @@@",
    "+merged",
    "",
])


def test_parse_diffs(spark):
    df = spark.createDataFrame([("src/x.rs", "c1", DIFF)], "path string, commit_id string, diff string")
    rows = src.parse_diffs(df).orderBy("hunk_no").collect()
    assert len(rows) == 2
    a, b = rows
    assert (a.old_start, a.old_count, a.new_start, a.new_count) == (2, 2, 2, 3)
    assert a.deleted == ["old two", "old three"]
    assert a.added == ["new two", "new three", "+plus kept"]
    assert (b.old_start, b.old_count, b.new_start, b.new_count, b.deleted, b.added) == (9, 1, 10, 0, ["gone"], [])


def test_render_parse_round_trip(spark):
    rows = [("p", "c1", 1, 0, 2, [], ["a", "b"]), ("p", "c2", 2, 1, 1, ["a"], ["A"])]
    h = spark.createDataFrame(rows, "path string, commit_id string, new_start bigint, old_count bigint, "
                                    "new_count bigint, deleted array<string>, added array<string>")
    back = src.parse_diffs(src.render_diffs(h).select("path", "commit_id", "diff"))
    got = sorted((r.commit_id, r.new_start, r.old_count, r.new_count, r.deleted, r.added) for r in back.collect())
    assert got == [("c1", 1, 0, 2, [], ["a", "b"]), ("c2", 2, 1, 1, ["a"], ["A"])]


def test_parse_messages(spark):
    raw = "Fix bug\n\nLonger body\nsecond\n--AUTHOR--\nAda Lovelace\n--DATE--\nTue Mar 5 14:03:09 2024\n"
    bad = "no markers here"
    df = spark.createDataFrame([(1, raw), (2, bad)], "id int, raw string")
    r = src.parse_messages(df).collect()
    assert len(r) == 1
    assert (r[0].title, r[0].body, r[0].author, str(r[0].commit_ts)) == (
        "Fix bug", "Longer body\nsecond", "Ada Lovelace", "2024-03-05 14:03:09")


def test_changed_files(spark):
    df = spark.createDataFrame([("c1", "a.rs\nsrc/b.rs\n\na.rs\n")], "commit_id string, raw string")
    assert sorted(r.path for r in src.explode_changed_files(df).collect()) == ["a.rs", "src/b.rs"]


def test_parse_blame(spark):
    lines = ["^1a2b3c4d (Ada Lovelace 2024-01-02 03:04:05 +0100  12) let x = 1;",
             "9f8e7d6c5 src/a.rs (Bob 2023-12-31 23:59:59 -0500 3) ",
             "garbage"]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    r = src.parse_blame(df).orderBy("line_no").collect()
    assert [(x.commit_hash, x.author, x.line_no, x.content, x.tz) for x in r] == [
        ("9f8e7d6", "Bob", 3, "", "-0500"), ("1a2b3c4", "Ada Lovelace", 12, "let x = 1;", "+0100")]


def test_version_pair_hunks(spark):
    rows = [("f", 1, "a\nb\nc\n"), ("f", 2, "a\nB\nB2\nc\n"), ("f", 3, "a\nB\nB2\nc\n"), ("f", 4, "a\nc")]
    df = spark.createDataFrame(rows, "path string, version bigint, text string")
    got = [(r.version, r.old_start, r.old_count, r.new_start, r.new_count, r.deleted, r.added)
           for r in src.version_pair_hunks(df).orderBy("version").collect()]
    assert got == [(1, 0, 0, 1, 3, [], ["a", "b", "c"]),
                   (2, 2, 1, 2, 2, ["b"], ["B", "B2"]),
                   (4, 2, 2, 1, 0, ["B", "B2"], [])]


def test_index_json(spark):
    hist = spark.createDataFrame([("p", 1, ["c1", "c2"]), ("p", 2, ["c3"]), ("p", 12, ["c4"])],
                                 "path string, line_no bigint, commit_ids array<string>")
    docs = src.export_index_json(hist, lines_per_doc=10)
    assert sorted(r.doc for r in docs.collect()) == ['{"1":["c1","c2"],"2":["c3"]}', '{"12":["c4"]}']
    bad = spark.createDataFrame([("q", "{not json")], "path string, doc string")
    back = src.import_index_json(docs.select("path", "doc").unionByName(bad))
    assert sorted((r.path, r.line_no, r.pos, r.commit) for r in back.collect()) == [
        ("p", 1, 0, "c1"), ("p", 1, 1, "c2"), ("p", 2, 0, "c3"), ("p", 12, 0, "c4")]


def test_store_generations_and_pruning(spark, tmpdir_path):
    root = tmpdir_path + "/idx"
    h1 = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["y"]), ("b", 1, ["z"])],
                               "path string, line_no bigint, commit_ids array<string>")
    store.write_line_index(h1, root, n_buckets=4, generation=1)
    store.write_line_index(h1.where("path = 'a' and line_no = 1").withColumn("commit_ids", F.array(F.lit("w"))),
                           root, n_buckets=4, generation=2)
    got = sorted((r.path, r.line_no, list(r.commit_ids)) for r in store.read_line_index(spark, root).collect())
    assert got == [("a", 1, ["w"]), ("b", 1, ["z"])]
    only_b = store.read_line_index(spark, root, paths=["b"])
    assert [r.path for r in only_b.collect()] == ["b"]
    plan = only_b._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(n_buckets" in plan or "PartitionFilters: [(n_buckets" in plan, plan
    store.compact_line_index(spark, root, root + "2", n_buckets=2)
    got2 = sorted((r.path, r.line_no, list(r.commit_ids)) for r in store.read_line_index(spark, root + "2").collect())
    assert got2 == got
    assert spark.read.parquet(root + "2").count() == 2


def test_store_reads_by_paths_over_bucket_counts(spark, tmpdir_path):
    """The bucket count is stored with the rows; readers are told nothing."""
    root = tmpdir_path + "/idx3"
    h = spark.range(300).selectExpr("concat('f', id) as path", "1 as line_no", "array(id) as commit_ids")
    store.write_line_index(h.where("line_no = 1 and length(path) < 4"), root, n_buckets=256, generation=1)
    store.write_line_index(h.where("length(path) = 4"), root, n_buckets=7, generation=2)
    asked = h.select("path").where("path like '%5%'")
    assert store.read_line_index(spark, root, asked).count() == asked.count()
    assert sorted(r.path for r in store.read_line_index(spark, root, ["f3", "f250", "zz"]).collect()) == ["f250", "f3"]


def test_watermarks(spark, tmpdir_path):
    root = tmpdir_path + "/wm"
    assert store.read_watermarks(spark, root).count() == 0
    df = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00")], "path string, commit_id bigint, ts string") \
        .select("path", "commit_id", F.col("ts").cast("timestamp_ntz").alias("indexed_ts"))
    store.append_watermarks(df, root)
    store.append_watermarks(df, root)
    assert store.read_watermarks(spark, root).count() == 2


def test_store_line_resolution(spark, tmpdir_path):
    root = tmpdir_path + "/idx2"
    h = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["y"])], "path string, line_no bigint, commit_ids array<string>")
    store.write_line_index(h, root, n_buckets=2, generation=1)
    store.write_line_index(h.where("line_no = 1").withColumn("commit_ids", F.array(F.lit("z"))), root,
                           n_buckets=2, generation=2)
    by_path = sorted((r.line_no, list(r.commit_ids)) for r in store.read_line_index(spark, root).collect())
    by_line = sorted((r.line_no, list(r.commit_ids))
                     for r in store.read_line_index(spark, root, resolve="line").collect())
    assert by_path == [(1, ["z"])]
    assert by_line == [(1, ["z"]), (2, ["y"])]


def test_drop_merge_diffs(spark):
    from linetrail.operators.lineage import drop_merge_diffs
    df = spark.createDataFrame([("p", "c", DIFF)], "path string, commit_id string, diff string")
    kept = drop_merge_diffs(src.diff_lines(df, "diff"))
    lines = [r.line for r in kept.orderBy("pos").collect()]
    assert "+merged" not in lines and "-gone" in lines and not any(x.startswith("@@@") for x in lines)


def test_parse_diffs_has_no_shuffle(spark):
    df = spark.createDataFrame([("p", "c", DIFF)], "path string, commit_id string, diff string")
    assert "Exchange" not in src.parse_diffs(df)._jdf.queryExecution().executedPlan().toString()


def test_message_times_do_not_shift_in_a_zone_with_summer_time(spark):
    raw = "t\n\n--AUTHOR--\nme\n--DATE--\nSun Mar {} 02:30:00 2024\n"
    df = spark.createDataFrame([(1, raw.format(10)), (2, raw.format("45")), (3, raw.format("1"))], "id int, raw string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = {r.id: str(r.commit_ts) for r in src.parse_messages(df).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == {1: "2024-03-10 02:30:00", 2: "None", 3: "2024-03-01 02:30:00"}


def test_texts_of_version_pairs_are_cut_once(spark):
    df = spark.createDataFrame([("a", 1, "x\ny"), ("a", 2, "x\nz\ny"), ("a", 3, "x\nz\ny\n"), ("b", 1, None), ("b", 2, "q")], "path string, version int, text string")
    got = src.version_pair_hunks(df)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") <= 2
    assert sorted((r.path, r.version, r.old_start, r.old_count, r.new_start, r.new_count, r.added) for r in got.collect()) == \
        [("a", 1, 0, 0, 1, 2, ["x", "y"]), ("a", 2, 1, 0, 2, 1, ["z"]), ("b", 2, 0, 0, 1, 1, ["q"])]
