"""Column functions against the cases of the reference unit tests."""

from pyspark.sql import functions as F

from linetrail.functions import text as tx

HEADERS = [
    ("-2,5 +2", (2, 5, 2, 1), tx.FEW_REPLACED_WITH_SINGLE),
    ("-90,61 +86", (90, 61, 86, 1), tx.FEW_REPLACED_WITH_SINGLE),
    ("-2,5 +2,3", (2, 5, 2, 3), tx.FEW_REPLACED_WITH_FEW),
    ("-23,2 +18,7", (23, 2, 18, 7), tx.FEW_REPLACED_WITH_FEW),
    ("-45 +44,0", (45, 1, 44, 0), tx.SINGLE_DELETED),
    ("-50,3 +48,0", (50, 3, 48, 0), tx.FEW_DELETED),
    ("-159 +96", (159, 1, 96, 1), tx.SINGLE_REPLACED_WITH_SINGLE),
    ("-169,0 +104,3", (169, 0, 104, 3), tx.NEW_LINES_ADDED),
    ("-1 +1,3", (1, 1, 1, 3), tx.FEW_REPLACED_WITH_FEW),
    ("-0,0 +1", (0, 0, 1, 1), tx.NEW_LINES_ADDED),
    ("-3,0 +3,0", (3, 0, 3, 0), tx.NONE_FOUND),
    ("bad input", None, None),
]


def test_hunk_headers(spark):
    df = spark.createDataFrame([(h,) for h, _, _ in HEADERS], "h string")
    p = tx.parse_hunk_header(F.col("h"))
    rows = df.select("h", p.alias("p"), tx.categorize_change(p["old_count"], p["new_count"]).alias("c")).collect()
    got = {r.h: (None if r.p is None else tuple(r.p), r.c) for r in rows}
    for h, exp, cat in HEADERS:
        assert got[h] == (exp, cat), h


def test_header_body(spark):
    df = spark.createDataFrame([("@@ -3,2 +3,4 @@ fn main() {",), ("  @@ -1 +1 @@",)], "l string")
    assert [r[0] for r in df.select(tx.hunk_header_body("l")).collect()] == ["-3,2 +3,4", "-1 +1"]


def test_trim_list_short_hash_marker(spark):
    letters = ",".join(chr(c) for c in range(ord("a"), ord("z") + 1))
    df = spark.createDataFrame([(letters, "^abcdef1234", "+added", "a,b")], "l string, h string, m string, s string")
    r = df.select(tx.trim_list("l", 10), tx.short_hash("h"), tx.strip_marker("m"), tx.trim_list("s", 10)).first()
    assert r[0] == "a,b,c,d,e,f,g,h,i,j"
    assert r[1] == "abcdef1"
    assert r[2] == "added"
    assert r[3] == "a,b"


def test_commit_url(spark):
    cases = [("git@github.com:org/repo.git", "https://github.com/org/repo/commit/abc"),
             ("https://github.com/org/repo", "https://github.com/org/repo/commit/abc"),
             ("https://github.com/org/repo.git\n", "https://github.com/org/repo/commit/abc"),
             ("https://gitlab.com/org/repo.git", "")]
    df = spark.createDataFrame(cases, "r string, e string")
    for r in df.select(tx.commit_url("r", F.lit("abc")).alias("u"), "e").collect():
        assert r.u == r.e


def test_split_message_and_line_count(spark):
    df = spark.createDataFrame([("  Title here \n\n body line 1\nline 2 \n", "a\nb\n", ""), ("one", "a\n\n", "x")],
                               "m string, t string, u string")
    r = df.select(tx.split_message("m").alias("s"), tx.line_count("t").alias("n"), tx.line_count("u").alias("k")).collect()
    assert (r[0].s.title, r[0].s.body, r[0].n, r[0].k) == ("Title here", "body line 1\nline 2", 2, 0)
    assert (r[1].s.title, r[1].s.body, r[1].n, r[1].k) == ("one", "", 2, 1)


def test_edit_distance(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("straße", "strasse")], "a string, b string")
    r = df.select(tx.edit_distance("a", "b"), tx.is_similar("a", "b", 2), tx.is_similar("a", "b", 3)).collect()
    assert tuple(r[0]) == (3, False, True)
    assert r[1][0] == 2  # characters, not bytes
