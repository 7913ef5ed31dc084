"""Ignore rules and folder listings with .gitignore semantics."""

from pyspark.sql import functions as F

from linetrail.operators import workspace as ws

FILES = ["src/a.rs", "src/b.log", "src/gen/x.rs", "src/gen/keep/y.rs", "docs/readme.md",
         "build/out.rs", "lib/build/z.rs", "top.rs", "src/deep/a/b/c.rs"]
RULES = [(1, "*.log", False, False), (2, "build/", False, True), (3, "src/gen", False, False),
         (4, "!src/gen/keep", False, False), (5, "src/**/c.rs", False, False)]


def _files(spark):
    return spark.createDataFrame([(p, 10) for p in FILES], "path string, n_lines int")


def _rules(spark):
    return spark.createDataFrame(RULES, "rule_no int, pattern string, negated boolean, dir_only boolean")


def test_ignore_rules(spark):
    kept = sorted(r.path for r in ws.list_files(_files(spark), _rules(spark)).collect())
    # an ignored folder hides its content even when a later rule re-includes a child
    assert kept == ["docs/readme.md", "src/a.rs", "top.rs"]


def test_list_dirs(spark):
    dirs = sorted(r.path for r in ws.list_dirs(_files(spark), _rules(spark)).collect())
    assert dirs == ["docs", "lib", "src", "src/deep", "src/deep/a", "src/deep/a/b"]
    all_dirs = sorted(r.path for r in ws.list_dirs(_files(spark)).collect())
    assert "src/gen/keep" in all_dirs and "" not in all_dirs


def test_subfolders_relative_counts_new(spark):
    f = _files(spark)
    assert sorted(r.path for r in ws.filter_subfolders(f, "src/gen,docs/").collect()) == [
        "docs/readme.md", "src/gen/keep/y.rs", "src/gen/x.rs"]
    rel = {r[0] for r in f.select(ws.relative_path("path", "src")).collect()}
    assert "gen/x.rs" in rel and "top.rs" in rel
    counts = {r.folder: r.n_files for r in ws.file_counts(f).collect()}
    assert counts[""] == 1 and counts["src"] == 2 and counts["src/gen"] == 1
    idx = spark.createDataFrame([("src/a.rs",), ("top.rs",)], "path string")
    assert len(ws.new_files(f, idx).collect()) == len(FILES) - 2


def test_patterns(spark):
    cases = [("*.log", "a/b/c.log", True), ("src/*.rs", "src/a/b.rs", False), ("src/**/b.rs", "src/b.rs", True),
             ("src/**/b.rs", "src/a/x/b.rs", True), ("*.[oa]", "x/y.o", True), ("*.[oa]", "x/y.c", False), ("*.[!oa]", "y.c", True),
             ("\\#x", "#x", True), ("#x", "#x", False), ("*.log  ", "a.log", True), ("a\\ ", "a ", True), ("!a", "a", False),
             ("\\!a", "!a", True), ("/top", "top", True), ("/top", "x/top", False), ("a.b", "axb", False), ("a+(b", "a+(b", True),
             ("[ab", "[ab", True), ("x[*]y", "x*y", True), ("x[*]y", "xzy", False), ("a?c", "abc", True), ("a?c", "a/c", False)]
    for i, (pattern, path, ignored) in enumerate(cases):
        files = spark.createDataFrame([(path, 1)], "path string, n_lines int")
        rules = spark.createDataFrame([(1, pattern)], "rule_no int, pattern string")
        assert (ws.list_files(files, rules).count() == 0) == ignored, (pattern, path)


def test_subfolder_filter_reaches_parquet_scan(spark, tmpdir_path):
    root = tmpdir_path + "/files"
    _files(spark).write.parquet(root)
    df = ws.filter_subfolders(spark.read.parquet(root), "src/gen")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,src/gen/)" in plan
    assert sorted(r.path for r in df.collect()) == ["src/gen/keep/y.rs", "src/gen/x.rs"]


def test_rules_meet_names_by_literal_ends(spark):
    """Random paths against random patterns: what the anchors find is what trying every rule on every path finds; no plan has a product."""
    import random
    import re
    rng = random.Random(9)
    parts = ["a", "ab", "abc", "b.c", "x.log", "build", "[q]", "longer-name.rs", "longer-nome.rs"]
    paths = sorted({"/".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(120)})
    pieces = ["a", "b", "*", "?", "**", "[ab]", "[!a]", ".log", "longer-n", "me.rs", "\\[", "/"]
    rules = [(i, ("!" if rng.random() < 0.3 else "") + "".join(rng.choice(pieces) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    rules += [(100, "*"), (101, "!a*"), (102, "**/ab"), (103, "x**"), (104, "!a/x**")]
    items = [(p, False) for p in paths] + [(p, True) for p in sorted({"/".join(p.split("/")[:i]) for p in paths for i in range(1, p.count("/") + 1)})]
    table = spark.createDataFrame(rules, "rule_no int, pattern string")
    found = ws._ignored_by_rule(spark.createDataFrame(items, "x string, is_dir boolean"), table)
    want = set()
    compiled = [(r.rule_no, r.ignore, r.dir_only, re.compile(r.rx)) for r in ws.parsed_rules(table.withColumn("pattern", F.col("pattern"))).collect()]
    for x, is_dir in items:
        last = max(((n, ign) for n, ign, only, rx in compiled if (is_dir or not only) and rx.search(x)), default=(0, False))
        if last[1]:
            want.add((x, is_dir))
    assert {tuple(r) for r in found.collect()} == want
    plan = ws.list_dirs(spark.createDataFrame([(p,) for p in paths], "path string"), table)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_repositories_keep_their_folders_and_rules(spark):
    files = spark.createDataFrame([(r, p) for r in "ab" for p in ("x/y/1.rs", "x/2.log", "z/3.rs")], "repo string, path string")
    rules = spark.createDataFrame([("a", 1, "*.log"), ("b", 1, "x/")], "repo string, rule_no int, pattern string")
    assert sorted(map(tuple, ws.list_dirs(files, rules).collect())) == [("a", "x"), ("a", "x/y"), ("a", "z"), ("b", "z")]
    assert sorted((r.repo, r.path) for r in ws.list_files(files, rules).collect()) == [("a", "x/y/1.rs"), ("a", "z/3.rs"), ("b", "z/3.rs")]
    both = rules.drop("repo").where("pattern = 'x/'")
    assert sorted((r.repo, r.path) for r in ws.list_files(files, both).collect()) == [("a", "z/3.rs"), ("b", "z/3.rs")]
