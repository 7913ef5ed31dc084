"""Range requests: exact and nearest-forward lookups against brute force,
related files (the file itself counts), top-k, descriptions, authors."""

import random

import pytest

from linetrail.operators import context as ctx


def test_nearest_forward_brute_force(spark):
    rng = random.Random(5)
    keys = {}
    rows = []
    for p in range(6):
        ks = sorted(rng.sample(range(1, 20000), rng.randint(1, 40)))
        keys[f"f{p}"] = ks
        rows += [(f"f{p}", k, f"c{k}") for k in ks]
    idx = spark.createDataFrame(rows, "path string, line_no bigint, commit_id string")
    want = [(i, f"f{rng.randint(0, 6)}", rng.randint(0, 21000)) for i in range(500)]
    lines = spark.createDataFrame(want, "req_id int, path string, line_no bigint")
    got = {(r.req_id, r.line_no): r.key_line for r in ctx.nearest_forward(lines, idx).collect()}
    exp = {}
    for i, p, ln in want:
        ks = [k for k in keys.get(p, []) if k >= ln]
        if ks:
            exp[(i, ln)] = ks[0]
    assert got == exp
    unc = {(r.req_id, r.line_no) for r in ctx.uncovered_lines(lines, idx, "forward").collect()}
    assert unc == {(i, ln) for i, p, ln in want if (i, ln) not in exp}


def test_related_files_and_topk(spark):
    idx = spark.createDataFrame([("a.rs", 1, ["c1", "c2"]), ("a.rs", 2, ["c2"]), ("a.rs", 5, ["c3"])],
                                "path string, line_no bigint, commit_ids array<string>")
    touches = spark.createDataFrame([("c1", "a.rs"), ("c1", "b.rs"), ("c2", "a.rs"), ("c2", "c.rs"),
                                     ("c3", "a.rs"), ("c3", "d.rs")], "commit_id string, path string")
    req = spark.createDataFrame([(1, "a.rs", 1, 2), (2, "a.rs", 3, 0)],
                                "req_id int, path string, start_line int, end_line int")
    lines = ctx.expand_ranges(req, ctx.line_counts_from_index(idx))
    rel = {(r.req_id, r.related_path): r.occurrences
           for r in ctx.related_files(ctx.lines_to_commits(lines, idx), touches).collect()}
    # request 1: (1,c1) (1,c2) (2,c2) -> a.rs 3, b.rs 1, c.rs 2 ; request 2: lines 3..5 -> c3 once
    assert rel == {(1, "a.rs"): 3, (1, "b.rs"): 1, (1, "c.rs"): 2, (2, "a.rs"): 1, (2, "d.rs"): 1}
    top = ctx.top_related_files(ctx.related_files(ctx.lines_to_commits(lines, idx), touches), k=2)
    assert sorted((r.req_id, r.related_path, r.rank) for r in top.collect()) == [
        (1, "a.rs", 1), (1, "c.rs", 2), (2, "a.rs", 1), (2, "d.rs", 2)]
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    fwd = ctx.request_hits(lines, idx, "forward")
    assert sorted((r.req_id, r.line_no, r.key_line) for r in fwd.select("req_id", "line_no", "key_line")
                  .distinct().collect()) == [(1, 1, 1), (1, 2, 2), (2, 3, 5), (2, 4, 5), (2, 5, 5)]


def test_describe_and_authors(spark):
    idx = spark.createDataFrame([("a.rs", 1, ["c1", "c2"]), ("a.rs", 3, ["c2", "c9"])],
                                "path string, line_no bigint, commit_ids array<string>")
    commits = spark.createDataFrame([("c1", "Ada", "2024-01-01 00:00:00", "Fix\n\nbody"),
                                     ("c2", "Bob", "2024-02-01 00:00:00", "Add")],
                                    "commit_id string, author string, ts string, message string") \
        .selectExpr("commit_id", "author", "cast(ts as timestamp_ntz) as commit_ts", "message")
    req = spark.createDataFrame([(1, "a.rs", 1, 3)], "req_id int, path string, start_line int, end_line int")
    lines = ctx.expand_ranges(req, None)
    d = ctx.describe_commits(ctx.request_hits(lines, idx, "forward"), commits, "git@github.com:o/r.git")
    got = sorted((r.commit_id, r.first_line_no, r.first_pos, r.title, r.body, r.url) for r in d.collect())
    assert got == [("c1", 1, 0, "Fix", "body", "https://github.com/o/r/commit/c1"),
                   ("c2", 1, 1, "Add", "", "https://github.com/o/r/commit/c2")]
    a = {r.author: (r.n_lines, r.n_commits) for r in
         ctx.authors_of_range(ctx.lines_to_commits(lines, idx), commits).collect()}
    assert a == {"Ada": (1, 1), "Bob": (2, 1)}


def test_expand_ranges_edges(spark):
    counts = spark.createDataFrame([("a.rs", 4)], "path string, n_lines bigint")
    req = spark.createDataFrame([(1, "a.rs", 2, 0), (2, "b.rs", 1, 0), (3, "a.rs", 5, 3), (4, "a.rs", 0, 1)],
                                "req_id int, path string, start_line int, end_line int")
    got = sorted((r.req_id, r.line_no) for r in ctx.expand_ranges(req, counts).collect())
    # whole file of a.rs from line 2; unknown length of b.rs gives nothing; start > end gives nothing
    assert got == [(1, 2), (1, 3), (1, 4), (4, 0), (4, 1)]
    idx = spark.createDataFrame([("a.rs", 3, "c")], "path string, line_no bigint, commit_id string")
    lines = ctx.expand_ranges(req, counts)
    miss = sorted((r.req_id, r.line_no) for r in ctx.uncovered_lines(lines, idx, "exact").collect())
    assert miss == [(1, 2), (1, 4), (4, 0), (4, 1)]


def _random_lines(rng, n, most):
    return sorted({rng.choice([rng.randint(1, 60), rng.randint(1, most)]) for _ in range(n)})


@pytest.mark.parametrize("seed", range(3))
def test_look_ups_over_long_gaps(spark, seed):
    """Nearest-forward look-ups and uncovered ranges against the plain definition, with keys far apart."""
    import random
    rng = random.Random(seed)
    keys = {f"f{i}": _random_lines(rng, rng.choice([1, 3, 40]), 200_000) for i in range(6)}
    keys["g"] = list(range(4090, 4105)) + list(range(8190, 8200))
    index = spark.createDataFrame([(p, n, [n]) for p, ns in keys.items() for n in ns], "path string, line_no long, commit_ids array<long>")
    asked = [(i, rng.choice([*keys, "none"]), rng.choice([rng.randint(0, 50), rng.randint(1, 200_100), 4096, 4095]), 0) for i in range(80)]
    lines = spark.createDataFrame([(i, p, n) for i, p, n, _ in asked], "req_id int, path string, line_no int")
    got = {(r.req_id, r.key_line) for r in ctx.nearest_forward(lines, index).collect()}
    assert got == {(i, min(k for k in keys.get(p, []) if k >= n)) for i, p, n, _ in asked if any(k >= n for k in keys.get(p, []))}
    ranges = [(i, p, n, n + rng.choice([0, 5, 300, 3_000_000_000])) for i, p, n, _ in asked]
    req = spark.createDataFrame(ranges, "req_id int, path string, start_line long, end_line long")
    want, last = set(), set()
    for i, p, s, e in ranges:
        inside = [k for k in keys.get(p, []) if s <= k <= e]
        for a, b in zip([s - 1, *inside], [*inside, e + 1]):
            if a + 1 <= b - 1:
                want.add((i, p, a + 1, b - 1))
        top = max(keys.get(p, [s - 1]))
        if max(s, top + 1) <= e:
            last.add((i, p, max(s, top + 1), e))
    got = [tuple(r) for r in ctx.uncovered_ranges(req, index).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {tuple(r) for r in ctx.uncovered_ranges(req, index, "forward").collect()} == last


def test_islands(spark):
    index = spark.createDataFrame([("a", n) for n in [1, 2, 3, 7, 9, 10, 10]], "path string, line_no int")
    assert sorted(tuple(r) for r in ctx.line_islands(index).collect()) == [("a", 1, 3), ("a", 7, 7), ("a", 9, 10)]


def test_lists_and_mass_commits_give_the_same(spark):
    import random
    from linetrail.operators import lineage as lin
    rng = random.Random(2)
    lists = [[rng.randint(1, 12) for _ in range(rng.randint(1, 4))] for _ in range(6)]
    hist = spark.createDataFrame([("f%d" % (i % 3), i, rng.choice(lists)) for i in range(1, 90)], "path string, line_no long, commit_ids array<long>")
    touches = spark.createDataFrame([(c, f"p{x}") for c in range(1, 12) for x in range(200 if c == 5 else 3)], "commit_id long, path string")
    req = spark.createDataFrame([(i, "f%d" % (i % 4), 1 + i, 20 + 9 * i) for i in range(12)], "req_id int, path string, start_line int, end_line int")
    lines = ctx.expand_ranges(req)
    hits = ctx.lines_to_commits(lines, hist)
    rows, table = lin.list_dictionary(hist)
    assert table.count() == len({tuple(x.commit_ids) for x in hist.collect()})
    assert sorted(map(tuple, lin.with_lists(rows, table).select("path", "line_no", "commit_ids").collect())) == sorted(map(tuple, hist.collect()))
    by_list = ctx.lines_to_lists(lines, rows)
    want = sorted(map(tuple, ctx.related_files(hits, touches).collect()))
    mass = ctx.mass_commits(touches, 20)
    assert [tuple(r) for r in mass.collect()] == [(5, 10)]
    for got in (ctx.related_files(hits, touches, mass), ctx.related_files_by_lists(by_list, table, touches), ctx.related_files_by_lists(by_list, table, touches, mass)):
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, ctx.commits_of_range_by_lists(by_list, table).collect())) == sorted(map(tuple, ctx.commits_of_range(hits).collect()))


def test_mass_commits_pairs_are_not_shuffled(spark):
    """Files by several mass commits, twice, without a name, and by others too; the pairs only mass commits make are unfolded last."""
    import random
    rng = random.Random(5)
    t = [(c, f"p{x}") for c in (1, 2) for x in range(40 * c)] + [(1, None), (1, "p3"), (2, "p3"), (None, "p1"), (7, None)]
    t += [(c, f"p{rng.randint(0, 90)}") for c in range(3, 12) for _ in range(4)]
    touches = spark.createDataFrame(t, "commit_id long, path string")
    hits = spark.createDataFrame([(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(1, 12)])) for _ in range(60)], "req_id int, commit_id long")
    mass = ctx.mass_commits(touches, 20)
    assert sorted(r.commit_id for r in mass.collect()) == [1, 2]
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(map(tuple, ctx.related_files(hits, touches).collect()), key=key)
    got = ctx.related_files(hits, touches, mass)
    assert sorted(map(tuple, got.collect()), key=key) == want
    # No aggregation, so no shuffle, stands above the unfolding.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "Generate explode(CASE WHEN" in plan


def test_mass_commits_files_come_as_numbers(spark, monkeypatch):
    """Several sets, chunks and packs, repeated and nameless files, nameless requests, requests that only one side knows, repositories; what
    other commits bring is shuffled by the chunk's number, and by path for files that no mass commit changed alone."""
    import random
    import re
    rng = random.Random(8)
    for name, value in (("CHUNK_FILES", 7), ("REQUEST_PARTS", 3), ("REQUEST_PACKS", 2)):
        monkeypatch.setattr(ctx, name, value, raising=False)
    t = [(rp, c, f"p{x}") for rp in ("a", "b") for c in (1, 2, 3) for x in range(20 * c, 90)] + [("a", 1, None), ("a", 2, None), ("a", 9, None), ("b", 1, "p25"), (None, 1, "p1"), ("a", None, "p1")]
    t += [(rng.choice("ab"), c, f"p{rng.randint(0, 140)}") for c in range(4, 14) for _ in range(6)]
    touches = spark.createDataFrame(t, "repo string, commit_id long, path string")
    hits = spark.createDataFrame([(rng.choice([None, *range(15)]), rng.choice("ab"), rng.choice([None, *range(1, 14)])) for _ in range(150)]
                                 + [(77, "a", 12), (78, "b", 1), (79, None, 1)], "req_id int, repo string, commit_id long")
    mass = ctx.mass_commits(touches, 25)
    assert sorted(r.commit_id for r in mass.collect()) == [1, 1, 2, 2, 3, 3]
    key = lambda r: tuple(str(x) for x in r)
    for drop in ((), ("repo",)):
        h, f = hits.drop(*drop), touches.drop(*drop)
        want = sorted(map(tuple, ctx.related_files(h, f).collect()), key=key)
        got = ctx.related_files(h, f, ctx.mass_commits(f, 25))
        assert got.columns == ctx.related_files(h, f).columns
        assert sorted(map(tuple, got.collect()), key=key) == want
    plan = ctx.related_files(h, f, ctx.mass_commits(f, 25))._jdf.queryExecution().executedPlan().toString()  # not run yet: printed once
    assert len(re.findall(r"Exchange hashpartitioning\(req_id#\d+, related_path#\d+", plan)) <= 1
