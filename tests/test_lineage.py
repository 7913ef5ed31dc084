"""Line history: golden chains from the reference tests, random histories
against a plain forward replay, both engines, and incremental = full."""

import random

import pytest
from pyspark.sql import functions as F

from linetrail.operators import lineage as lin
from replay import replay

SCHEMA = ("path string, commit_id string, seq bigint, hunk_no int, new_start bigint, old_count bigint, "
          "new_count bigint, added array<string>, replaced array<int>")


def _hunks(spark, path, steps):
    rows = []
    for i, (c, s, o, n, added, rep) in enumerate(steps, 1):
        rows.append((path, c, i, i, s, o, n, added, rep))
    return spark.createDataFrame(rows, SCHEMA)


def _lines(spark, path, steps, engine):
    h = lin.line_history(_hunks(spark, path, steps), engine=engine)
    return [(r.line_no, r.content, list(r.commit_ids)) for r in h.orderBy("line_no").collect()]


INIT = ("commit1", 1, 0, 9, [f"line{i}" for i in range(1, 10)], [])
STEP1 = ("commit2", 2, 5, 1, ["line23"], [0])
STEP2A = ("commit3", 3, 2, 4, ["n3", "n4", "n5", "n6"], [0, 1])
STEP2B = ("commit3", 3, 2, 1, ["n3"], [0])
STEP3 = ("commit5", 3, 0, 2, ["a3", "a4"], [])
STEP4 = ("commit5", 5, 1, 1, ["r5"], [0])
STEP5 = ("commit5", 5, 1, 1, ["r5"], [])
STEP6 = ("commit6", 3, 2, 0, [], [])
STEP7 = ("commit7", 2, 1, 0, [], [])


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_golden_chains(spark, engine):
    c1, c2, c3, c5, c6 = "commit1", "commit2", "commit3", "commit5", "commit6"
    got = _lines(spark, "f", [INIT, STEP1], engine)
    assert got == [(1, "line1", [c1]), (2, "line23", [c1, c2]), (3, "line7", [c1]), (4, "line8", [c1]),
                   (5, "line9", [c1])]
    got = _lines(spark, "f", [INIT, STEP1, STEP2A], engine)
    assert [x[2] for x in got] == [[c1], [c1, c2], [c1, c3], [c1, c3], [c3], [c3], [c1]]
    assert got[6][1] == "line9"
    got = _lines(spark, "f", [INIT, STEP1, STEP2B], engine)
    assert [x[2] for x in got] == [[c1], [c1, c2], [c1, c3], [c1]]
    assert got[3][1] == "line9"
    got = _lines(spark, "f", [INIT, STEP1, STEP2A, STEP3], engine)
    assert [x[2] for x in got] == [[c1], [c1, c2], [c5], [c5], [c1, c3], [c1, c3], [c3], [c3], [c1]]
    got = _lines(spark, "f", [INIT, STEP1, STEP2A, STEP3, STEP4], engine)
    assert got[4][2] == [c1, c3, c5] and len(got) == 9
    got = _lines(spark, "f", [INIT, STEP1, STEP2A, STEP3, STEP5], engine)
    assert got[4][2] == [c5] and len(got) == 9
    # deletions remove the lines after new_start (the rule of the source, see SURVEY 2.10)
    got = _lines(spark, "f", [INIT, STEP1, STEP2A, STEP3, STEP5, STEP6], engine)
    assert [x[2] for x in got] == [[c1], [c1, c2], [c5], [c1, c3], [c3], [c3], [c1]]
    got = _lines(spark, "f", [INIT, STEP1, STEP2A, STEP3, STEP5, STEP6, ("commit7", 2, 1, 0, [], [])], engine)
    assert [x[2] for x in got] == [[c1], [c1, c2], [c1, c3], [c3], [c3], [c1]]
    got = _lines(spark, "g", [("commit1", 1, 0, 2, ["x", "y"], [])], engine)
    assert got == [(1, "x", ["commit1"]), (2, "y", ["commit1"])]


def random_history(rng, path, n_commits, start_len=None):
    """Valid random hunks: several hunks per commit, ascending, in new coordinates."""
    hunks, length, cid = [], 0, 0
    if start_len is None:
        start_len = rng.randint(1, 15)
    cid += 1
    hunks.append(dict(path=path, commit=f"{path}-c{cid}", seq=cid, hunk_no=1, s=1, o=0, n=start_len,
                      added=[f"{path}-c{cid}-0-{k}" for k in range(start_len)], replaced=[]))
    length = start_len
    for _ in range(n_commits):
        cid += 1
        pos, shift, hn = 1, 0, 0
        cur_len = length
        while True:
            if pos > cur_len + 1 or rng.random() < 0.35:
                break
            a = rng.randint(pos, cur_len + 1)  # old-side start
            o = rng.randint(0, min(3, cur_len - a + 1))
            n = rng.randint(0 if o > 0 else 1, 4)
            hn += 1
            if cur_len == 0 or length + shift == 0:
                o = 0
                n = max(n, 1)
            s_new = a + shift if n > 0 else a + shift - 1
            rep = sorted(rng.sample(range(n), rng.randint(0, n))) if o > 0 else []
            hunks.append(dict(path=path, commit=f"{path}-c{cid}", seq=cid, hunk_no=hn, s=s_new, o=o, n=n,
                              added=[f"{path}-c{cid}-{hn}-{k}" for k in range(n)], replaced=rep))
            shift += n - o
            pos = a + o + 1 if o > 0 else a + 1
        length += shift
    return hunks


def _expected(hunks):
    exp = {}
    by_path = {}
    for h in hunks:
        by_path.setdefault(h["path"], []).append(h)
    for p, hs in by_path.items():
        hs = sorted(hs, key=lambda h: (h["seq"], h["hunk_no"]))
        state = replay([dict(commit=h["commit"], s=h["s"], o=h["o"], n=h["n"], added=h["added"],
                             replaced=set(h["replaced"])) for h in hs])
        for i, (txt, cs) in enumerate(state, 1):
            exp[(p, i)] = (txt, cs)
    return exp


def _df(spark, hunks):
    rows = [(h["path"], h["commit"], h["seq"], h["hunk_no"], h["s"], h["o"], h["n"], h["added"], h["replaced"])
            for h in hunks]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_random_histories(spark, engine):
    rng = random.Random(7)
    hunks = []
    for i in range(60):
        hunks += random_history(rng, f"p{i}", rng.randint(1, 12))
    exp = _expected(hunks)
    hist = lin.line_history(_df(spark, hunks), engine=engine)
    got = {(r.path, r.line_no): (r.content, list(r.commit_ids)) for r in hist.collect()}
    assert got == exp
    # every result passes the structural checks (lines 1..n, each with commits)
    assert all(r.ok for r in lin.history_checks(hist).collect())


def test_incremental_equals_full(spark):
    rng = random.Random(11)
    hunks = []
    for i in range(40):
        hunks += random_history(rng, f"q{i}", rng.randint(2, 10))
    df = _df(spark, hunks)
    cut = {f"q{i}": rng.randint(1, 6) for i in range(40)}
    first = [h for h in hunks if h["seq"] <= cut[h["path"]]]
    base = lin.line_history(_df(spark, first))
    rest = _df(spark, [h for h in hunks if h["seq"] > cut[h["path"]]])
    upd = lin.line_history(rest, base=base)
    untouched = base.join(upd.select("path").distinct(), "path", "left_anti")
    got = {(r.path, r.line_no): (r.content, list(r.commit_ids)) for r in untouched.unionByName(upd).collect()}
    full = {(r.path, r.line_no): (r.content, list(r.commit_ids)) for r in lin.line_history(df).collect()}
    assert got == full == _expected(hunks)


def test_restricted_lines_equal_full(spark):
    rng = random.Random(3)
    hunks = []
    for i in range(20):
        hunks += random_history(rng, f"r{i}", rng.randint(2, 10))
    df = _df(spark, hunks)
    full = {(r.path, r.line_no): list(r.commit_ids) for r in lin.line_history(df, with_text=False).collect()}
    want = spark.createDataFrame([(p, ln) for (p, ln) in full if ln % 3 != 1] + [("r0", 10 ** 6)],
                                 "path string, line_no bigint")
    part = {(r.path, r.line_no): list(r.commit_ids)
            for r in lin.line_history(df, lines=want, with_text=False).collect()}
    assert part == {k: v for k, v in full.items() if k[1] % 3 != 1}


def test_history_checks_and_blame(spark):
    hist = spark.createDataFrame([("a", 1, ["x"]), ("a", 2, ["x", "y"]), ("b", 1, ["z"]), ("b", 3, [])],
                                 "path string, line_no bigint, commit_ids array<string>")
    r = {x.path: x for x in lin.history_checks(hist).collect()}
    assert r["a"].ok and not r["b"].ok and r["b"].n_empty == 1
    blame = spark.createDataFrame([("a", 1, "x", "code"), ("a", 2, "q", "code"), ("a", 3, "x", "   ")],
                                  "path string, line_no bigint, commit_id string, content string")
    g = lin.blame_agreement(hist, blame).first()
    assert (g.n_lines, g.n_agree, g.n_fail) == (2, 1, 1)


def test_threshold_replacement(spark):
    rows = [("f", "c1", 1, 1, 1, 0, 2, ["alpha", "beta"], ["", ""]),
            ("f", "c2", 2, 1, 1, 2, 2, ["alpha!", "zzzzzz"], ["alpha", "beta"])]
    df = spark.createDataFrame(rows, "path string, commit_id string, seq bigint, hunk_no int, new_start bigint, "
                                     "old_count bigint, new_count bigint, added array<string>, deleted array<string>")
    got = [list(r.commit_ids) for r in lin.line_history(df, threshold=2).orderBy("line_no").collect()]
    assert got == [["c1", "c2"], ["c2"]]


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_no_overflow_inheritance(spark, engine):
    rows = [("f", "c1", 1, 1, 1, 0, 3, ["a", "b", "c"], []),
            ("f", "c2", 2, 1, 1, 1, 3, ["A", "B", "C"], [0, 1, 2])]
    df = spark.createDataFrame(rows, SCHEMA)
    keep = [list(r.commit_ids) for r in lin.line_history(df, engine=engine).orderBy("line_no").collect()]
    fresh = [list(r.commit_ids) for r in
             lin.line_history(df, engine=engine, inherit_overflow=False).orderBy("line_no").collect()]
    # line 2 of the new hunk sits where old line 2 ("b") was: inherited by default
    assert keep == [["c1", "c2"], ["c1", "c2"], ["c1", "c2"], ["c1"], ["c1"]]
    assert fresh == [["c1", "c2"], ["c2"], ["c2"], ["c1"], ["c1"]]


@pytest.mark.parametrize("with_text", [True, False])
def test_long_history_streams_over_batches(spark, with_text):
    """Thousands of hunks of one file, over many Arrow batches, with and without a base that has other columns."""
    rng = random.Random(17)
    hunks = random_history(rng, "long", 900, start_len=3000) + random_history(rng, "short", 3)
    df, exp = _df(spark, hunks), _expected(hunks)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.path, r.line_no): list(r.commit_ids) for r in lin.line_history(df, with_text=with_text).collect()}
        assert got == {k: v[1] for k, v in exp.items()}
        old, new = (_df(spark, [h for h in hunks if (h["seq"] <= 300) == x]) for x in (True, False))
        base = lin.line_history(old, with_text=with_text).withColumn("generation", F.lit(1)).withColumn("bucket", F.lit(2))
        upd = lin.line_history(new, base=base, with_text=with_text)
        got = {(r.path, r.line_no): list(r.commit_ids) for r in upd.collect()}
        assert got == {k: v[1] for k, v in exp.items() if k[0] == "long"}
        if with_text:
            assert {(r.path, r.line_no): r.content for r in upd.collect()} == {k: v[0] for k, v in exp.items() if k[0] == "long"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_two_repositories(spark):
    rng = random.Random(5)
    a, b = random_history(rng, "README.md", 6), random_history(rng, "README.md", 9)
    df = _df(spark, a).withColumn("repo", F.lit("r1")).unionByName(_df(spark, b).withColumn("repo", F.lit("r2")))
    for engine in ("arrow", "sql"):
        got = {(r.repo, r.line_no): (r.content, list(r.commit_ids)) for r in lin.line_history(df, engine=engine).collect()}
        assert got == {("r1", k[1]): v for k, v in _expected(a).items()} | {("r2", k[1]): v for k, v in _expected(b).items()}
    prev = lin.pair_previous(df).collect()
    assert sum(r.prev_commit_id is None for r in prev) == 2


def test_keyed_scan_matches_windows(spark):
    from pyspark.sql import Window
    from linetrail.plans.scan import keyed_scan
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 20)}", i, rng.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o bigint, v bigint")
    got = keyed_scan(df, ["k"], ["o"], number="rn", running_sum=("v", "cum"), previous=("v", "prev"), chunk_rows=300)
    w = Window.partitionBy("k").orderBy("o")
    exp = df.select("k", "o", F.row_number().over(w).alias("rn"),
                    F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("cum"),
                    F.lag("v").over(w).alias("prev"))
    a = sorted(tuple(r) for r in got.select("k", "o", "rn", "cum", "prev").collect())
    b = sorted(tuple(r) for r in exp.collect())
    assert a == b


@pytest.mark.parametrize("order", ["number", "time", "text"])
def test_keyed_scan_chunks_stay_even(spark, monkeypatch, order):
    """One hot key, one row far off, many ties: no chunk has twice its size, and nothing runs while the plan is built."""
    from linetrail.plans import scan
    col = {"number": "cast(if(id = 7, -1000000000, id % 50) as bigint)",
           "time": "timestamp_seconds(if(id = 7, 0, 1700000000 + id))", "text": "concat('same-prefix-', cast(id % 50 as string))"}[order]
    df = spark.range(10_000).selectExpr("if(id % 4 = 0, 'cold' || (id % 100), 'hot') as k", f"{col} as o", "id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    out = scan.keyed_scan(df, ["k"], ["o", "id"], number="rn", chunk_rows=500)
    assert not tracker.getJobIdsForGroup("plan")
    spark.sparkContext._jsc.clearJobGroup()
    hot = df.join(scan._borders(df, ["k"], F.struct("o", "id"), 500), "k") \
        .groupBy(F.size(F.filter("_borders", lambda b: b <= F.struct("o", "id")))).count().collect()
    assert len(hot) >= 15 and max(r["count"] for r in hot) <= 1000
    from pyspark.sql import Window
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("o", "id")))
    assert sorted(map(tuple, out.select("k", "id", "rn").collect())) == sorted(map(tuple, want.select("k", "id", "rn").collect()))


def test_keyed_scan_rows_meet_few_borders(spark):
    """More chunks than a row is compared with at once, over all three steps: right results, and no row carries all borders of its key."""
    from pyspark.sql import Window
    from linetrail.plans import scan
    df = spark.range(60_000).selectExpr("case when id % 50 = 0 then null when id % 7 = 0 then 'k' || (id % 3) else 'hot' end as k", "if(id % 11 = 0, null, id % 9000) as o", "id")
    borders = scan._borders(df, ["k"], F.struct("o", "id"), 20)
    assert borders.agg(F.max(F.size("_borders"))).first()[0] > 2 * scan.FAN * scan.FAN
    chunked = scan._chunked(df, ["k"], F.struct("o", "id"), borders)
    want = df.join(borders, "k", "left").select("id", F.when(F.col("_borders").isNotNull(), F.size(F.filter("_borders", lambda b: b <= F.struct("o", "id")))).alias("c"))
    assert chunked.join(want, "id").where("not _chunk <=> c").count() == 0
    plan = scan.keyed_scan(df, ["k"], ["o", "id"], number="rn", chunk_rows=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "_borders" not in plan.split("Window")[0] and plan.count("_node") > 0
    w = Window.partitionBy("k").orderBy("o", "id")
    got = scan.keyed_scan(df, ["k"], ["o", "id"], number="rn", chunk_rows=20)
    assert got.join(df.withColumn("want", F.row_number().over(w)).select("id", "want"), "id").where("rn <> want").count() == 0


def test_keyed_scan_chunks_times_sampled_rows_pass_an_int(spark):
    """Borders are places in the sample; 47,000 chunks of as many sampled rows."""
    from linetrail.plans import scan
    n = 47_000
    df = spark.range(n).selectExpr("'hot' as k", "id * 7919 % 47000 as o", "1 as v")
    borders = scan._borders(df, ["k"], F.struct("o"), 1)
    assert [tuple(r) for r in borders.select(F.size("_borders"), F.expr("_borders[0].o"), F.expr("_borders[46998].o")).collect()] == [(n - 1, 1, n - 1)]
    got = scan.keyed_scan(df, ["k"], ["o"], number="rn", running_sum=("v", "before"), previous=("o", "prev"), chunk_rows=1)
    assert got.count() == n and got.where("rn <> o + 1 or before <> o or prev is distinct from nullif(o - 1, -1)").count() == 0


def test_keyed_scan_several_sums_chunked(spark):
    from linetrail.plans.scan import keyed_scan
    rng = random.Random(4)
    rows = [("big" if i % 3 else f"s{i % 7}", i, rng.randint(0, 1), rng.randint(0, 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, pos bigint, a bigint, b bigint")
    out = keyed_scan(df, ["k"], ["pos"], running_sum=[("a", "ca"), ("b", "cb")], chunk_rows=100)
    got = {(r.k, r.pos): (r.ca, r.cb) for r in out.collect()}
    exp, acc = {}, {}
    for k, pos, a, b in sorted(rows, key=lambda x: (x[0], x[1])):
        ca, cb = acc.get(k, (0, 0))
        exp[(k, pos)] = (ca, cb)
        acc[k] = (ca + a, cb + b)
    assert got == exp


def test_blame_short_hashes(spark):
    hist = spark.createDataFrame([("a", 1, ["abcdef0123", "1234567890"]), ("a", 2, ["ffffffff00"])],
                                 "path string, line_no bigint, commit_ids array<string>")
    blame = spark.createDataFrame([("a", 1, "^1234567"), ("a", 2, "abcdef0")], "path string, line_no bigint, commit_id string")
    g = lin.blame_agreement(hist, blame, short=True).first()
    assert (g.n_agree, g.n_fail) == (1, 1)


@pytest.mark.parametrize("engine", ["arrow", "sql"])
def test_long_files_span_blocks(spark, engine):
    rng = random.Random(29)
    hunks = []
    for i in range(3):
        hunks += random_history(rng, f"L{i}", rng.randint(10, 40), start_len=rng.randint(2500, 6000))
    df = _df(spark, hunks)
    exp = _expected(hunks)
    got = {(r.path, r.line_no): (r.content, list(r.commit_ids))
           for r in lin.line_history(df, engine=engine).collect()}
    assert got == exp
    want = spark.createDataFrame([k for k in exp if k[1] % 97 == 1], "path string, line_no bigint")
    part = {(r.path, r.line_no): list(r.commit_ids)
            for r in lin.line_history(df, lines=want, with_text=False, engine=engine).collect()}
    assert part == {k: v[1] for k, v in exp.items() if k[1] % 97 == 1}


def test_runs_follow_cuts_not_lines():
    """A block of 200,000 lines holds a run for each cut at most, and a line's neighbours share its run until a hunk parts them."""
    import numpy as np
    import pyarrow as pa
    from linetrail.operators._kernels import _Block, _Out
    rng, out, hits = random.Random(5), _Out(["path"], np, pa), []
    block = _Block(["f"], np.arange(1, 200_001), 200_000, np)
    assert block.m == 1
    for j in range(300):
        n = rng.randint(0, 3)
        block.step(rng.randint(1, block.length - 10), rng.randint(0, 3), n, True, None, j, True, out, hits)
        q = block.q[:block.m].tolist()
        assert block.m <= 2 * (j + 1) + 1 and all(a + s <= b for a, s, b in zip(q, block.size, q[1:]))
    lines = sorted(x for a, s in zip(block.own, block.size) for v in a for x in range(v, v + s))
    assert len(lines) == len(set(lines)) and len(lines) > 198_000


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("t", [0, 1, 2, 4])
def test_replaced_lines_by_segments(spark, t):
    """Every removed with every added line, against segments, with short, empty, equal and far longer lines."""
    rng = random.Random(t)

    def line():
        return "".join(rng.choice("abé") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13])))

    def edited(x):
        for _ in range(rng.randint(0, t + 1)):
            i = rng.randint(0, len(x))
            x = rng.choice([x[:i] + x[i + 1:], x[:i] + "c" + x[i:], x[:i] + "d" + x[i + 1:]])
        return x
    rows = []
    for h in range(25):
        old = [line() for _ in range(rng.randint(0, 9))]
        new = [edited(rng.choice(old)) if old and rng.random() < 0.6 else line() for _ in range(rng.randint(0, 9))]
        rows.append((h, old, new, len(old), len(new), "x"))
    df = spark.createDataFrame(rows, "id int, deleted array<string>, added array<string>, old_count int, new_count int, _h string")
    df = df.withColumnRenamed("_h", "note")
    want = {r[0]: [k for k, a in enumerate(r[2]) if any(_distance(a, d) <= t for d in r[1])] for r in rows}
    for limit in (0, 20, 1 << 62):
        got = lin.mark_replaced(df, threshold=t, product_up_to=limit)
        assert got.columns == [*df.columns, "replaced"]
        assert {r.id: r.replaced for r in got.collect()} == want


def test_lines_that_meet_by_segments_never_go_through_the_driver(spark):
    """Offers are far more than the table that they are made from, so no join of them may take a side for small."""
    df = spark.createDataFrame([(1, ["small plate"], ["small slate"], 1, 1)], "hunk_id int, deleted array<string>, added array<string>, old_count int, new_count int")
    plan = lin.mark_replaced(df, threshold=3, product_up_to=0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_replaced_lines_over_slices_and_batches(spark, monkeypatch):
    """Slices, groups over several batches, more pairs than are compared at once, characters of one to four bytes, null lines."""
    from linetrail.operators import _segments
    rng, t = random.Random(9), 3
    monkeypatch.setattr(lin, "SLICE_LINES", 7)
    monkeypatch.setattr(_segments, "GROUP_LINES", 11)
    monkeypatch.setattr(_segments, "PAIRS", 5)

    def line():
        return None if rng.random() < 0.05 else "".join(rng.choice("abé漢😀") for _ in range(rng.choice([0, 2, 4, 6, 9, 14, 40])))
    rows = [(h, [line() for _ in range(n)], [line() for _ in range(m)]) for h, (n, m) in enumerate([(30, 40), (1, 1), (0, 9), (9, 0), (3, 25), (60, 8)])]
    rows += [(7, None, ["x"]), (8, ["x"], None), (9, ["plate 1"] * 20, ["plate 2"] * 20 + ["a far longer line"])]
    edits = [x if x is None else x[1:] + "b" for x in rows[0][1]]
    rows[0] = (0, rows[0][1], rows[0][2] + edits)
    df = spark.createDataFrame(rows, "id int, deleted array<string>, added array<string>").withColumn("old_count", F.lit(1)).withColumn("new_count", F.coalesce(F.size("added"), F.lit(0)))
    want = {i: [k for k, a in enumerate(new or []) if a is not None and any(d is not None and _distance(a, d) <= t for d in old or [])] for i, old, new in rows}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "6")
    try:
        assert {r.id: r.replaced for r in lin.mark_replaced(df, threshold=t, product_up_to=0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_offers_of_segments_are_not_shuffled(spark):
    """Hunks are made once, and shuffled whole; what their lines offer to meet by stays within the task."""
    df = spark.range(3).selectExpr("id % 2 as hunk_id", "array('small plate ' || id) as deleted", "array('small slate ' || id) as added", "1 as old_count", "1 as new_count").distinct()
    m = lin.mark_replaced(df, threshold=3, product_up_to=0)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "HashAggregate(keys=[hunk_id" not in plan
    keys = [x.split("(")[1].split(")")[0].split(", ") for x in plan.split("Exchange hashpartitioning")[1:]]
    assert keys and all(c.startswith("_h#") or c.startswith("_s#") or c.isdigit() for k in keys for c in k)
