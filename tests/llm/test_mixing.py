import numpy as np
from linetrail.llm import mixing as mx
from pyspark.sql import functions as F


def test_rake_reaches_targets():
    rng = np.random.default_rng(1)
    cells = {(a, b, c): float(rng.integers(1000, 9000)) for a in "xyz" for b in "pq" for c in "mn"}
    goals = [{"x": 0.5, "y": 0.3, "z": 0.2}, {"p": 0.6, "q": 0.4}, {"m": 0.45, "n": 0.55}]
    total = sum(cells.values())
    p = mx.rake(cells, goals, 0.3 * total)
    kept = {k: p[k] * n for k, n in cells.items()}
    assert abs(sum(kept.values()) - 0.3 * total) < 1e-6 * total
    for d, goal in enumerate(goals):
        for name, share in goal.items():
            assert abs(sum(x for k, x in kept.items() if k[d] == name) / sum(kept.values()) - share) < 1e-6


def test_rake_cells_that_are_too_small_stay_whole():
    cells = {("a",): 10.0, ("b",): 1000.0, ("c",): 1000.0, ("e",): 0.0}
    p = mx.rake(cells, [{"a": 0.5, "b": 0.25, "c": 0.25, "d": 1.0}], 500)
    assert p[("a",)] == 1.0 and 0 < p[("b",)] < 1 and p[("e",)] == 1.0
    assert mx.rake({}, [{"a": 1.0}], 5) == {}
    assert mx.rake({("a",): 0.0}, [{"a": 1.0}], 5) == {("a",): 1.0}


def test_mix(spark, odd_docs, no_docs):
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    goals = {"source": {"s0": 0.5, mx.OTHER: 0.5}, "lang": {"en": 0.7, mx.OTHER: 0.3}}
    clash = odd_docs.withColumns({"cell": F.lit("mine"), "probability": F.lit(9)})
    got = mx.mix(clash, columns, goals, 0.5).collect()
    assert len(got) == odd_docs.count() and set(got[0].asDict()) == {*clash.columns, *mx.RESULTS}
    cells = {}
    for r in got:
        assert r.n_tokens == len((r.text or "").split())
        key = (r.source if r.source == "s0" else mx.OTHER, r.lang if r.lang == "en" else mx.OTHER)
        assert r.cell == "\x1f".join(key)
        cells[key] = cells.get(key, 0) + r.n_tokens
    p = mx.rake(cells, list(goals.values()), 0.5 * sum(cells.values()))
    assert all(abs(r.probability - p[tuple(r.cell.split("\x1f"))]) < 1e-9 for r in got)
    assert {r.kept for r in got if r.doc_id == 6} in ({True}, {False})
    assert mx.mix(no_docs, columns, goals, 0.5).count() == 0


GOALS = {"source": {"x": 0.5, mx.OTHER: 0.5}, "lang": {"en": 0.5, mx.OTHER: 0.5}}


def brute_share(cells, share):
    """The greatest of a thousand shares that weights, raked one class at a time and never above a cell's tokens, reach."""
    total = sum(cells.values())
    for step in range(1000, 0, -1):
        want, w = share * step / 1000 * total, {k: n for k, n in cells.items()}
        for _ in range(400):
            for d, goal in enumerate(GOALS.values()):
                for v in goal:
                    now = sum(x for k, x in w.items() if k[d] == v)
                    if now:
                        w = {k: min(cells[k], x * goal[v] * want / now) if k[d] == v else x for k, x in w.items()}
        if all(abs(sum(x for k, x in w.items() if k[d] == v) / want - g) < 0.004 for d, goal in enumerate(GOALS.values()) for v, g in goal.items()):
            return share * step / 1000
    return 0.0


def test_share_falls_until_targets_are_met():
    cells = {("x", "en"): 60.0, ("x", mx.OTHER): 40.0, (mx.OTHER, "en"): 500.0, (mx.OTHER, mx.OTHER): 400.0}
    p, share, met = mx.fitted(cells, GOALS, 0.6, True)
    assert met and abs(share - 0.2) < 0.004 and abs(share - brute_share(cells, 0.6)) < 0.004
    assert all(abs(reached - target) <= mx.TOLERANCE and ok for _, _, target, reached, ok in mx.outcome(cells, p, GOALS))
    assert mx.fitted(cells, GOALS, 0.1, True)[1:] == (0.1, True)
    assert mx.fitted(cells, GOALS, 0.6, False)[1:] == (0.6, False)
    assert mx.fitted({}, GOALS, 0.5, True) == ({}, 0.5, True)


def test_targets_that_contradict_each_other_are_reported(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", "en"), (2, "a b c", "y", "de")], "doc_id long, text string, source string, lang string")
    columns = {"source": F.col("source"), "lang": F.col("lang")}
    goals = {"source": {"x": 0.9, mx.OTHER: 0.1}, "lang": {"en": 0.1, mx.OTHER: 0.9}}
    assert [r.met for r in mx.mix(docs, columns, goals, 0.5).collect()] == [False, False]
    rows = mx.shares(docs, columns, goals | {"lang": {"en": 0.1, "fr": 0.5, mx.OTHER: 0.4}}, 0.5).collect()
    assert {(r.marginal, r.value) for r in rows} == {("source", "x"), ("source", mx.OTHER), ("lang", "en"), ("lang", "fr"), ("lang", mx.OTHER)}
    assert not all(r.met for r in rows) and [r.reached for r in rows if r.value == "fr"] == [0.0]


def test_names_of_helpers_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id long, text string, source string, n int")
    docs = docs.withColumns({c: F.col("n") for c in ("_id", "_text", "_cell", "_n", "_even")})
    row = mx.mix(docs, {"source": F.col("source")}, {"source": {"x": 1.0}}, 1.0).collect()[0]
    assert [row[c] for c in ("_id", "_text", "_cell", "_n", "_even")] == [7] * 5 and row.n_tokens == 2 and row.met


def test_sample_is_calibrated(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'a b c d' as text", "if(id % 3 = 0, 'x', 'y') as source")
    got = mx.mix(docs, {"source": F.col("source")}, {"source": {"x": 0.5, "y": 0.5}}, 0.5).where("kept").groupBy("source").count().collect()
    assert all(abs(r["count"] - 5000) < 250 for r in got) and len(got) == 2
