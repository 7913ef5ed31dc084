import numpy as np
import pytest
from linetrail.llm import embedding_dedup as ed
from linetrail.llm import hnsw


def brute(rows, least=0.95):
    """``(n_links, component)`` of each ``(id, vector)``."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.float32).astype(float) for k in (i, j))
                if a @ b >= least * np.linalg.norm(a) * np.linalg.norm(b):
                    links[i] += 1
                    links[j] += 1
                    root[find(i)] = find(j)
    groups = {}
    for i, (vid, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(vid)
    return [(n, min((v for v in groups[find(i)] if v is not None), default=None)) for i, n in enumerate(links)]


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 8, dim))
    x = base[rng.integers(len(base), size=n)] + rng.normal(size=(n, dim)) * rng.choice([0, 0.02, 0.08, 0.2, 2.0], size=(n, 1))
    return [(i, [float(y) for y in v.astype(np.float32)]) for i, v in enumerate(x)]


SCHEMA = "vec_id long, embedding array<float>, label int, rep string, n int"


@pytest.mark.parametrize("shard", [640, 1 << 21])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(ed, "SHARD_VALUES", shard)
    monkeypatch.setattr(ed, "QUERIES", 50)
    rows = vectors(1, 320)
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0, None]), (1005, [1.0, float("inf")]),
           (1006, [3.0, 4.0]), (1007, [6.0, 8.0]), (1008, [3.0, 4.0]), (1008, [3.0, 4.0]), (None, rows[0][1]), (None, [5.0]), (2000, [3e38, 3e38]),
           (2001, [1e-40, 1e-40])]
    rows += odd
    got = ed.near_duplicates(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)).collect()
    key = lambda x: tuple(map(str, x))
    want = sorted(((vid, n, c, vid == c) for (vid, _), (n, c) in zip(rows, brute(rows))), key=key)
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=key) == want


def test_no_vectors(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(2)
    x = hnsw.unit(np.repeat(rng.normal(size=(500, 32)), 4, axis=0) + 0.1 * rng.normal(size=(2000, 32)))
    x = x[rng.permutation(len(x))]
    g = hnsw.unpack(hnsw.pack(hnsw.Graph.build(x)), x)
    true = x @ x.T >= 0.9
    got = g.within(x, 0.9, 16)
    assert sum(len(p) for p in got) >= 0.99 * true.sum() and all(true[i, p].all() for i, p in enumerate(got))
    crowd = hnsw.unit(np.ones((300, 8)) + 0.01 * rng.normal(size=(300, 8)))  # more neighbours than any beam
    g = hnsw.Graph.build(crowd)
    assert [len(p) for p in g.within(crowd[:5], 0.95, 8)] == [300] * 5
    for n in (1, 2, 9):
        g = hnsw.Graph.build(crowd[:n])
        assert [len(p) for p in g.within(crowd[:n], 0.95, 8)] == [n] * n


@pytest.mark.parametrize("copies", [1, 2, 8])
def test_lost_links_do_not_pass_the_audit(copies):
    rng = np.random.default_rng(3)
    x = hnsw.unit(np.repeat(rng.normal(size=(600 // copies, 16)), copies, axis=0) + 0.01 * rng.normal(size=(600, 16)))
    x[1] = x[0] + 1e-3  # one link at least
    x, ids = hnsw.unit(x), np.arange(600) * 3

    class Lost:
        def within(self, q, least, width):
            return [np.flatnonzero(near) for near in q @ x.T > 1 - 1e-12]  # each finds itself alone
    got = ed._found(Lost(), ids, x, ids[:400], x[:400], 0.95)
    assert [p.tolist() for p in got] == [np.flatnonzero(near).tolist() for near in x[:400] @ x.T >= 0.95]


@pytest.mark.parametrize("linked", [0, 30, 1500])
def test_sparse_and_dense_links_are_searched_in_the_graph(linked):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 32))
    x[6000 - linked:] = x[:linked] + 0.1 * rng.normal(size=(linked, 32))
    x, ids = hnsw.unit(x[rng.permutation(6000)]), np.arange(6000) * 7
    shard = ed.Audited(hnsw.Graph.build(x), ids, x, 0.95)
    got = [p for at in range(0, 6000, 1500) for p in shard.find(ids[at:at + 1500], x[at:at + 1500])]
    assert shard.searched == 6000 - 4 * ed.AUDIT and 0 < shard.beam < 6000
    true = [np.flatnonzero(near) for near in x @ x.T >= 0.95]
    there = sum(len(p) for p in true) - 6000
    assert all(set(p) <= set(t) for p, t in zip(got, true))
    assert there >= 2 * linked and sum(int((p != i).sum()) for i, p in enumerate(got)) >= 0.98 * there


def test_a_block_that_fails_later_widens_the_beam():
    rng = np.random.default_rng(6)
    x = hnsw.unit(np.repeat(rng.normal(size=(400, 16)), 2, axis=0) + 0.01 * rng.normal(size=(800, 16)))
    ids = np.arange(800)

    class Partly:
        """Finds planted vectors, but below a beam of 100 no link of the latter half."""

        def within(self, q, least, width):
            near = q @ x.T >= least
            own = q @ x.T > 1 - 1e-12
            return [np.flatnonzero(n if width >= 100 or not o[400:].any() else o) for n, o in zip(near, own)]
    shard = ed.Audited(Partly(), ids, x, 0.95)
    assert shard.beam == ed.BEAM
    true = [np.flatnonzero(near).tolist() for near in x @ x.T >= 0.95]
    assert [p.tolist() for p in shard.find(ids[:400], x[:400])] == true[:400] and shard.beam == ed.BEAM
    assert [p.tolist() for p in shard.find(ids[400:], x[400:])] == true[400:] and shard.beam == 128
