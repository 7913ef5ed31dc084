import itertools
import random
import re

import numpy as np
import pytest
from linetrail.llm import ngram_join as nj
from linetrail.llm import signature_tree as st
from linetrail.llm.shingles import shingle_sets

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(AZ))


def reference(t, n=5):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}


def brute(rows, percent=75):
    """``component`` of each row of ``(doc_id, text)``."""
    sets, root = [reference(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        c = len(sets[i] & sets[j])
        if c and 100 * c >= percent * (len(sets[i]) + len(sets[j]) - c):
            root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min((rows[k][0] for k in groups[find(i)] if rows[k][0] is not None), default=None) for i in range(len(rows))]


def test_sets():
    texts = ["", None, " \t", "a", "A a", "a b c d", "a b c d e", "a b c d e f " * 5, "\x1c b\x85c", "É é " * 9, "x" * 2_200_000, "w v " * 400_000]
    assert [len(s) for s in shingle_sets(texts)] == [len(reference(t)) for t in texts]
    a, b = shingle_sets(["One two THREE four five six", "one\ttwo three\nfour five six"])
    assert (a == b).all()


@pytest.mark.parametrize("seed", range(8))
def test_tree_finds_all_links(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 64, rng.integers(1, 300), dtype=np.uint64)) for _ in range(6)]
    sets = [s for s in (b[rng.random(len(b)) < rng.choice([1, 0.95, 0.9, 0.8])] for b in (base[rng.integers(6)] for _ in range(150))) if len(s)]
    got, want = st.Roots(len(sets)), st.Roots(len(sets))
    for i, j in st.links(sets, None):
        got.join(i, j)
    for i, j in itertools.combinations(range(len(sets)), 2):
        if st.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75):
            want.join(i, j)
    assert (got.all() == want.all()).all()


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(500)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 120))] for _ in range(25)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        if rng.random() < 0.3:
            w += passage
        rows.append((i, " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    return rows


@pytest.mark.parametrize("sets,wide,few", [(512, 100_000, 8), (3, 0, 8), (2, 5, 2), (4, 0, 1)])
def test_equals_brute_force(spark, monkeypatch, sets, wide, few):
    monkeypatch.setattr(nj, "BLOCK_SETS", sets)
    monkeypatch.setattr(nj, "FEW", few)
    monkeypatch.setattr(nj, "WIDESPREAD", wide)
    rows = corpus(5, 220)
    got = nj.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = dict(zip((i for i, _ in rows), brute(rows)))
    assert {r.doc_id: r.component for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(reference(t)) for i, t in rows}


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = nj.similar_components(odd_docs).collect()
    key = lambda x: (str(x[0]), str(x[1]), x[2])
    assert sorted(((r.doc_id, r.component, r.n_shingles) for r in got), key=key) == \
        sorted(((i, c, len(reference(t))) for (i, t), c in zip(rows, brute(rows))), key=key)
    assert nj.similar_components(no_docs).count() == 0


def test_keep_one(spark, odd_docs):
    rows = corpus(6, 120)
    kept = nj.keep_one(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, root string")).collect()
    assert {r.doc_id for r in kept} == set(brute(rows)) and all(r.text == dict(rows)[r.doc_id] and r.root == "x" for r in kept)
    left = nj.keep_one(odd_docs)
    assert left.columns == odd_docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert {1, 2, 3, 4, 9, 12, None} <= set(ids) and not {5, 6, 10, 11, 13, 8} & set(ids) and len(ids) == len(set(ids))


@pytest.mark.parametrize("seed", range(4))
def test_candidates_keep_every_linked_set(seed):
    rng = np.random.default_rng(seed)
    base = [np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64)) for n in (1, 3, 60, 70, 500, 520, 3000)]
    sets = [s for s in (b[rng.random(len(b)) < rng.choice([1, 0.9, 0.5])] for b in (base[rng.integers(7)] for _ in range(120))) if len(s)]
    assert (st.halved(st.bitmap(base[4], 4096)) == st.bitmap(base[4], 2048)).all()
    for sides in (None, rng.integers(0, 2, len(sets))):
        keep = st.candidates([st.bitmap(s, st.bits_for(len(s))) for s in sets], np.array([len(s) for s in sets]), sides)
        for i, j in itertools.combinations(range(len(sets)), 2):
            if sides is None or sides[i] != sides[j]:
                if st.similar(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 75):
                    assert keep[i] and keep[j]
    alone = [np.unique(rng.integers(0, 1 << 64, 300, dtype=np.uint64)) for _ in range(50)]
    assert not st.candidates([st.bitmap(s, st.bits_for(300)) for s in alone], np.full(50, 300), None).any()


def test_only_copies_leave_before_prefixes_are_cut(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "rid long, text string")
    sized = spark.createDataFrame([(0, 2), (1, 2), (2, 0), (3, 2), (4, 2), (5, 2)], "rid long, size long")
    reps = spark.createDataFrame([(0, 2), (3, 2), (5, 2)], "rid long, size long")  # 1 and 4 have a set that another stands for, 2 has none
    assert sorted(r.rid for r in nj._without_copies(docs, sized, reps).collect()) == [0, 2, 3, 5]
