import hashlib

import pytest
from linetrail.llm import manifest as mf
from linetrail.llm.ranks import ranked
from pyspark.sql import functions as F


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def tree(nodes, fanout):
    """The root, and for each leaf its siblings as (left, right) by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, i in enumerate(at):
            run = nodes[i // fanout * fanout:(i // fanout + 1) * fanout]
            k = i % fanout
            paths[j].append(("".join(run[:k]), "".join(run[k + 1:])))
        nodes = [H(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in names:
        groups[g].sort()
        subs[g] = tree([x[2] for x in groups[g]], fanout)
    root, tops = tree([subs[g][0] for g in names], fanout)
    return sorted((str(x[1] if x[0] else None), str(g), x[2], subs[g][0], root, path + tops[i])
                  for i, g in enumerate(names) for x, path in zip(groups[g], subs[g][1]))


@pytest.mark.parametrize("fanout,levels", [(8, 3), (2, 1), (2, 3), (3, 2), (200, 1)])
def test_equals_brute_force(odd_docs, fanout, levels):
    got = sorted((str(r.doc_id), str(r.lang), r.leaf, r.subroot, r.root, [tuple(x) for x in r.levels]) for r in mf.proofs(odd_docs, fanout=fanout, levels=levels).collect())
    assert got == brute(odd_docs.collect(), fanout)


def test_altered_rows_do_not_fold_to_the_root(odd_docs):
    other = F.when(F.col("doc_id") % 2 == 0, mf.leaf_hash(*(F.lit("x") if c == "text" else F.col(c) for c in mf.LEAF_COLUMNS)))
    rows = mf.proofs(odd_docs, carry={"h": other, "rank": F.lit("r")})
    rows = rows.withColumn("ok", mf.folded(F.coalesce("h", "leaf"), F.col("levels")) == F.col("root")).collect()
    assert all(r.ok == (r.doc_id is None or r.doc_id % 2 == 1) and r.rank == "r" for r in rows)


def test_one_row_one_group_and_none(spark, no_docs):
    one = spark.createDataFrame([(5, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    r = mf.proofs(one).first()
    assert r.leaf == H("1:5----") == r.subroot == r.root and r.levels == []
    assert mf.proofs(no_docs).count() == 0
    same = one.union(one).union(one)
    got = mf.proofs(same).collect()
    assert {r.root for r in got} == {H(*[H("1:5----")] * 3)} and len(got) == 3


@pytest.mark.parametrize("parts", [1, 7])
def test_ranks(spark, odd_docs, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ranked(odd_docs.select("lang", "doc_id", "rid"), ["lang"], ["doc_id", "rid"], "t").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    by = {}
    for r in odd_docs.collect():
        by.setdefault(r.lang, []).append((r.doc_id is not None, r.doc_id or 0, r.rid))
    want = {(g, x[2]): (i, len(v)) for g, v in by.items() for i, x in enumerate(sorted(v))}
    assert {(r.lang, r.rid): (r["rank"], r.n) for r in got} == want and len(got) == len(want)
