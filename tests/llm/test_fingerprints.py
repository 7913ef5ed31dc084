import hashlib
import math
import re

import pytest
from linetrail.llm import fingerprints as fp
from linetrail.llm.queries import QUERIES
from pyspark.sql import functions as F

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(AZ)) if x]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a | b else len(a & b) / len(a | b)


def close(got, want, k, union):
    return math.isclose(got, want) if union <= k else abs(got - want) < 4.5 * math.sqrt(max(0.01, want * (1 - want)) / k)


@pytest.mark.parametrize("windows", [None, 1, 7])
def test_edit_audit(odd_docs, windows):
    docs = odd_docs if windows is None else odd_docs.repartition(3)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in docs.collect()))
    want = []
    for i, (known, doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][2]
        half = len(text) // 2
        want.append((doc_id if known else None, len(text), text, text[:len(text) - half] + after[:half], after))
    if windows is None:
        got = fp.edit_audit(docs).collect()
    else:
        real = fp.with_next

        def few(*args, **kw):
            return real(*args, **{**kw, "least_windows": windows})
        fp.with_next = few
        try:
            got = fp.edit_audit(docs).collect()
        finally:
            fp.with_next = real
    assert len(got) == len(want)
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.n_chars, r.edited), []).append(r)
    for doc_id, n, text, edited, after in want:
        r = by[(doc_id, n, edited)].pop()
        assert close(r.near_edited, jaccard(text, edited), fp.K, len(shingles(text) | shingles(edited)))
        assert close(r.near_next, jaccard(text, after), fp.K, len(shingles(text) | shingles(after))) or text == rows[5][2]
        assert len(r.sketch) == min(fp.K, len(shingles(text))) and r.sketch == sorted(set(r.sketch))


def test_equal_texts_have_equal_sketches(odd_docs):
    rows = odd_docs.select("text", fp.sketch(F.col("text")).alias("s"), fp.as_text(fp.sketch(F.col("text"))).alias("t")).collect()
    by = {}
    for r in rows:
        assert by.setdefault((r.text or "").translate(AZ), (r.s, r.t)) == (r.s, r.t)
    back = odd_docs.select(fp.sketch(F.col("text")).alias("s")).select("s", fp.from_text(fp.as_text(F.col("s"))).alias("b")).collect()
    assert all(r.s == r.b for r in back)


def test_sketch_is_the_smallest_hashes(odd_docs):
    for k in (1, 8, 100_000):
        for r in odd_docs.select(fp.sketch(F.col("text"), k).alias("s"), fp.shingle_hashes(F.col("text")).alias("h"), "text").collect():
            assert r.s == sorted(set(r.h))[:k] and len(set(r.h)) == len(shingles(r.text))


def test_parts_merge(spark, odd_docs):
    sets = odd_docs.select("source", fp.sketch(F.col("text")).alias("sketch"))
    all_hashes = {}
    for r in odd_docs.select("source", fp.shingle_hashes(F.col("text")).alias("h")).collect():
        all_hashes.setdefault(r.source, set()).update(r.h)
    got = {r.source: r.sketch for r in fp.merge_sketches(sets, ["source"]).collect()}
    assert got == {s: sorted(h)[:fp.K] for s, h in all_hashes.items()}
    a, b = list(range(-50, 50)), list(range(0, 100))
    row = spark.range(1).select(fp.merged(F.lit(a), F.lit(b), 60).alias("m")).first()
    assert row.m == list(range(-50, 10))


def test_estimates(odd_docs):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    rows = {r.doc_id: r for r in fp.fingerprints(odd_docs).collect()}
    for i in (2, 4, 9, 10, 12):
        n = len(shingles(texts[i]))
        assert rows[i].n_chars == len(texts[i]) and abs(rows[i].n_shingles - n) <= 0.35 * n
    long = odd_docs.where("doc_id = 9").select(fp.sketch(F.col("text")).alias("a"), fp.sketch(F.expr("substring(text, 1, 20000)")).alias("b"))
    r = long.select(fp.containment(F.col("b"), F.col("a")).alias("in"), fp.containment(F.col("a"), F.col("b")).alias("out")).first()
    assert r["in"] > 0.75 and r["out"] < 0.45
    empty = odd_docs.where("doc_id = 2").select(fp.sketch(F.col("text")).alias("e"))
    r = empty.select(fp.resemblance(F.col("e"), F.col("e")).alias("same"), fp.containment(F.col("e"), F.lit([1]).cast("array<bigint>")).alias("c"),
                     fp.resemblance(F.col("e"), F.lit([1]).cast("array<bigint>")).alias("other")).first()
    assert (r.same, r.c, r.other) == (1.0, 1.0, 0.0)


def test_query_and_empty_table(spark, no_docs):
    assert fp.edit_audit(no_docs).count() == 0 and fp.fingerprints(no_docs).count() == 0
    got = {r.doc_id: r for r in QUERIES["op12_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    assert set(got) == {d for d, _ in docs}
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1]):
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - jaccard(text, edited)) < 0.25 and 0 <= r.near_next <= 1
        assert len(r.fingerprint) == 16 * min(fp.K, len(shingles(text)))
