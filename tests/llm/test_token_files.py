import tempfile
import zlib

import numpy as np
import pytest
from linetrail.llm import token_files as tf
from linetrail.llm.tokens import WordEncoder, token_path


def reference(texts):
    tok = WordEncoder.load(token_path()).tok
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_encoder_equals_library():
    texts = ["It's a test, isn't it? 12 <|endoftext|>x", "İstanbul ΑΣ ὈΔΥΣΣΕΎΣ", "é ́x", "a b\x85c\x1cd", "日本語 テキスト",
             "É À ß ¼ ² ª", "The the THE", "'s 'S don't we'll 'x", "", None, "foo...bar!! a|b**", "<|ENDOFTEXT|>", "\x00 a", "×÷ ñ"]
    enc = WordEncoder(token_path(), keep=3)
    for _ in range(2):
        got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.stream(texts, chars=20)]
        assert got == reference(texts)


@pytest.mark.parametrize("top", [2, 255, 256, 70_000, 1 << 20])
def test_codes_round_trip(top):
    ids = np.random.default_rng(top).integers(0, top, 5000)
    codes = tf.Codes(tf.pack(ids))
    assert (codes.slice(0, 5000) == ids).all()
    assert (codes.slice(777, 3001) == ids[777:3001]).all() and len(codes.slice(9, 9)) == 0
    assert [codes.get(i) for i in (0, 1, 511, 512, 513, 4999)] == ids[[0, 1, 511, 512, 513, 4999]].tolist()
    with pytest.raises(IndexError):
        codes.get(5000)
    assert tf.Codes(tf.pack(ids[:0])).slice(0, 0).size == 0


def test_files(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_TOKENS", 200)
    path = tempfile.mkdtemp(prefix="llm-t-") + "/f"
    tf.write_token_files(odd_docs, path, token_path())
    rows = odd_docs.select("doc_id", "text").collect()
    got = tf.read_documents(spark, path).orderBy("start").collect()
    want = {(r.doc_id, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()), len(ids) + 1)
            for r, ids in zip(rows, reference([r.text for r in rows]))}
    assert {(g.doc_id, g.ids_crc32, g.n_tokens) for g in got} == want and len(got) == len(rows)
    ids = [-1 if g.doc_id is None else g.doc_id for g in got]
    assert ids == sorted(ids)
    at = 0
    for g in got:
        assert g.start == at
        at += g.n_tokens
    by_id = dict(zip([r.doc_id for r in rows], reference([r.text for r in rows])))
    wanted = spark.createDataFrame([(9, 0), (9, 20_000), (4, 3), (4, 10**6), (999, 0)], "doc_id long, i int")
    assert {(r.doc_id, r.i, r.token_id) for r in tf.read_tokens(spark, path, wanted).collect()} == \
        {(d, i, by_id[d][i]) for d, i in ((9, 0), (9, 20_000), (4, 3))}


def test_look_ups_open_few_folders(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_TOKENS", 200)
    path = tempfile.mkdtemp(prefix="llm-t-") + "/f"
    tf.write_token_files(odd_docs.repartition(6), path, token_path())
    wanted = spark.createDataFrame([(150, 0), (150, 2), (150, 2), (None, 0), (12, None), (12, -1)], "doc_id long, i int")
    plan = tf.wanted_segments(spark, path, wanted)
    assert "dynamicpruning" in plan._jdf.queryExecution().executedPlan().toString().lower()
    assert plan.count() == 1
    text = odd_docs.where("doc_id = 150").first().text
    ids = reference([text])[0] + [1]
    assert {(r.doc_id, r.i, r.token_id) for r in tf.read_tokens(spark, path, wanted).collect()} == {(150, i, ids[i]) for i in (0, 2) if i < len(ids)}
    import glob
    import pyarrow.parquet as pq
    kinds = {c.compression for f in glob.glob(path + "/part=*/*.parquet") for m in [pq.ParquetFile(f).metadata]
             for g in range(m.num_row_groups) for c in [m.row_group(g).column(j) for j in range(m.num_columns)]}
    assert kinds == {"UNCOMPRESSED"}


def test_access_query(spark):
    from linetrail.llm.queries import QUERIES
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(d + "/documents.parquet").select("doc_id", "text").collect()}
    want = set()
    for doc, ids in zip(texts, reference(list(texts.values()))):
        ids = [*ids, 1]
        want |= {(doc, i, ids[i]) for i in (0, len(ids) // 2, len(ids) - 1)}
    got = [tuple(r) for r in QUERIES["token_access"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want


def test_no_documents(spark, no_docs):
    path = tempfile.mkdtemp(prefix="llm-t-") + "/f"
    tf.write_token_files(no_docs, path, token_path())
    assert tf.read_documents(spark, path).count() == 0
