import zlib

import numpy as np
import pytest
from linetrail.llm import packing as pk
from linetrail.llm.tokens import WordEncoder, token_path


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_rest_once(seed):
    rng = np.random.default_rng(seed)
    window = [16, 64, 2048, 2048, 128][seed]
    hist = np.zeros(window, dtype=np.int64)
    lengths = [rng.integers(1, window, 500), np.full(700, window * 2 // 3), rng.integers(1, 12, 50)][:3 if seed != 3 else 1]
    for v in np.concatenate(lengths):
        hist[v] += 1
    plan = pk.make_plan(hist, window)
    v = np.repeat(np.arange(window), hist)
    rank = np.concatenate([np.arange(n) for n in hist])
    seq, off = plan.place(v, rank)
    fill = np.zeros((plan.combined + plan.streamed, window), dtype=int)
    for n, s, o in zip(v, seq, off):
        head = min(n, window - o)
        fill[s, o:o + head] += 1
        if head < n:
            fill[s + 1, :n - head] += 1
    assert fill.max() == 1 and (fill.sum(1) < window).sum() <= 1
    assert all((row[:row.sum()] == 1).all() for row in fill)


def test_empty_histogram():
    assert pk.make_plan(np.zeros(8, dtype=np.int64), 8).combined == 0


def test_least_squares_finds_the_repeats():
    hist = np.zeros(10)
    hist[[4, 6, 2, 5]] = [30, 30, 10, 40]  # 4+6 x 20, 2+2+6 x 0, 5+5 x 20, ...
    cols = pk.combinations(hist.astype(int), 10)
    x = pk.nnls(cols, hist)
    used = np.zeros(10)
    for c, n in zip(cols, x):
        for v in c[c > 0]:
            used[v] += n
    assert (x >= 0).all() and np.abs(used - hist).max() < 0.5


@pytest.mark.parametrize("window", [16, 2048])
def test_pieces(spark, odd_docs, window):
    tok = WordEncoder.load(token_path()).tok
    docs = odd_docs.collect()
    want = sorted(zlib.crc32(np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in docs)
    got = pk.pack(odd_docs, token_path(), window=window).collect()
    by_seq, by_doc = {}, {}
    for r in got:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= window
        by_seq.setdefault(r.sequence_id, []).append(r)
        if r.doc_id != 6:  # two rows share this id
            by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(1 for p in by_seq.values() if sum(r.length for r in p) < window) <= 1
    crcs = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda r: r.start)
        ids = b"".join(r.ids for r in pieces)
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids) // 4}
        crcs.append(zlib.crc32(ids))
    six = [r for r in docs if r.doc_id == 6]
    again = zlib.crc32(np.array([*tok.encode(six[0].text, add_special_tokens=False).ids, 1], "<u4").tobytes())
    assert sorted(crcs + [again, again]) == want


def test_no_documents(spark, no_docs):
    assert pk.pack(no_docs, token_path()).count() == 0


def test_full_word_table_keeps_what_is_met_again():
    rng = np.random.default_rng(5)
    texts = ["the common words " + " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(20)) for _ in range(60)]
    small, large = WordEncoder(token_path(), 100), WordEncoder(token_path())
    got = []
    for t in texts:
        got.append(small.encode(t))
        assert len(small.pieces) <= 100 and {"the", "common", "words"} <= small.pieces.keys()
    assert got == [large.encode(t) for t in texts]
