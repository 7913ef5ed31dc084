import random
import re
from collections import Counter, defaultdict

import pytest
from linetrail.llm import divergence as dv
from linetrail.llm.transducer import Transducer, build

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    docs = [((r.lang or ""), (r.source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r.text or "").translate(AZ))) for r in rows]
    seen, groups, out = defaultdict(Counter), defaultdict(Counter), []
    for lang, source, ts in docs:
        seen[lang].update(set(ts))
        groups[lang, source].update(ts)
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in seen.items()}

    def shares(counts, lang):
        total = sum(counts[t] for t in kept[lang])
        return {t: 1 + 10 ** 9 * (counts[t] + 5) // (total + 5 * len(kept[lang])) for t in kept[lang]}
    p = {g: shares(c, g[0]) for g, c in groups.items()}
    for lang in kept:
        mine = [g for g in groups if g[0] == lang]
        q = shares(sum((groups[g] for g in mine), Counter()), lang)
        for g in mine:
            pairs = [(-sum(abs(p[g][t] - p[o][t]) for t in kept[lang]), o[1].encode(), o[1]) for o in mine if o != g]
            best = [(-(p[g][t] - q[t]), t.encode(), t) for t in kept[lang] if groups[g][t] and p[g][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", best, top)):
                out += [(*g, part, name, -v, i + 1) for i, (v, _, name) in enumerate(sorted(items)[:most])]
    return sorted(out)


@pytest.mark.parametrize("kw", [{}, {"segment": 3, "broadcast_bytes": 200, "block": 5, "tile": 1}, {"segment": 50, "broadcast_bytes": 1500, "block": 7, "tile": 2}])
def test_equals_brute_force(odd_docs, kw):
    got = sorted(tuple(r) for r in dv.audit(odd_docs, least_documents=3, top=9, **kw).collect())
    assert got == brute(odd_docs.collect(), 3, 9) and any(r[2] == "term" for r in got)


def test_ties_and_no_terms(spark, no_docs):
    rows = [(1, "b B é", "en", "x"), (2, "a a a é", "en", "x"), (3, "c B é", "en", "y"), (4, None, "en", "z"), (5, "1 2", "fr", "x"), (6, "", "fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumnRenamed("doc_id", "rank")
    assert sorted(tuple(r) for r in dv.audit(docs, least_documents=1, top=50).collect()) == brute(docs.collect(), 1, 50)
    assert sorted(tuple(r) for r in dv.audit(docs).collect()) == brute(docs.collect(), 30, 50)
    assert dv.audit(no_docs).count() == 0


def test_whole_long_text(monkeypatch):
    data = "Größe, ABC abc x1y ".encode() * 50
    want = list(dv.terms(data))
    monkeypatch.setattr(dv, "_LONG", 10)
    assert list(dv.terms(data)) == want and want[:5] == ["größe".encode(), b"abc", b"abc", b"x", b"y"]


def test_share_is_exact(spark):
    cases = [(0, 0, 1), (0, 10 ** 15, 10 ** 7), (10 ** 15 - 1, 10 ** 15, 10 ** 7), (123456789012, 987654321098765, 54321), (7, 9, 3)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(dv.share(df.c, df.n, df.v)).collect()]
    assert got == [1 + 10 ** 9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


@pytest.mark.parametrize("seed", range(6))
def test_transducer(seed):
    rng = random.Random(seed)
    words = sorted({bytes(rng.choice(b"abc\xc3\xff\x00") for _ in range(rng.randint(0, 6))) for _ in range(rng.choice([0, 1, 40, 900]))})
    t = Transducer.from_bytes(build(words).to_bytes())
    other = [bytes(rng.choice(b"abcd\xc3") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    assert t.ordinals(words).tolist() == list(range(len(words))) and [t.term(i) for i in range(len(words))] == words
    assert t.ordinals(other).tolist() == [words.index(w) if w in words else -1 for w in other]
    with pytest.raises(IndexError):
        t.term(len(words))
    # Minimal: as many states as there are different sets of endings.
    ends = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            ends[w[:i]].add(w[i:])
    assert len(t.final) == max(1, len({frozenset(e) for e in ends.values()}))


def test_terms_out_of_order():
    with pytest.raises(ValueError):
        build([b"b", b"a"])
