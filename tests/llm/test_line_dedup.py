import itertools
import random

from linetrail.llm import line_dedup as ld
from linetrail.llm.components import connected_components
from pyspark.sql import functions as F


def norm(line):
    return line.lower().strip(" ")


def shingle_set(line):
    u = norm(line)
    return {u[p:p + 8] for p in range(max(1, len(u) - 7))}


def brute(docs):
    """Texts after all lines of a component but its first are gone."""
    lines = sorted({norm(x) for _, t in docs for x in (t or "").split("\n")} - {""})
    sets, root = {x: shingle_set(x) for x in lines}, {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(lines, 2):
        c = len(sets[a] & sets[b])
        if 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
            root[find(a)] = find(b)
    seen, out = set(), {}
    for i, t in docs:
        keep = []
        for x in (t or "").split("\n"):
            r = find(norm(x)) if norm(x) else None
            if r is None or r not in seen:
                keep.append(x)
            seen.add(r)
        out[i] = None if t is None else "\n".join(keep)
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijö") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(60)]

    def variant(line):
        w = line.split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        return " ".join(w).upper() if rng.random() < 0.1 else "  " + " ".join(w)
    return [(i, "\n".join(variant(rng.choice(base)) if rng.random() < 0.8 else rng.choice(["", " ", "x", "\t"])
                          for _ in range(rng.randint(0, 12)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "\n")]


def test_equals_brute_force(spark):
    docs = corpus(4, 120)
    got = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert "Python" not in got._jdf.queryExecution().toString()
    rows, want = got.collect(), brute(docs)
    assert len(rows) == len(docs)
    wrong = [r.doc_id for r in rows if r.text != want[r.doc_id]]
    assert len(wrong) <= 2  # a link near the threshold is a candidate with probability 0.987
    for r in rows:
        t = dict(docs)[r.doc_id] or ""
        assert r.n_lines == sum(1 for x in t.split("\n") if x.strip(" "))
        assert r.n_dropped == r.n_lines - sum(1 for x in (r.text or "").split("\n") if x.strip(" "))


def test_odd_rows(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("n_lines", F.lit("mine"))
    got = ld.dedup_lines(clash)
    assert sorted(got.columns) == sorted([*odd_docs.columns, "n_lines", "n_dropped"])
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[3][0].text == " \n\t "
    assert by[4][0].n_dropped == 0 and by[5][0].text == "" and [r.text for r in by[6]] == ["", ""]
    assert by[None][0].n_dropped == 0 and by[8][0].n_dropped == 1  # the null id comes first
    assert by[9][0].n_dropped == 0 and by[10][0].text == "" and by[11][0].text == ""
    assert ld.dedup_lines(no_docs).count() == 0


def similar_pairs():
    """Pairs of lines whose similarity is 0.75 or a little more: without blanks, with one, short, and about 32 characters a blank."""
    rng = random.Random(9)

    def run(n, chars="abcdefghijklmnopqrstuvwxyz0123456789,\t_語言処理学習"):
        return "".join(rng.choice(chars) for _ in range(n))
    out = []
    for _ in range(8):
        for n in (12, 20, 31, 32, 33, 34, 64, 65, 200):
            one, two, three = run(n), run(n), run(n) + run(20)
            out += [("#" + one, "%" + one), (two + "," + run(3), two), ("12 " + three, "13 " + three)]
        w = [run(31, "abcdefghij") for _ in range(8)]
        out.append((" ".join(w), " ".join([*w[:3], w[3] + w[4], *w[5:]])))  # a blank less
    return [(a, b) for a, b in out if 4 * len(shingle_set(a) & shingle_set(b)) >= 3 * len(shingle_set(a) | shingle_set(b)) and norm(a) != norm(b)]


def test_short_blank_free_and_boundary_lines(spark):
    pairs = similar_pairs()
    assert len(pairs) > 120
    docs = [(2 * i + k, line) for i, pair in enumerate(pairs) for k, line in enumerate(pair)]
    rows = {r.doc_id: r.n_dropped for r in ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    missed = [pairs[i] for i in range(len(pairs)) if rows[2 * i + 1] != 1]
    assert not any(rows[2 * i] for i in range(len(pairs))) and len(missed) <= 2


def test_repeated_line_is_as_short_as_it_is(spark):
    docs = spark.createDataFrame([(i, "a line that stands in many documents") for i in range(50)], "rid long, _text string")
    assert [r.n for r in ld._signatures(ld._lines(docs)).collect()] == [29]


def test_lines_with_little_in_common_rarely_meet(spark):
    """Of lines that have only a heading in common (similarity 0.05) few pairs become candidates; with bands of three minima 1,700 would."""
    rng = random.Random(12)
    docs = [(i, "a heading of all:" + "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(90))) for i in range(1500)]
    bands = ld._signatures(ld._lines(spark.createDataFrame(docs, "rid long, _text string"))).select("k1", F.explode("bands").alias("band"))
    pairs = bands.join(bands.withColumnRenamed("k1", "other"), "band").where("k1 < other").select("k1", "other").distinct()
    assert pairs.count() < 700


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(1000 + i, 5000 - i) for i in range(20)] + [(7, 7), (900, 20), (900, 80)]
    edges += [(3000, 3001 + rng.randrange(300)) for _ in range(500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = connected_components(spark.createDataFrame([*edges, (None, 5), (6, None)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in root} and len(got) == len(root)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bitmaps_rule_out_only_pairs_that_cannot_link(spark):
    """Lines of one group that lie below the threshold are told apart without their texts; no pair that links is lost."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [rng.choice(words) for _ in range(60)]
    lines = [" ".join(rng.choice(words) if rng.random() < edits else w for w in base) for edits in (0.02, 0.1, 0.15) for _ in range(30)]
    lines = sorted({norm(x) for pair in similar_pairs() for x in pair} | set(lines))
    sets = [shingle_set(x) for x in lines]
    texts = spark.createDataFrame([(i, x, len(s)) for i, (x, s) in enumerate(zip(lines, sets))], "lid long, line string, d int")
    maps = ld.written(ld._bitmaps(texts), "t")
    got = ld._as(maps, "x").crossJoin(ld._as(maps, "y")).where((F.col("xlid") < F.col("ylid")) & ld._may_link()).select("xlid", "ylid").collect()
    like = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(lines)), 2)}
    got = {(r.xlid, r.ylid) for r in got}
    assert {p for p, j in like.items() if j >= 0.75} <= got
    below = [p for p, j in like.items() if 0.3 <= j < 0.65]
    assert len(below) > 500 and not got & {*below}
