"""URL filter: host and path rules first, a logistic regression on hashed character n-grams for the rest.

DataFrame functions throughout, training included (Spark's own logistic
regression).  Rules and weights are parameters of bounded size, kept in the
plan as constants, so URLs are judged where they are read, without a shuffle.

Defined results: host and path of a URL that is null or has no ``://`` are
empty, and no rule fits it; such a URL is judged by the intercept alone.
A rule fits its host and all subdomains if the path starts with the
rule's path; of the fitting rules the longest wins.  Repeated rows get equal
results; an empty table gives no row; a column named as one of the results
is replaced, other columns pass through.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az, unused

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
RESULTS = ["host", "path", "rule", "verdict", "score"]
#: Share of the held-out good URLs that may score as high as a blocked one.
FALSE_ALARMS = 0.002

# Small labelled table, by rule: each word in each place of the templates.
BAD = ("casino poker betting jackpot slots roulette porn xxx sexcam escort nude hentai viagra cialis pills pharma payday loans warez keygen crack "
       "torrent malware trojan phishing freegift clickbait spam hacked replica counterfeit cheats").split()
GOOD = ("news blog docs wiki library science school health recipes travel museum university weather sports music history "
        "garden market support research gallery archive studio forum books maps photos events about contact product search login "
        "article category index help files team").split()
# Syllables whose pairs stand for names that say nothing: to be let through.
SYLLABLES = "th er in an re on ti st sh le ra en ch es ou ma lo ke vi no".split()
# {w}: the word, {n}: a name that says nothing.
PLACES = ["http://www.{w}.com/", "https://{w}.example.net/index.html", "https://blog.example.com/{w}/1234", "http://m.example.org/en/{w}?page=2",
          "http://{w}.org/", "http://{n}-{w}.com/{n}", "https://{w}{n}.example.com/", "http://{n}.{w}.example.org/{n}", "https://{n}.com/{w}", "https://{n}.com/{n}/{w}/{n}",
          "http://www.{n}{w}.net/{n}.html", "https://shop.{n}.com/{n}-{w}-{n}/"]


def _name(i: int) -> str:
    n = len(SYLLABLES)
    return SYLLABLES[i % n] + SYLLABLES[(i * 7 + i // n + 3) % n] + (SYLLABLES[(i * 3 + 1) % n] if i % 2 else "")


def labelled_urls() -> list[tuple[str, int, bool]]:
    """``(url, label, held out)``: label 1 to block; one in four of the places of each word is not learned from."""
    out, i = [], 0
    for y, words in ((1, BAD), (0, GOOD + [_name(k) for k in range(60)])):
        for j, w in enumerate(words):
            for k, p in enumerate(PLACES):
                out.append((p.format(w=w, n=_name(i)), y, (j + k) % 4 == 3))
                i += 1
    return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.substring(url, F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    return lower_az(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``(size, rule, verdict)`` of the longest fitting rule, or null.  ``rules``: verdict, host, path."""
    by_host: dict[str, list[dict]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append({"path": p, "rule": h + p, "verdict": verdict})
    known = F.from_json(F.lit(json.dumps(by_host)), "map<string, array<struct<path: string, rule: string, verdict: string>>>")
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(known, s), F.array()))),
                    lambda r: F.startswith(path, r["path"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def buckets(host: Column, path: Column) -> Column:
    """Distinct buckets of the character n-grams of ``^host$path$``; none where both are empty."""
    marked = F.concat(F.lit("^"), host, F.lit("$"), path, F.lit("$"))
    grams = F.concat(*(F.regexp_extract_all(marked, F.lit("(?s)(?=(.{%d}))" % n), 1) for n in GRAMS))
    return F.when((host == "") & (path == ""), F.array().cast("array<int>")) \
        .otherwise(F.array_distinct(F.transform(grams, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))))


def _size(col: str) -> Column:
    return F.sqrt(F.greatest(F.lit(1), F.size(col)))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", held_col: str = "held_out") -> tuple[list[float], float, float]:
    """``(weights, intercept, block_from)`` from a small table of URLs with labels 1 (block) and 0.

    Features are a URL's buckets, sparse, of length one together.  Rows that are held out, if the table says so, choose the score to block from: the lowest one,
    one half at least, that not more than ``FALSE_ALARMS`` of their good URLs reach."""
    b = buckets(*host_and_path(F.col(url_col)))
    held = F.coalesce(F.col(held_col), F.lit(False)) if held_col in labelled.columns else F.lit(False)
    rows = labelled.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("double").alias("label"), b.cast("array<string>").alias("b"), held.alias("held"),
                                                               F.col(url_col).alias("url"))
    counted = CountVectorizerModel.from_vocabulary([str(k) for k in range(BUCKETS)], inputCol="b", outputCol="counts").transform(rows)
    scaled = Normalizer(inputCol="counts", outputCol="features", p=2.0).transform(counted)
    model = LogisticRegression(maxIter=100, regParam=1e-5, standardization=False).fit(scaled.where("not held").select("label", "features"))
    weights, intercept = model.coefficients.toArray().tolist(), float(model.intercept)
    calm = judge(rows.where("held and label = 0").select("url"), [], weights, intercept).agg(F.percentile("score", F.lit(1 - FALSE_ALARMS))).first()[0]
    return weights, intercept, max(0.5, (calm or 0.0) + 1e-9)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], weights: list[float], intercept: float, url_col: str = "url",
          block_from: float = 0.5) -> DataFrame:
    """All columns with ``host, path, rule, verdict, score``; ``score`` is the regression's.
    A score of ``block_from`` or more blocks."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    url, grams, fit = (unused(pages, n) for n in ("url_in", "grams", "fit"))
    host, path = host_and_path(F.col(url))
    out = pages.withColumn(url, F.col(url_col)).drop(*(c for c in RESULTS if c != url_col)) \
        .withColumns({"host": host, "path": path})
    out = out.withColumns({grams: buckets(F.col("host"), F.col("path")), fit: matched_rule(F.col("host"), F.col("path"), rules)})
    total = F.aggregate(grams, F.lit(0.0), lambda s, k: s + F.element_at(table, k + 1))
    out = out.withColumn("score", 1 / (1 + F.exp(-(total / _size(grams) + intercept))))
    own = F.when(F.col("score") >= block_from, "block").otherwise("allow")
    return out.withColumns({"rule": F.col(f"{fit}.rule"), "verdict": F.coalesce(f"{fit}.verdict", own)}).drop(url, grams, fit)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_urls(), "url string, label int, held_out boolean").coalesce(1)
