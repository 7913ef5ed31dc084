"""Sources: version-control facts as tables.

The inputs are what git prints (commit lists, ``--name-only`` lists,
zero-context diffs, commit messages, blame lines, JSON index shards),
already loaded as text columns; every parser is a set of column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import commit_key, file_key
from ..plans.scan import keyed_scan
from ..functions.text import (hunk_header_body, parse_hunk_header, short_hash, split_lines,
                              split_message, strip_marker, trim_ws)

# Separators of ``git show -s --format=%s%n%b%n--AUTHOR--%n%an%n--DATE--%n%cd``.
AUTHOR_MARKER = "\n--AUTHOR--\n"
DATE_MARKER = "\n--DATE--\n"
# ``--date=local`` text after the weekday, e.g. "Jan 5 10:00:03 2024".
LOCAL_DATE_PATTERN = r"^([A-Z][a-z]{2}) (\d{1,2}) (\d{2}:\d{2}:\d{2}) (\d{4})$"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
# Blame line: [^]hash [path] (author yyyy-mm-dd hh:mm:ss +zzzz line) text
BLAME_PATTERN = (r"^(\^?[0-9a-fA-F]+)\s+(?:\S+\s+)?\((.*?)\s+"
                 r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})\s+([+-]\d{4})\s+(\d+)\)\s?(.*)$")


def read_commits(commits: DataFrame, touches: DataFrame) -> DataFrame:
    """O1: commits touching each path, oldest first, numbered ``seq`` from 1.

    Order is (commit_ts, commit_id).
    """
    c, k = commit_key(touches), file_key(touches)
    j = touches.select("commit_id", *k).join(commits.select(*c, "commit_ts"), c)
    return keyed_scan(j, k, ["commit_ts", "commit_id"], number="seq")


def parse_messages(df: DataFrame, raw: str = "raw") -> DataFrame:
    """O2: message text to title, body, author and commit time.

    A row is kept only when each marker splits the text in exactly two.
    The weekday is dropped before parsing; the time carries no zone and
    becomes ``timestamp_ntz``.
    """
    a = F.split(F.col(raw), AUTHOR_MARKER.replace("\n", "\\n"), -1)
    out = df.withColumn("_a", a).where(F.size("_a") == 2)
    out = out.withColumn("_b", F.split(F.col("_a")[1], DATE_MARKER.replace("\n", "\\n"), -1)) \
        .where(F.size("_b") == 2)
    msg = split_message(F.col("_a")[0])
    date_text = trim_ws(F.col("_b")[1])
    part = [F.regexp_extract(F.substring("_dt", 5, 64), LOCAL_DATE_PATTERN, i) for i in range(5)]
    month = F.lpad(((F.position(part[1], F.lit(MONTHS)) + 2) / 3).cast("int").cast("string"), 2, "0")
    iso = F.concat(part[4], F.lit("-"), month, F.lit("-"), F.lpad(part[2], 2, "0"), F.lit(" "), part[3])
    ts = F.when(part[0] != "", iso).try_cast("timestamp_ntz")  # never a zoned time: no zone's gaps shift it
    return (out.withColumn("_m", msg).withColumn("_dt", date_text)
            .withColumn("title", F.col("_m.title")).withColumn("body", F.col("_m.body"))
            .withColumn("author", trim_ws(F.col("_b")[0]))
            .withColumn("commit_ts", ts)
            .drop("_a", "_b", "_m", "_dt", raw))


def explode_changed_files(df: DataFrame, raw: str = "raw") -> DataFrame:
    """O3: ``--name-only`` text per commit to one (commit, path) row per file."""
    keys = [c for c in df.columns if c != raw]
    return (df.select(*keys, F.explode(F.split(F.col(raw), "\n", -1)).alias("path"))
            .where(F.length(trim_ws("path")) > 0).distinct())


def diff_lines(diffs: DataFrame, text: str = "diff") -> DataFrame:
    """Diff text to one row per line with its position."""
    keys = [c for c in diffs.columns if c != text]
    return diffs.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def parse_diffs(diffs: DataFrame, text: str = "diff", key=None) -> DataFrame:
    """O4 (with O19 and O53): zero-context diff text per (path, commit) to hunks.

    Lines before the first ``@@`` header are preamble; a combined-diff
    header ``@@@`` ends the diff; ``\\ No newline`` markers are not lines.
    The header counts decide which lines are removed and which added.
    Returns the input keys plus hunk_no, old_start, old_count, new_start,
    new_count, deleted, added (markers stripped).

    A diff is one row and its content lines begin with a marker, so it is cut before the lines that begin with ``@@``:
    no shuffle.  ``key`` is accepted for old callers; all other columns are kept.
    """
    keys = [c for c in diffs.columns if c != text]
    whole = F.concat(F.lit("\n"), F.col(text))
    own = F.element_at(F.split(whole, r"\n *@@@", 2), 1)
    hunks = diffs.select(*keys, F.posexplode(F.split(own, r"\n(?= *@@)", -1)).alias("hunk_no", "_t")).where("hunk_no > 0")
    lines = F.filter(F.split("_t", "\n", -1), lambda x: ~x.startswith("\\"))
    out = hunks.withColumn("_ls", lines).withColumn("_h", parse_hunk_header(hunk_header_body(F.col("_ls")[0]))) \
        .where(F.col("_h").isNotNull())
    o, n = F.col("_h.old_count").cast("int"), F.col("_h.new_count").cast("int")
    return out.select(
        *keys, "hunk_no",
        F.col("_h.old_start").alias("old_start"), F.col("_h.old_count").alias("old_count"),
        F.col("_h.new_start").alias("new_start"), F.col("_h.new_count").alias("new_count"),
        F.transform(F.slice("_ls", 2, o), lambda x: F.regexp_replace(x, r"^-", "")).alias("deleted"),
        F.transform(F.slice("_ls", o + 2, n), strip_marker).alias("added"))


def render_diffs(hunks: DataFrame) -> DataFrame:
    """Hunks (one per path and commit) back to zero-context diff text; the
    inverse of ``parse_diffs`` used for round-trip tests and exports."""
    hdr = F.concat(F.lit("@@ -"), F.col("new_start").cast("string"), F.lit(","),
                   F.col("old_count").cast("string"), F.lit(" +"), F.col("new_start").cast("string"),
                   F.lit(","), F.col("new_count").cast("string"), F.lit(" @@"))
    body = F.concat(F.transform("deleted", lambda x: F.concat(F.lit("-"), x)),
                    F.transform("added", lambda x: F.concat(F.lit("+"), x)))
    pre = F.concat(F.lit("diff --git a/"), F.col("path"), F.lit(" b/"), F.col("path"),
                   F.lit("\n--- a/"), F.col("path"), F.lit("\n+++ b/"), F.col("path"))
    return hunks.withColumn("diff", F.concat_ws("\n", pre, hdr, F.array_join(body, "\n")))


def version_pair_hunks(snapshots: DataFrame) -> DataFrame:
    """The change between consecutive versions of a path as one hunk.

    The hunk is the region between the longest common prefix and suffix
    of the two line lists (a coarse diff, not git's minimal one).  The
    first version is one hunk adding all its lines; equal versions give
    none.  Starts follow git's convention (an empty side starts one line
    before).
    """
    k = file_key(snapshots)
    pair = snapshots.select(*k, "version", "text", F.struct("version", "text").alias("_vt"))
    s = keyed_scan(pair, k, ["version"], previous=("_vt", "_prev"))  # each text moves once
    s = s.where(~F.col("text").eqNullSafe(F.col("_prev.text")))
    none = F.array().cast("array<string>")
    head = [*k, "version", "prev_version"]

    def made(df, kept, **columns):
        # Through a generator: what stands above cannot be written into it, so each text is cut once.
        return df.select(*kept, F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))

    def first_difference(x, y, most):
        same = F.zip_with(x, y, lambda u, v: u == v)
        return F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, most).cast("int")
    s = made(s.withColumn("prev_version", F.col("_prev.version")), head, _a=F.coalesce(split_lines(F.col("_prev.text")), none),
             _b=F.coalesce(split_lines("text"), none))
    m, n = F.size("_a"), F.size("_b")
    mn = F.least(m, n)
    s = made(s, [*head, "_a", "_b"], _p=first_difference(F.slice("_a", 1, mn), F.slice("_b", 1, mn), mn), _m=m, _n=n)
    rest = F.least("_m", "_n") - F.col("_p")
    tail = [F.reverse(F.slice(c, size - rest + 1, rest)) for c, size in ((F.col("_a"), F.col("_m")), (F.col("_b"), F.col("_n")))]
    s = made(s, [*head, "_a", "_b", "_p", "_m", "_n"], _s=first_difference(*tail, rest))
    s = s.withColumns({"_o": F.col("_m") - F.col("_p") - F.col("_s"), "_c": F.col("_n") - F.col("_p") - F.col("_s")}).where("_o > 0 or _c > 0")

    def start(cnt):
        return F.when(F.col(cnt) == 0, F.col("_p")).otherwise(F.col("_p") + 1).cast("bigint")
    return s.select(
        *head, start("_o").alias("old_start"), F.col("_o").cast("bigint").alias("old_count"),
        start("_c").alias("new_start"), F.col("_c").cast("bigint").alias("new_count"),
        F.slice("_a", F.col("_p") + 1, F.col("_o")).alias("deleted"), F.slice("_b", F.col("_p") + 1, F.col("_c")).alias("added"))


def parse_blame(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Blame line text to commit (7 characters), author, time, line, text.

    Unparsable lines are dropped.
    """
    c = F.col(raw)

    def g(i):
        return F.regexp_extract(c, BLAME_PATTERN, i)
    return (df.where(c.rlike(BLAME_PATTERN))
            .withColumn("commit_hash", short_hash(g(1)))
            .withColumn("author", trim_ws(g(2)))
            .withColumn("blame_ts", F.to_timestamp_ntz(g(3), F.lit("yyyy-MM-dd HH:mm:ss")))
            .withColumn("tz", g(4))
            .withColumn("line_no", g(5).cast("bigint"))
            .withColumn("content", g(6))
            .drop(raw))


def import_index_json(df: DataFrame, doc: str = "doc") -> DataFrame:
    """JSON shards ``{line: [commit, ...]}`` to (path, line_no, pos, commit).

    Malformed JSON gives no rows.
    """
    keys = [c for c in df.columns if c != doc]
    m = F.from_json(F.col(doc), "map<string,array<string>>", {"mode": "PERMISSIVE"})
    e = df.select(*keys, F.explode(m).alias("_line", "_commits"))
    return (e.select(*keys, F.expr("try_cast(_line as bigint)").alias("line_no"),
                     F.posexplode("_commits").alias("pos", "commit"))
            .where(F.col("line_no").isNotNull()))


def export_index_json(history: DataFrame, lines_per_doc: int = 10000) -> DataFrame:
    """Line index to JSON shards, one per path and block of lines.

    ``history``: path, line_no, commit_ids.  Keys are written in line
    order.  Large files are cut into blocks of ``lines_per_doc`` lines so
    no document grows with the history of the whole file.
    """
    h = history.withColumn("part", F.floor((F.col("line_no") - 1) / int(lines_per_doc)).cast("bigint"))
    entries = F.sort_array(F.collect_list(F.struct(
        F.col("line_no"), F.col("line_no").cast("string").alias("k"),
        F.transform("commit_ids", lambda x: x.cast("string")).alias("v"))))
    k = file_key(history)
    g = h.groupBy(*k, "part").agg(entries.alias("_e"))
    kv = F.transform("_e", lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value")))
    return g.select(*k, "part", F.to_json(F.map_from_entries(kv)).alias("doc"))
