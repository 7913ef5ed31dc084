"""Range requests against a line index: which commits, files and authors
belong to a piece of code.

A range request is one row ``(req_id, path, start_line, end_line)``;
``end_line = 0`` means "to the end of the file".  An index is either one
row per line with a ``commit_ids`` array, or its exploded form
(path, line_no, [pos], commit_id).  All tables may have a leading ``repo``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import commit_key, file_key, repo_key
from ..functions.text import commit_url, split_message

# Width of the line bins that look-ups and islands are made in; what one row or window holds of a file is bounded by it.
COVER_BIN = 4096
# Files of a commit that one task joins; commits with more are split.
MASS_FILES = 100_000
# Files of a set that are unfolded for a request at once, the parts that requests are dealt over for that, and the packs of a part.
CHUNK_FILES, REQUEST_PARTS, REQUEST_PACKS = 1000, 8, 64
# A range is expanded this many lines at a time.
RANGE_BIN = 1 << 20


def as_line_commits(index: DataFrame) -> DataFrame:
    """Index in exploded form: path, line_no, pos, commit_id."""
    k = file_key(index)
    if "commit_ids" in index.columns:
        return index.select(*k, "line_no", F.posexplode("commit_ids").alias("pos", "commit_id"))
    if "pos" not in index.columns:
        return index.select(*k, "line_no", F.lit(0).alias("pos"), "commit_id")
    return index.select(*k, "line_no", "pos", "commit_id")


def line_counts_from_index(index: DataFrame) -> DataFrame:
    """Lines per file taken from the index (its last line)."""
    return index.groupBy(*file_key(index)).agg(F.max("line_no").cast("bigint").alias("n_lines"))


def expand_ranges(requests: DataFrame, counts: DataFrame | None = None, clamp: bool = False) -> DataFrame:
    """One row per requested line; ``end_line = 0`` reads to the file's end.

    ``counts``: (path, n_lines).  A whole-file request on a file with no
    known length yields no lines.  ``clamp``: lines after the file's end are left out, as look-ups
    want it, so a range of any length costs no more than the file; files of unknown length have no lines then.
    """
    k = file_key(requests)
    if counts is not None:
        r = requests.join(counts.select(*k, F.col("n_lines").cast("bigint").alias("_n")), k, "left")
    else:
        r = requests.withColumn("_n", F.lit(None).cast("bigint"))
    end = F.when(F.col("end_line") == 0, F.col("_n")).otherwise(F.col("end_line")).cast("bigint")
    if clamp:
        end = F.when(F.col("_n").isNotNull(), F.least(end, "_n"))
    r = r.withColumn("_s", F.col("start_line").cast("bigint")).withColumn("_e", end).where("_s <= _e")
    return (r.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / RANGE_BIN), F.floor(F.col("_e") / RANGE_BIN))))
            .withColumn("line_no", F.explode(F.sequence(F.greatest("_s", F.col("_b") * RANGE_BIN),
                                                        F.least("_e", F.col("_b") * RANGE_BIN + RANGE_BIN - 1))))
            .drop("_n", "_s", "_e", "_b"))


def lines_to_commits(lines: DataFrame, index: DataFrame) -> DataFrame:
    """Exact lines joined to their commits (one row per line and commit)."""
    return lines.join(as_line_commits(index), [*file_key(index), "line_no"])


def lines_in_range(history: DataFrame, requests: DataFrame,
                   counts: DataFrame | None = None) -> DataFrame:
    """Index rows whose line lies in a request's range.

    The range, up to the last line that the history has, is expanded to lines first, so the join is an
    equi-join on the line rather than a range condition evaluated per pair.  ``counts``: (path, n_lines), what
    ``end_line = 0`` stands for and where ranges end.
    """
    k = file_key(history)
    if counts is None:
        counts = line_counts_from_index(history.join(requests.select(*k).distinct(), k, "left_semi"))
    lines = expand_ranges(requests, counts, clamp=True).select("req_id", *k, "line_no")
    return lines.join(history, [*k, "line_no"])


def _next_keys(points: DataFrame, keys: DataFrame, k: list[str]) -> DataFrame:
    """``k, at, key, ...``: for each distinct point ``(k, at)`` the smallest of ``keys(k, key, ...)`` (each once) that is not before it, with
    what goes with it; all are bigint.  Points behind the last key give no row.

    A point counts once, however often it was asked for.  Points and keys come together
    in bins of COVER_BIN places, where the next key is carried back over the points;
    a bin without one takes the first key of the next bin that has any.  No key is spread over the places that it answers for.
    """
    more = [c for c in keys.columns if c not in (*k, "key")]
    u = points.select(*k, F.col("at").cast("bigint").alias("at")).distinct().select(*k, "at", F.lit(0).alias("_is_key"), *(F.lit(None).cast("bigint").alias(c) for c in more)) \
        .union(keys.select(*k, F.col("key").cast("bigint"), F.lit(1), *(F.col(c).cast("bigint") for c in more))).withColumn("_b", F.floor(F.col("at") / COVER_BIN))
    key = F.when(F.col("_is_key") == 1, F.struct(F.col("at").alias("key"), *more))
    back = Window.partitionBy(*k, "_b").orderBy(F.desc("at"), F.desc("_is_key")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = u.withColumn("_own", F.last(key, ignorenulls=True).over(back)).where("_is_key = 0")
    first = u.groupBy(*k, "_b").agg(F.min(key).alias("_first"))
    ahead = Window.partitionBy(*k).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)  # one row for a bin of a file
    carry = first.select(*k, "_b", F.last("_first", ignorenulls=True).over(ahead).alias("_carry"))
    found = near.join(carry, [*k, "_b"]).select(*k, "at", F.coalesce("_own", "_carry").alias("_f")).where("_f is not null")
    return found.select(*k, "at", *(F.col(f"_f.{c}").alias(c) for c in ("key", *more)))


def nearest_forward(lines: DataFrame, index: DataFrame, all_asked: bool = False, requests: DataFrame | None = None) -> DataFrame:
    """Forward as-of join.  Each requested line takes the indexed line
    equal to it, else the smallest indexed line above it, as ``key_line``.
    Lines above the file's last indexed line drop out (see O25).  Only the requested files' rows are looked at; ``all_asked``: ``index``
    has no others; ``requests``: a table of the requested files that is cheaper to read than ``lines``."""
    f = file_key(index)
    asked = lines.select(*f, F.col("line_no").cast("bigint").alias("at"))
    mine = index if all_asked else index.join((asked if requests is None else requests).select(*f), f, "left_semi")
    keys = mine.select(*f, F.col("line_no").alias("key")).distinct()
    found = _next_keys(asked, keys, f).select(*f, F.col("at").alias("_at"), F.col("key").alias("key_line"))
    return lines.withColumn("_at", F.col("line_no").cast("bigint")).join(found, [*f, "_at"]).select(*lines.columns, "key_line")


def forward_commits(lines: DataFrame, index: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Nearest-forward lines joined to the commits of their key line."""
    nf = nearest_forward(lines, index, requests=requests)
    lc = as_line_commits(index).withColumnRenamed("line_no", "key_line")
    return nf.join(lc, [*file_key(index), "key_line"])


def uncovered_lines(lines: DataFrame, index: DataFrame, mode: str = "exact") -> DataFrame:
    """Requested lines with no exact index row (``exact``) or above the
    file's last indexed line (``forward``)."""
    k = file_key(index)
    if mode == "exact":
        return lines.join(index.select(*k, "line_no"), [*k, "line_no"], "left_anti")
    last = index.groupBy(*k).agg(F.max("line_no").alias("_last"))
    return (lines.join(last, k, "left")
            .where(F.col("_last").isNull() | (F.col("line_no") > F.col("_last"))).drop("_last"))


def as_intervals(requests: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """``req_id, k, start_line, end_line`` as bigint, ``end_line = 0`` replaced by the file's length; empty ranges and
    whole-file requests on files of unknown length drop out.  One row for a request, however many lines it asks for."""
    k = file_key(requests)
    r = requests if counts is None else requests.join(counts.select(*k, F.col("n_lines").cast("bigint").alias("_n")), k, "left")
    end = F.when(F.col("end_line") == 0, F.lit(None).cast("bigint") if counts is None else F.col("_n")).otherwise(F.col("end_line"))
    return r.select("req_id", *k, F.col("start_line").cast("bigint").alias("start_line"), end.cast("bigint").alias("end_line")).where("start_line <= end_line")


def line_islands(index: DataFrame) -> DataFrame:
    """``k, first_line, last_line``: runs of neighbouring indexed lines, cut at the borders of bins."""
    k = file_key(index)
    bins = index.select(*k, F.col("line_no").cast("bigint").alias("n")).groupBy(*k, F.floor(F.col("n") / COVER_BIN).alias("_b")) \
        .agg(F.sort_array(F.collect_set("n")).alias("ns"))
    starts = F.filter("ns", lambda n, i: F.coalesce(F.get("ns", i - 1) < n - 1, F.lit(True)))
    ends = F.filter("ns", lambda n, i: F.coalesce(F.get("ns", i + 1) > n + 1, F.lit(True)))
    return bins.select(*k, F.inline(F.arrays_zip(starts.alias("first_line"), ends.alias("last_line"))))


# Before and behind all lines.
_FIRST, _LAST = -(1 << 62), 1 << 62


def _gaps(index: DataFrame) -> DataFrame:
    """``k, gap_no, gap_start, gap_end``: what the islands of each file leave, to both sides without end; numbered from 0."""
    k = file_key(index)
    w = Window.partitionBy(*k).orderBy("first_line")  # one row for an island of a file
    after = F.struct((F.col("last_line") + 1).alias("gap_start"), (F.coalesce(F.lead("first_line").over(w), F.lit(_LAST + 1)) - 1).alias("gap_end"))
    before = F.struct(F.lit(_FIRST).alias("gap_start"), (F.col("first_line") - 1).alias("gap_end"))
    rows = line_islands(index).select(*k, "first_line", F.row_number().over(w).alias("_i"), after.alias("after"), before.alias("before"))
    rows = rows.select(*k, F.inline(F.when(F.col("_i") == 1, F.array("before", "after")).otherwise(F.array("after")))).where("gap_start <= gap_end")
    return rows.select(*k, (F.row_number().over(Window.partitionBy(*k).orderBy("gap_start")) - 1).cast("bigint").alias("gap_no"), "gap_start", "gap_end")


def uncovered_ranges(requests: DataFrame, index: DataFrame, mode: str = "exact", counts: DataFrame | None = None) -> DataFrame:
    """O25 on ranges: ``req_id, k, start_line, end_line``, the parts of each request without an index row (``exact``) or above the
    file's last indexed line (``forward``).

    Requests stay intervals and lose the islands of indexed lines: both ends of a request find their gap by an as-of look-up, and
    the gaps in between are its result, so cost follows requests and gaps, not lines.
    """
    k = file_key(requests)
    r = as_intervals(requests, counts)
    index = index.join(r.select(*k), k, "left_semi")
    if mode == "forward":
        last = index.groupBy(*k).agg(F.max("line_no").cast("bigint").alias("_last"))
        start = F.greatest("start_line", F.coalesce(F.col("_last") + 1, "start_line"))
        return r.join(last, k, "left").select("req_id", *k, start.alias("start_line"), "end_line").where("start_line <= end_line")
    gaps = _gaps(index)
    points = r.select(*k, F.explode(F.array("start_line", "end_line")).alias("at"))
    found = _next_keys(points, gaps.select(*k, F.col("gap_end").alias("key"), "gap_start", "gap_no"), k)

    def at(name, line):
        return found.select(*k, F.col("at").alias(line), F.struct("gap_start", "gap_no").alias(name))
    r = r.join(at("_a", "start_line"), [*k, "start_line"], "left").join(at("_e", "end_line"), [*k, "end_line"], "left")
    # The gap that ends behind the request's end counts if it begins before it.
    upto = F.when(F.col("_e.gap_start") <= F.col("end_line"), F.col("_e.gap_no")).otherwise(F.col("_e.gap_no") - 1)
    r = r.withColumns({"_from": F.col("_a.gap_no"), "_upto": upto})
    without = r.where("_from is null").select("req_id", *k, "start_line", "end_line")  # files that have no index row
    within = r.where("_from <= _upto").withColumn("gap_no", F.explode(F.sequence("_from", "_upto"))).join(gaps, [*k, "gap_no"])
    return without.unionByName(within.select("req_id", *k, F.greatest("start_line", "gap_start").alias("start_line"),
                                             F.least("end_line", "gap_end").alias("end_line")))


def request_hits(lines: DataFrame, index: DataFrame, lookup: str = "exact") -> DataFrame:
    """Requested lines to (line, commit) hits with the chosen lookup."""
    if lookup == "forward":
        return forward_commits(lines, index)
    return lines_to_commits(lines, index)


def related_files(hits: DataFrame, touches: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """Occurrences per file over all (line, commit) hits of a request.

    Each hit counts every file its commit changed, the requested file too.
    Hits are first reduced to a multiplicity per (request, commit) so the
    fan-out to changed files is joined once per commit.  ``mass``: commits that changed very many files (``mass_commits``),
    whose files are added last, see ``_summed_with_mass``.
    """
    return _related(_multiplicities(hits), touches, mass)


def _multiplicities(hits: DataFrame) -> DataFrame:
    return hits.groupBy("req_id", *commit_key(hits)).agg(F.count(F.lit(1)).cast("bigint").alias("multiplicity"))


def _related(mult: DataFrame, touches: DataFrame, mass: DataFrame | None) -> DataFrame:
    return _summed(_files_of(mult, touches, None)) if mass is None else _summed_with_mass(mult, touches, mass)


def _summed_with_mass(mult: DataFrame, touches: DataFrame, mass: DataFrame) -> DataFrame:
    """``_summed`` without a row, nor a shuffle, of the pairs of a request and a file that only mass commits make.

    Files that the same mass commits changed, each as often, are one set; a request's sum over those commits is the same for
    all files of a set.  Sets are cut into chunks of about ``CHUNK_FILES`` files, which have numbers there.  What other commits bring to files of a
    set comes as numbers to the chunk's part for the request, and so do the requests of the set, packed; there a request's files are
    unfolded in stretches between those numbers.  Files that no mass commit changed are summed as ever.
    """
    c, r = commit_key(mult), repo_key(mult)

    def same(a, b, names):
        return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])
    files = touches.select(*c, F.col("path").alias("related_path")).join(F.broadcast(mass.select(*c, F.lit(True).alias("_big"))), c, "left")
    # Each file of a mass commit stands in one set; the set's MD5 is its name (see lineage.list_dictionary).
    member = F.sort_array(F.collect_list(F.struct("commit_id", "_times")))
    sets = files.where("_big").repartition(*r, "related_path").groupBy(*c, "related_path").agg(F.count(F.lit(1)).alias("_times")) \
        .groupBy(*r, "related_path").agg(member.alias("_set")).withColumn("_sid", F.unhex(F.md5(F.to_json("_set"))))
    sizes = sets.groupBy(*r, "_sid").agg(F.ceil(F.count(F.lit(1)) / CHUNK_FILES).cast("int").alias("_chunks"), F.first("_set").alias("_set"))
    # Null paths too, so as structs: their numbers follow from the set alone.
    chunks = sets.alias("f").join(sizes.alias("z"), same("f", "z", [*r, "_sid"])).select("f.*", "_chunks") \
        .groupBy(*r, "_sid", F.pmod(F.xxhash64("related_path"), F.col("_chunks")).cast("int").alias("_chunk")) \
        .agg(F.sort_array(F.collect_list(F.struct("related_path"))).alias("_files"))
    places = chunks.select(*r, "_sid", "_chunk", F.posexplode("_files").alias("_at", "_file")).select(*r, "_sid", "_chunk", "_at", F.col("_file.related_path").alias("related_path"))
    others = files.where("_big is null").alias("f").join(places.alias("p"), same("f", "p", [*r, "related_path"]), "left").select("f.*", "_sid", "_chunk", "_at")
    part = F.pmod(F.xxhash64("req_id"), F.lit(REQUEST_PARTS)).cast("int").alias("_part")
    cell = [*r, "_sid", "_chunk", "_part"]
    pairs = mult.join(others.where("_sid is not null"), c).select(*r, "_sid", "_chunk", part, "req_id", "_at", "multiplicity")
    totals = mult.join(sizes.select(*r, "_sid", "_chunks", F.inline("_set")), c) \
        .groupBy("req_id", *r, "_sid", "_chunks").agg(F.sum(F.col("multiplicity") * F.col("_times")).cast("bigint").alias("_total"))
    packs = totals.groupBy(*r, "_sid", "_chunks", part, F.pmod(F.hash("req_id"), F.lit(REQUEST_PACKS)).alias("_pack")) \
        .agg(F.sort_array(F.collect_list(F.struct("req_id", "_total"))).alias("_q")) \
        .select(*r, "_sid", "_part", F.col("_q.req_id").alias("_reqs"), F.col("_q._total").alias("_totals"), F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_chunk"))
    # By number: few bytes make many rows, so parts are not put together.
    n = int(mult.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    met = pairs.unionByName(packs, allowMissingColumns=True).repartition(n, *cell)
    own = F.struct("req_id", F.lit(None).cast("bigint").alias("_total"))
    packed = F.transform(F.arrays_zip("_reqs", "_totals"), lambda x: F.struct(x["_reqs"].alias("req_id"), x["_totals"].alias("_total")))
    rows = met.select(*cell, "_at", "multiplicity", F.inline(F.when(F.col("_reqs").isNull(), F.array(own)).otherwise(packed)))
    rows = rows.groupBy(*cell, "req_id", "_at").agg(F.sum("multiplicity").cast("bigint").alias("_more"), F.max("_total").alias("_total")) \
        .groupBy(*cell, "req_id").agg(F.max("_total").alias("_total"), F.sort_array(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_more")))).alias("_known"))

    def stretch(begin, end, more):
        return F.struct(begin.cast("int").alias("_from"), end.cast("int").alias("_upto"), more.cast("bigint").alias("_more"))
    none, last = F.lit(0), F.lit((1 << 31) - 1)
    # In the order of the files, so that the rows of one request repeat those of another and are written in few bytes.
    known = F.transform("_known", lambda x: stretch(x["_at"], x["_at"], x["_more"]))
    gaps = F.transform("_known", lambda x, i: F.array(stretch(F.coalesce(F.get("_known", i - 1)["_at"] + 1, none), x["_at"] - 1, none), stretch(x["_at"], x["_at"], x["_more"])))
    rest = F.array(stretch(F.coalesce(F.get("_known", F.size("_known") - 1)["_at"] + 1, none), last, none))
    rows = rows.withColumn("_stretches", F.when(F.col("_total").isNull(), known).otherwise(F.concat(F.flatten(gaps), rest))).drop("_known")
    copies = chunks.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(REQUEST_PARTS - 1)))).repartition(n, *cell)
    found = rows.hint("merge").join(copies, cell).select("req_id", *r, "_files", "_total", F.inline("_stretches"))
    upto = F.least("_upto", F.size("_files") - 1)
    unfolded = found.select("req_id", *r, "_files", "_total", "_more", F.explode(F.when(F.col("_from") <= upto, F.sequence("_from", upto))).alias("_at")) \
        .select("req_id", *r, F.get("_files", F.col("_at"))["related_path"].alias("related_path"), (F.coalesce("_total", F.lit(0)) + F.col("_more")).alias("occurrences"))
    return _summed(mult.join(others.where("_sid is null").select(*c, "related_path"), c)).unionByName(unfolded)


def _summed(j: DataFrame) -> DataFrame:
    return j.groupBy("req_id", *repo_key(j), "related_path").agg(F.sum("multiplicity").cast("bigint").alias("occurrences"))


def mass_commits(touches: DataFrame, files: int = MASS_FILES) -> DataFrame:
    """``commit, parts``: the commits that changed more than ``files`` files, and into how many parts of about that size they split.
    At most touches / files rows, which bounds what ``commits_to_files`` broadcasts."""
    c = commit_key(touches)
    return touches.groupBy(*c).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > int(files)) \
        .select(*c, F.ceil(F.col("n") / int(files)).cast("int").alias("parts"))


def commits_to_files(hits: DataFrame, touches: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """Each (request, commit) with its multiplicity, joined to every file
    the commit changed (many-to-many on commit_id, joined once per commit).

    ``mass``: commits that changed very many files (``mass_commits``).  Their files are split into parts by path, and the
    multiplicities of their requests copied to every part, so no task joins a whole one."""
    return _files_of(_multiplicities(hits), touches, mass)


def _files_of(mult: DataFrame, touches: DataFrame, mass: DataFrame | None) -> DataFrame:
    c = commit_key(mult)
    files = touches.select(*c, F.col("path").alias("related_path"))
    if mass is None:
        return mult.join(files, c)
    mass = F.broadcast(mass.select(*c, "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("related_path"), F.col("parts")), F.lit(0)).cast("int")
    files = files.join(mass, c, "left").withColumn("_part", part).drop("parts")
    mult = mult.join(mass, c, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return mult.join(files, [*c, "_part"]).drop("_part")


# Hits by commit list (see lineage.list_dictionary): lines that share a list are counted before the list is unfolded.


def lines_to_lists(lines: DataFrame, index: DataFrame) -> DataFrame:
    """O22 on an index with list ids: exact lines joined to their commit list's id."""
    k = file_key(index)
    return lines.join(index.select(*k, "line_no", "list_id"), [*k, "line_no"])


def list_hits(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """``req_id, commit_id, pos, lines, first_line_no``: a request's lists unfolded once each, with the number of its lines that
    have the list and the first of them."""
    r = repo_key(lists)
    per_list = hits.groupBy("req_id", *r, "list_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line_no"))
    return per_list.join(lists, [*r, "list_id"]).select("req_id", *r, "lines", "first_line_no", F.posexplode("commit_ids").alias("pos", "commit_id"))


def related_files_by_lists(hits: DataFrame, lists: DataFrame, touches: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """O33 from the hits of ``lines_to_lists``."""
    u = list_hits(hits, lists)
    mult = u.groupBy("req_id", *commit_key(u)).agg(F.sum("lines").cast("bigint").alias("multiplicity"))
    return _related(mult, touches, mass)


def commits_of_range_by_lists(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """O35 from the hits of ``lines_to_lists``."""
    return commits_of_range(list_hits(hits, lists).withColumnRenamed("first_line_no", "line_no"))


def top_related_files(related: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent files per request (ties by path).

    ``row_number() <= k`` is planned as a window group limit, so each task
    keeps only k rows per request before the shuffle.
    """
    w = Window.partitionBy("req_id").orderBy(F.col("occurrences").desc(), F.col("related_path"))
    return (related.withColumn("rank", F.row_number().over(w).cast("bigint"))
            .where(F.col("rank") <= int(k)))


def commits_of_range(hits: DataFrame) -> DataFrame:
    """Distinct commits of a request with the first (line, position) that saw them."""
    c = commit_key(hits)
    return (hits.groupBy("req_id", *c)
            .agg(F.min(F.struct(F.col("line_no"), F.col("pos"))).alias("_f"))
            .select("req_id", *c, F.col("_f.line_no").alias("first_line_no"),
                    F.col("_f.pos").cast("bigint").alias("first_pos")))


def describe_commits(hits: DataFrame, commits: DataFrame, remote: str | None = None) -> DataFrame:
    """Each commit of a request once, with title, body, author, date and
    web address; commits unknown to ``commits`` drop out.  Order of first
    sight is (first_line_no, first_pos)."""
    c = commits
    if "title" not in c.columns and "message" in c.columns:
        c = c.withColumn("_m", split_message("message")).withColumn("title", F.col("_m.title")) \
            .withColumn("body", F.col("_m.body")).drop("_m")
    if "body" not in c.columns:
        c = c.withColumn("body", F.lit(""))
    hash_col = F.col("commit_hash") if "commit_hash" in c.columns else F.col("commit_id").cast("string")
    url = commit_url(F.lit(remote), hash_col) if remote else F.lit("")
    key = commit_key(hits)
    c = c.select(*key, "title", "body", "author", "commit_ts", url.alias("url"))
    return commits_of_range(hits).join(c, key)


def authors_of_range(hits: DataFrame, commits: DataFrame) -> DataFrame:
    """Per request and author: distinct lines, distinct commits, last date."""
    c = commit_key(hits)
    j = hits.select("req_id", "line_no", *c).join(commits.select(*c, "author", "commit_ts"), c)
    return j.groupBy("req_id", "author").agg(
        F.countDistinct("line_no").cast("bigint").alias("n_lines"),
        F.countDistinct("commit_id").cast("bigint").alias("n_commits"),
        F.max("commit_ts").alias("last_ts"))
