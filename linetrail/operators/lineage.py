"""Line lineage: which commits shaped each line of a file.

Hunks are applied in new-side coordinates, one after another in the
file's commit order.  Instead of replaying a file forwards (one state per
file, inherently sequential), every final line is traced *backwards*
through the file's hunks on its own:

* start at ``q = line_no`` and walk the hunks newest first, with
  ``pre`` = the file length before that hunk;
* a pure deletion (``n = 0``) at ``s`` moves ``q`` to ``q + o`` when
  ``q > s``;
* a hunk that adds lines ``s .. s+n-1`` containing ``q`` puts its commit
  in front of the history; the line goes on to older hunks only when the
  hunk removed something, the added line counts as a replacement and a
  line sat at ``q`` before the hunk (``q <= pre``);
* a hunk entirely before ``q`` moves it by ``-(n - o)``.

Lines are independent, so the work is spread by (file, block of lines).
Two engines give the same rows: a vectorised kernel that moves all lines
of a block one hunk at a time while the sorted hunks stream through the task
(``mapInArrow``, default; a history of any length), or one ``aggregate``
expression per line over the file's hunks in one array (pure JVM, slower
because Spark interprets higher-order functions step by step).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import file_key, repo_key
from ..functions.text import join_ids
from ..plans.scan import keyed_scan
from ..session import scratch_table_path
from ._kernels import trace_kernel
from ._segments import similar_kernel

# Lines per work unit when a file is spread over tasks (more for files
# with many hunks, see _fold).
LINE_BLOCK = 1024
MAX_LINE_BLOCK = 65536
LINES_PER_HUNK = 4
# Pairs of a removed and an added line that a hunk compares in its own row.
SMALL_PRODUCT = 256
# Added lines of a larger hunk that one task compares.
SLICE_LINES = 50_000


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def pair_previous(hunks: DataFrame) -> DataFrame:
    """Each commit of a path with the commit before it in that path's order."""
    k = file_key(hunks)
    commits = hunks.select(*k, "commit_id", "seq").distinct()
    return keyed_scan(commits, k, ["seq", "commit_id"], previous=("commit_id", "prev_commit_id"))


def mark_replaced(hunks: DataFrame, threshold: int | None = None, product_up_to: int = SMALL_PRODUCT) -> DataFrame:
    """0-based indices of added lines that count as replacing an old line.

    Without a threshold every added line of a hunk that removed something
    is a replacement.  With one, an added line is a replacement when it
    lies within that edit distance of some removed line.

    Hunks of up to ``product_up_to`` pairs of lines compare them in their row.  In larger ones lines meet by equal segments
    (``_similar_by_segments``), with the same result, so no hunk compares all its removed with all its added lines.
    """
    n = F.coalesce(F.col("new_count"), F.lit(0)).cast("int")
    idx = F.transform(F.array_repeat(F.lit(0), n), lambda _x, i: i)
    none = F.array().cast("array<int>")
    if threshold is None:
        return hunks.withColumn("replaced", F.when(F.col("old_count") > 0, idx).otherwise(none))
    t = int(threshold)
    old, new = (F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("deleted", "added"))
    near = F.filter(idx, lambda k: F.exists(old, lambda d: F.levenshtein(d, F.element_at(F.col("added"), k + 1), t) >= 0))
    small = F.size(old) * F.size(new).cast("bigint") <= int(product_up_to)
    if product_up_to >= 1 << 62:
        return hunks.withColumn("replaced", near)
    names, numbered = hunks.columns, hunks.withColumn("_h", F.monotonically_increasing_id())
    path = scratch_table_path(hunks.sparkSession, f"numbered-hunks-{uuid.uuid4().hex}")
    numbered.write.parquet(path)  # made and numbered once: all that follows reads the same numbers
    numbered = hunks.sparkSession.read.schema(numbered.schema).parquet(path)
    inside, large = numbered.where(small).select(*names, near.alias("replaced")), numbered.where(~small)
    found = _similar_by_segments(large, t).groupBy("_h").agg(F.array_sort(F.collect_list("k")).alias("replaced"))
    rest = large.hint("merge").join(found, "_h", "left").select(*names, F.coalesce("replaced", none).alias("replaced"))
    return inside.unionByName(rest)


def _similar_by_segments(hunks: DataFrame, t: int) -> DataFrame:
    """``_h, k``: the added lines within distance ``t`` of a removed one of their hunk.

    Hunks are dealt over all tasks, ones with very many added lines in slices of ``SLICE_LINES`` with all removed lines beside each; a slice's
    lines become rows within its task, and the kernel lets them meet by equal segments.  What the lines offer to meet by is never a row, nor shuffled."""
    none = F.array().cast("array<string>")
    slices = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(F.coalesce("added", none)) / SLICE_LINES).cast("int") - 1))
    dealt = hunks.select("_h", F.coalesce("deleted", none).alias("old"), F.coalesce("added", none).alias("new"), F.explode(slices).alias("_s")) \
        .select("_h", "_s", "old", F.slice("new", F.col("_s") * SLICE_LINES + 1, F.lit(SLICE_LINES)).alias("new"))
    # By number: comparing costs far more than the bytes tell, so parts are not put together.
    dealt = dealt.repartition(_shuffle_partitions(hunks), "_h", "_s")

    def line(new, k, text):
        return F.struct(F.lit(new).alias("is_new"), k.alias("k"), text.alias("text"))
    removed = F.transform("old", lambda x: line(False, F.lit(-1), x))
    added = F.transform("new", lambda x, i: line(True, F.col("_s") * SLICE_LINES + i, x))
    lines = dealt.select("_h", "_s", F.inline(F.concat(removed, added))).where("text is not null")
    return lines.mapInArrow(similar_kernel(t), "_h bigint, k int")


def _hunk_order(hunks: DataFrame) -> DataFrame:
    if "hunk_no" not in hunks.columns:
        hunks = hunks.withColumn("hunk_no", F.lit(0))
    return hunks


def _fold_step(acc: Column, h: Column) -> Column:
    """One backward step of a line through one hunk (SQL engine).

    Dead lines and hunks entirely after the line return the accumulator
    unchanged (no new struct); shifts only replace ``q``.
    """
    q, alive, commits = acc["q"], acc["alive"], acc["commits"]
    hc, hn, hk = acc["hc"], acc["hn"], acc["hk"]
    s, o, n, pre = h["s"], h["o"], h["n"], h["pre"]
    k = (q - s).cast("int")
    replaced = F.when(h["rep_all"], F.lit(True)).otherwise(
        F.coalesce(F.array_contains(h["rep"], k), F.lit(False)))

    def acc_with(new_q, new_alive, new_commits, new_hc, new_hn, new_hk):
        return F.struct(new_q.alias("q"), new_alive.alias("alive"), new_commits.alias("commits"),
                        new_hc.alias("hc"), new_hn.alias("hn"), new_hk.alias("hk"))

    first = hc.isNull()
    hit = acc_with(q, (o > 0) & replaced & (q <= pre) & (h["ov"] | (k < o)),
                   F.concat(F.array(h["c"]), commits),
                   F.when(first, h["c"]).otherwise(hc), F.when(first, h["hunk_no"]).otherwise(hn),
                   F.when(first, k).otherwise(hk))
    return (F.when(~alive, acc)
            .when((n > 0) & (q >= s) & (q < s + n), hit)
            .when((n == 0) & (q > s), acc_with(q + o, alive, commits, hc, hn, hk))
            .when((n > 0) & (q >= s + n), acc_with(q - (n - o), alive, commits, hc, hn, hk))
            .otherwise(acc))


def line_history(hunks: DataFrame, base: DataFrame | None = None,
                 threshold: int | None = None, with_text: bool = True,
                 lines: DataFrame | None = None, engine: str = "arrow",
                 inherit_overflow: bool = True, base_lengths: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """For every line of the final file, its text and all commits that touched it.

    ``hunks``: [repo], path, commit_id, seq, [hunk_no], new_start, old_count, new_count,
    and ``added``/``deleted`` arrays when text or a threshold is wanted.  An
    optional ``replaced`` column (0-based added-line indices) gives the
    replaced sets explicitly; otherwise every added line of a hunk that
    removed something is a replacement, or (with ``threshold``) those within
    that edit distance of a removed line.
    ``base``: an older index (path, line_no, commit_ids, [content]; other columns
    are not read) the hunks continue; its lines are in front of the new history.
    ``base_lengths``: (path, n_lines) of the base, else its last lines.
    ``lines``: optional (path, line_no) restriction (only these final lines
    are traced; the backward form makes that exact).
    ``sizes``: (path, n_hunks, n_lines), each file's number of hunks and final length, where they are known already.

    ``inherit_overflow``: when a hunk adds more lines than it removed, a
    replaced surplus line takes the history of the line that sat at its
    place before the hunk (the rule of the reference); ``False`` starts
    such lines fresh.

    ``engine``: ``"arrow"`` streams the hunks through a vectorised kernel;
    ``"sql"`` runs one ``aggregate`` expression per line.  Both give the same rows.

    Returns [repo], path, line_no, commit_ids (oldest first), [content].
    """
    k = file_key(hunks)
    raw = _prepare(hunks, threshold, inherit_overflow)
    zero = F.lit(0).cast("bigint")
    if base is not None:
        text = F.col("content") if "content" in base.columns else F.lit(None).cast("string")
        base = base.select(*k, F.col("line_no").cast("bigint").alias("line_no"), "commit_ids", text.alias("content"))
        if base_lengths is None:
            base_lengths = base.groupBy(*k).agg(F.max("line_no").alias("n_lines"))
        raw = raw.join(base_lengths.select(*k, F.col("n_lines").cast("bigint").alias("_base_len")), k, "left") \
            .withColumn("_base_len", F.coalesce("_base_len", zero))
    else:
        raw = raw.withColumn("_base_len", zero)
    # Only the numbers are traced; block sizes and texts are taken from the hunks as they are.
    h = raw.select(*k, "commit_id", "seq", "hunk_no", "new_start", "old_count", "new_count", "rep_all", "rep", "ov", "_d", "_base_len")
    if engine == "sql":  # the kernel takes the lengths from the file's last one on its way back
        h = keyed_scan(h, k, ["seq", "hunk_no"], running_sum=("_d", "pre")).withColumn("pre", F.col("pre") + F.col("_base_len"))
    return _fold(h, raw, k, base, with_text, lines, engine, sizes)


def _prepare(hunks: DataFrame, threshold, inherit_overflow) -> DataFrame:
    h = _hunk_order(hunks)
    if threshold is not None:
        h = mark_replaced(h, threshold).withColumnRenamed("replaced", "rep").withColumn("rep_all", F.lit(False))
    elif "replaced" in h.columns:
        # explicit replaced sets: 0-based indices of added lines
        h = h.withColumn("rep", F.col("replaced").cast("array<int>")).withColumn("rep_all", F.lit(False))
    else:
        h = h.withColumn("rep", F.lit(None).cast("array<int>")).withColumn(
            "rep_all", F.col("old_count") > 0)
    return (h.withColumn("_d", (F.col("new_count") - F.col("old_count")).cast("bigint"))
            .withColumn("ov", F.lit(bool(inherit_overflow))))


def _files(h: DataFrame, k: list[str], sizes: DataFrame | None) -> DataFrame:
    """``k, _bl, _n, _top``: of each file the lines of a block (LINE_BLOCK at least, and about 4 for each hunk, so that the hunks each
    block reads stay few per line), its length and the number of its last block."""
    if sizes is None:
        sizes = h.groupBy(*k).agg(F.count(F.lit(1)).alias("n_hunks"), (F.max("_base_len") + F.sum("_d")).alias("n_lines"))
    files = sizes.where("n_lines >= 1").select(
        *k, F.least(F.lit(MAX_LINE_BLOCK), F.greatest(F.lit(LINE_BLOCK), F.col("n_hunks") * LINES_PER_HUNK)).cast("bigint").alias("_bl"),
        F.col("n_lines").cast("bigint").alias("_n"))
    return files.withColumn("_top", F.expr("(_n - 1) div _bl"))


def _blocks(files: DataFrame, k: list[str], lines: DataFrame | None) -> DataFrame:
    """``k, _blk, _first, _last, _want, _n``: the final lines of each file in blocks."""
    none, zero = F.lit(None).cast("array<bigint>"), F.lit(0).cast("bigint")
    every = files.withColumn("_blk", F.explode(F.sequence(zero, "_top")))
    if lines is None:
        return every.select(*k, "_blk", (F.col("_blk") * F.col("_bl") + 1).alias("_first"),
                            F.least((F.col("_blk") + 1) * F.col("_bl"), F.col("_n")).alias("_last"), none.alias("_want"), "_n")
    want = lines.select(*k, F.col("line_no").cast("bigint").alias("line_no")).join(files, k) \
        .where("line_no between 1 and _n").withColumn("_blk", F.expr("(line_no - 1) div _bl"))
    return want.groupBy(*k, "_blk").agg(F.sort_array(F.collect_set("line_no")).alias("_want"), F.max("_n").alias("_n")) \
        .select(*k, "_blk", zero.alias("_first"), zero.alias("_last"), "_want", "_n")


def _traced(h: DataFrame, k: list[str], files: DataFrame, lines: DataFrame | None) -> DataFrame:
    """The kernel's rows: each block, and after it the hunks of its file, newest first.  Hunks are dealt to all blocks of
    their file; a block of which no line is wanted begins with a row that says so."""
    hunk = {"seq": "seq", "hunk_no": "hunk_no", "s": "cast(new_start as bigint)", "o": "cast(old_count as bigint)",
            "n": "cast(new_count as bigint)", "c": "commit_id", "rep_all": "rep_all", "rep": "rep", "ov": "ov"}
    types = dict(h.selectExpr(*(f"{e} as {c}" for c, e in hunk.items())).dtypes)
    own = {"_first": "bigint", "_last": "bigint", "_want": "array<bigint>", "_n": "bigint"}
    zero, nothing = F.lit(0).cast("bigint"), [F.lit(None).cast(types[c]).alias(c) for c in hunk]
    blk = F.explode(F.sequence(zero, "_top")).alias("_blk")
    steps = h.selectExpr(*k, *(f"{e} as {c}" for c, e in hunk.items())).join(files.select(*k, "_top"), k) \
        .select(*k, blk, F.lit(2).alias("_kind"), *(F.lit(None).cast(t).alias(c) for c, t in own.items()), *hunk)
    heads = _blocks(files, k, lines).select(*k, "_blk", F.lit(1).alias("_kind"), *own, *nothing)
    if lines is not None:
        idle = files.select(*k, blk, F.lit(0).alias("_kind"), *(F.lit(None).cast(t).alias(c) for c, t in own.items()), *nothing)
        heads = idle.union(heads)
    rows = heads.union(steps).repartition(_shuffle_partitions(h), *k, "_blk") \
        .sortWithinPartitions(*k, "_blk", "_kind", F.desc("seq"), F.desc("hunk_no"))
    out = ", ".join(f"{c} string" for c in k)
    return rows.drop("seq").mapInArrow(
        trace_kernel(k), f"{out}, line_no bigint, q bigint, alive boolean, commit_ids array<{types['c']}>, "
                         f"_hc {types['c']}, _hn {types['hunk_no']}, _hk int")


def _aggregated(h: DataFrame, k: list[str], blocks: DataFrame) -> DataFrame:
    """The SQL engine: one ``aggregate`` per line over all hunks of its file."""
    hs = h.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct(
        F.col("seq"), F.col("hunk_no"), F.col("new_start").cast("bigint").alias("s"), F.col("old_count").cast("bigint").alias("o"),
        F.col("new_count").cast("bigint").alias("n"), F.col("pre"), F.col("commit_id").alias("c"),
        F.col("rep_all"), F.col("rep"), F.col("ov"))), asc=False).alias("hs"))
    types = dict(h.dtypes)
    todo = blocks.join(hs, k).repartition(_shuffle_partitions(h), *k, "_blk") \
        .select(*k, "hs", F.explode(F.coalesce("_want", F.sequence("_first", "_last"))).alias("line_no"))
    init = F.struct(F.col("line_no").alias("q"), F.lit(True).alias("alive"), F.array().cast(f"array<{types['commit_id']}>").alias("commits"),
                    F.lit(None).cast(types["commit_id"]).alias("hc"), F.lit(None).cast(types["hunk_no"]).alias("hn"),
                    F.lit(None).cast("int").alias("hk"))
    return todo.select(*k, "line_no", F.aggregate("hs", init, _fold_step).alias("r")) \
        .select(*k, "line_no", "r.q", "r.alive", F.col("r.commits").alias("commit_ids"),
                F.col("r.hc").alias("_hc"), F.col("r.hn").alias("_hn"), F.col("r.hk").alias("_hk"))


def _fold(h: DataFrame, raw: DataFrame, k: list[str], base: DataFrame | None, with_text: bool, lines: DataFrame | None,
          engine: str, sizes: DataFrame | None = None) -> DataFrame:
    """Trace the final lines of each file back through the hunks of ``h``, continuing ``base`` when given.  ``raw``: the hunks with their texts."""
    files = _files(raw, k, sizes)
    res = _traced(h, k, files, lines) if engine == "arrow" else _aggregated(h, k, _blocks(files, k, lines))
    if base is not None:
        b = base.select(*k, F.col("line_no").alias("q"), F.col("commit_ids").alias("_bc"), F.col("content").alias("_btext"))
        res = res.join(b, [*k, "q"], "left") \
            .withColumn("commit_ids", F.when(F.col("alive") & F.col("_bc").isNotNull(), F.concat(F.col("_bc"), F.col("commit_ids")))
                        .otherwise(F.col("commit_ids")))
    if with_text and "added" in raw.columns:
        # one row per added line, joined on (file, commit, hunk, k): linear in
        # the text, where joining whole arrays would copy a hunk per line
        txt = raw.select(*k, F.col("commit_id").alias("_hc"), F.col("hunk_no").alias("_hn"),
                       F.posexplode("added").alias("_hk", "content"))
        res = res.join(txt, [*k, "_hc", "_hn", "_hk"], "left")
        if base is not None:
            res = res.withColumn("content", F.when(F.col("_hk").isNull(), F.col("_btext")).otherwise(F.col("content")))
        return res.select(*k, "line_no", "commit_ids", "content")
    return res.select(*k, "line_no", "commit_ids")


def explode_history(history: DataFrame) -> DataFrame:
    """Index rows with a commit list -> one row per (path, line_no, pos, commit_id)."""
    return history.select(*file_key(history), "line_no", F.posexplode("commit_ids").alias("pos", "commit_id"))


def collect_history(line_commits: DataFrame) -> DataFrame:
    """One row per (path, line_no, pos, commit_id) -> commit list per line, in pos order
    (commit order when there is no pos column)."""
    order = F.col("pos") if "pos" in line_commits.columns else F.col("commit_id")
    k = file_key(line_commits)
    return (line_commits.groupBy(*k, "line_no")
            .agg(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("commit_id").alias("c"))))
                 .alias("_l"))
            .select(*k, "line_no", F.col("_l.c").alias("commit_ids")))


def list_dictionary(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, lists)``: the index with ``list_id`` in the place of ``commit_ids``, and each distinct list once.

    Neighbouring lines mostly have the same commits, so rows shrink to an id, and look-ups count lists before
    they unfold them.  An id is the MD5 of the list's JSON text: the same list has the same id in every write, without a join.
    """
    r, key = repo_key(history), F.unhex(F.md5(F.to_json("commit_ids")))
    rows = history.withColumn("list_id", key)
    return rows.drop("commit_ids"), rows.select(*r, "list_id", "commit_ids").dropDuplicates([*r, "list_id"])


def with_lists(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The inverse: ``commit_ids`` in the place of ``list_id``."""
    return rows.join(lists, [*repo_key(lists), "list_id"]).drop("list_id")


def history_checks(history: DataFrame) -> DataFrame:
    """Per file, lines are exactly 1..n and each has at least one commit."""
    k = file_key(history)
    g = history.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("line_no").alias("n_distinct"),
        F.min("line_no").alias("min_line"), F.max("line_no").alias("max_line"),
        F.sum(F.when(F.coalesce(F.size("commit_ids"), F.lit(0)) <= 0, 1).otherwise(0))
        .alias("n_empty"))
    ok = ((F.col("n_rows") == F.col("n_distinct")) & (F.col("min_line") == 1)
          & (F.col("max_line") == F.col("n_rows")) & (F.col("n_empty") == 0))
    return g.select(*k, F.col("n_rows").cast("bigint").alias("n_lines"),
                    F.col("min_line").cast("bigint").alias("min_line"),
                    F.col("max_line").cast("bigint").alias("max_line"),
                    F.col("n_empty").cast("bigint").alias("n_empty"), ok.alias("ok"))


def blame_agreement(history: DataFrame, blame: DataFrame, short: bool = False) -> DataFrame:
    """Per file, non-blank blamed lines whose blamed commit is in the line's history.

    ``blame``: path, line_no, commit_id, [content]; blank lines are left out.
    ``short``: compare abbreviated hashes (a leading ``^`` stripped, 7
    characters), as blame prints them.
    """
    from ..functions.text import short_hash
    b, k = blame, file_key(blame)
    if "content" in b.columns:
        b = b.where(F.length(F.regexp_replace("content", r"\s", "")) > 0)
    j = b.select(*k, "line_no", F.col("commit_id").alias("_bc")).join(
        history.select(*k, "line_no", "commit_ids"), [*k, "line_no"], "left")
    if short:
        agree = F.coalesce(F.exists("commit_ids", lambda c: short_hash(c.cast("string"))
                                    == short_hash(F.col("_bc").cast("string"))), F.lit(False))
    else:
        agree = F.coalesce(F.array_contains("commit_ids", F.col("_bc")), F.lit(False))
    return j.groupBy(*k).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_lines"),
        F.sum(F.when(agree, 1).otherwise(0)).cast("bigint").alias("n_agree"),
        F.sum(F.when(agree, 0).otherwise(1)).cast("bigint").alias("n_fail"))


def drop_merge_diffs(diff_lines: DataFrame, key=None) -> DataFrame:
    """Cut a diff at its first combined-diff header ``@@@``."""
    key = key or [*file_key(diff_lines), "commit_id"]
    comb = F.ltrim(F.col("line")).startswith("@@@").cast("bigint")
    d = keyed_scan(diff_lines.withColumn("_c", comb), list(key), ["pos"], running_sum=("_c", "_cb"))
    return d.where(F.col("_cb") + F.col("_c") == 0).drop("_c", "_cb")


def only_commits(hunks: DataFrame, commit_list: DataFrame) -> DataFrame:
    """Restrict history to a list of commits, ordered as in that list.

    ``commit_list``: (commit_id, ord) or (path, commit_id, ord); ``ord`` is
    any orderable key (a position, a time) and becomes ``seq``.
    """
    keys = [c for c in ("repo", "path", "commit_id") if c in commit_list.columns]
    cl = commit_list.select(*keys, F.col("ord").alias("_ord"))
    return hunks.drop("seq").join(cl, keys).withColumnRenamed("_ord", "seq")


def commits_after(commits: DataFrame, watermarks: DataFrame) -> DataFrame:
    """Per path, commits newer than the path's watermark (all without one).

    ``commits``: path, commit_id, commit_ts (or seq); ``watermarks``: the
    last-indexed (path, commit_id) per path.  The watermark commit's place
    in the order is looked up among the path's commits.
    """
    order = "commit_ts" if "commit_ts" in commits.columns else "seq"
    k = file_key(commits)
    wm = watermarks.select(*k, "commit_id")
    pos = (commits.select(*k, "commit_id", order).join(wm, [*k, "commit_id"])
           .select(*k, F.struct(F.col(order), F.col("commit_id")).alias("_wm")))
    j = commits.join(pos, k, "left")
    return (j.where(F.col("_wm").isNull() | (F.struct(F.col(order), F.col("commit_id")) > F.col("_wm")))
            .drop("_wm"))


def ordered_history(history: DataFrame) -> DataFrame:
    """Rows in file and line order, within partitions and from one to the next.  A long
    file may reach over several partitions, so none is gathered in one task."""
    n, k = _shuffle_partitions(history), file_key(history)
    return history.repartitionByRange(n, *k, "line_no").sortWithinPartitions(*k, "line_no")


def merge_commit_lists(a: DataFrame, b: DataFrame, key: str | None = None) -> DataFrame:
    """Per key, list a followed by the commits only in b (distinct union, a's order first).

    ``a`` and ``b``: (key, commit_id, ord).  ``key``: the file by default.  Returns (key, commit_id, ord)
    with a fresh 0-based ``ord``.
    """
    k = file_key(a) if key is None else [key]
    u = (a.select(*k, "commit_id", F.lit(0).alias("_src"), F.col("ord").alias("_o"))
         .unionByName(b.select(*k, "commit_id", F.lit(1).alias("_src"), F.col("ord").alias("_o"))))
    first = u.groupBy(*k, "commit_id").agg(F.min(F.struct("_src", "_o")).alias("_f"))
    first = first.select(*k, "commit_id", F.col("_f._src").alias("_s"), F.col("_f._o").alias("_fo"))
    out = keyed_scan(first, k, ["_s", "_fo", "commit_id"], number="_n")
    return out.select(*k, "commit_id", (F.col("_n") - 1).cast("bigint").alias("ord"))


def history_text(history: DataFrame) -> DataFrame:
    """Commit lists as comma separated text (display, oracle checks)."""
    return history.withColumn("commits", join_ids("commit_ids")).drop("commit_ids")
