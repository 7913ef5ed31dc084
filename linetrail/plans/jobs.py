"""End-to-end jobs: build and maintain the line index, answer requests.

Every job is a DataFrame plan; the only driver-side values are the small
parameters (folders, k, bucket ids).  What is published is decided by the watermark log alone, which is
written last: a job that dies half-way and runs again gives the same answer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import file_key
from ..operators import context as ctx
from ..operators import lineage as lin
from ..operators import status as st
from ..operators import workspace as ws
from ..session import scratch_table_path
from ..sources import store


#: Is told in a dictionary how far a job is.
Progress = Callable[[dict], None]


def file_state(watermarks: DataFrame) -> DataFrame:
    """``k, _wm_seq, _wm_len``: up to where each file is indexed and its length there.  Files whose
    last entry lacks either are left out, so they are indexed anew."""
    last = st.last_indexed(watermarks)
    return last.where("indexed_seq is not null and n_lines is not null") \
        .select(*file_key(last), F.col("indexed_seq").alias("_wm_seq"), F.col("n_lines").alias("_wm_len"))


def continue_index(index: DataFrame | None, todo: DataFrame, with_text: bool = True, engine: str = "arrow") -> tuple[DataFrame, DataFrame]:
    """``(rows, watermarks)`` of the files of ``todo``: hunks with ``_wm_len``, the length that the
    file's rows in ``index`` have, or null where the file starts from nothing.

    What the new hunks come to (one row for each file) is written once: lengths, block sizes and watermarks all follow from it."""
    k, spark = file_key(todo), todo.sparkSession
    now = todo.groupBy(*k).agg(*_latest(F.coalesce(F.first("_wm_len"), F.lit(0))), F.first("_wm_len").alias("_wm_len"), F.count(F.lit(1)).alias("n_hunks")) \
        .withColumn("indexed_ts", F.localtimestamp().cast("timestamp_ntz"))
    path = scratch_table_path(spark, f"new-lengths-{uuid.uuid4().hex}")
    now.write.parquet(path)
    now = spark.read.schema(now.schema).parquet(path)
    known = now.where("_wm_len is not null").select(*k, F.col("_wm_len").alias("n_lines"))
    base = None if index is None else index.join(known.select(*k), k, "left_semi")
    hist = lin.line_history(todo.drop("_wm_len"), base=base, base_lengths=known, with_text=with_text, engine=engine, sizes=now)
    return hist, now.drop("_wm_len", "n_hunks")


def new_watermarks(hunks: DataFrame, now: Column | None = None) -> DataFrame:
    """Per file of ``hunks``: latest commit, its place in the order and the file's length then.  ``now``: the time of
    indexing, for information; it decides nothing."""
    before = F.coalesce(F.first("_wm_len"), F.lit(0)) if "_wm_len" in hunks.columns else F.lit(0)
    return hunks.groupBy(*file_key(hunks)).agg(*_latest(before)) \
        .withColumn("indexed_ts", (F.localtimestamp() if now is None else now).cast("timestamp_ntz"))


def _latest(before: Column) -> list[Column]:
    return [F.max_by("commit_id", F.struct(F.col("seq"), F.col("commit_id"))).alias("commit_id"), F.max("seq").cast("bigint").alias("seq"),
            (before + F.sum(F.col("new_count") - F.col("old_count"))).cast("bigint").alias("n_lines")]


def update_index(index: DataFrame | None, hunks: DataFrame, watermarks: DataFrame,
                 with_text: bool = True, engine: str = "arrow") -> tuple[DataFrame, DataFrame]:
    """O55 (batch): bring files up to date from their new hunks only.

    A file whose watermark has ``seq`` and ``n_lines`` continues its old history (one fold over the
    hunks after ``seq``, one equi-join to the old lines).  Any other file is rebuilt from all its
    hunks.  Files with nothing new produce no rows.

    Returns (index rows of the updated files, their new watermarks); the
    watermarks hold one row per updated file, so they also name the files
    whose old rows the new ones replace, emptied files included.
    """
    k = file_key(hunks)
    state = file_state(watermarks) if index is not None else file_state(watermarks).where(F.lit(False))
    todo = hunks.join(state, k, "left").where(F.col("_wm_seq").isNull() | (F.col("seq") > F.col("_wm_seq"))).drop("_wm_seq")
    return continue_index(index, todo, with_text, engine)


def _observed(seen: Observation, *names: str) -> dict[str, int]:
    """What a finished write observed; zeros where Spark found its plan empty and took the observing node out with it."""
    try:
        got = dict(seen.get)
    except Py4JJavaError:
        got = {}
    return {n: got.get(n) or 0 for n in names}


def publish(spark: SparkSession, rows: DataFrame, watermarks: DataFrame, index_dir: str, wm_dir: str, n_buckets: int,
            generation: int | None = None, progress: Progress | None = None, **told) -> DataFrame:
    """Write the rows as one generation, then the watermarks that name it; the rows as written.

    ``progress`` gets ``told``, the generation, and what both writes observed on their way: files, their lines by the log, and lines written.
    """
    lines, files = Observation(), Observation()
    if progress is not None:
        rows = rows.observe(lines, F.count(F.lit(1)).alias("lines_written"))
        watermarks = watermarks.observe(files, F.count(F.lit(1)).alias("files"), F.sum("n_lines").alias("lines"))
    gen = store.write_line_index(rows, index_dir, n_buckets, generation)
    store.append_watermarks(watermarks.withColumns({"generation": F.lit(gen).cast("bigint"), "n_buckets": F.lit(n_buckets).cast("bigint")}), wm_dir)
    if progress is not None:
        progress({**told, "generation": gen, **_observed(files, "files", "lines"), **_observed(lines, "lines_written")})
    return store.read_generation(spark, index_dir, gen, rows)


def build_index(spark: SparkSession, files: DataFrame, hunks: DataFrame, index_dir: str,
                wm_dir: str, rules: DataFrame | None = None, subfolders: str | None = None,
                n_buckets: int = store.DEFAULT_BUCKETS, now: Column | None = None, waves: int = 1,
                progress: Progress | None = None) -> DataFrame:
    """Index every stale or never-indexed file of the workspace.

    files -> subfolder and ignore filters -> status (fresh files skipped)
    -> incremental or full line history -> index generation, then watermarks.
    Returns the per-file checks of what was written.

    ``waves``: the files are built in that many parts, each published when it is done, so a long build can be
    followed, and goes on after a crash with the files that are left.  ``progress`` (O42 while a build runs) is called with the number of files
    of each status once they are known, and after each wave with the files and lines that it published: numbers that the jobs themselves
    observe, without another pass.  A task that runs again after an executor was lost may be counted twice; the log is the truth.
    """
    k = file_key(hunks)
    f = ws.filter_subfolders(files, subfolders or "")
    if rules is not None:
        f = ws.apply_ignore_rules(f, rules)
    wm = store.read_watermarks(spark, wm_dir, dict(hunks.dtypes)["commit_id"], "repo" in k)
    latest = st.latest_commit(hunks.select(*k, "commit_id", "seq"), order="seq")
    status = st.index_status(f, latest, st.last_indexed(wm)).select(*k, "status")
    seen = Observation()
    if progress is not None:
        status = status.observe(seen, *(F.count_if(F.col("status") == x).alias(x) for x in st.STATUSES))
    path = scratch_table_path(spark, f"todo-{uuid.uuid4().hex}")
    status.withColumn("_wave", F.pmod(F.xxhash64(*k), F.lit(int(waves)))).write.parquet(path)
    if progress is not None:
        progress({"status": _observed(seen, *st.STATUSES)})
    todo = spark.read.parquet(path).where(F.col("status").isin(st.STALE, st.NEVER))
    done = []
    for wave in range(int(waves)):
        part = todo.where(F.col("_wave") == wave).select(*k)
        old = store.read_published(spark, index_dir, wm, part)
        rows, new_wm = update_index(old, hunks.join(part, k, "left_semi"), wm)
        if now is not None:
            new_wm = new_wm.withColumn("indexed_ts", now.cast("timestamp_ntz"))
        done.append(publish(spark, rows, new_wm, index_dir, wm_dir, n_buckets, progress=progress, wave=wave, waves=int(waves)))
    written = done[0]
    for x in done[1:]:
        written = written.unionByName(x)
    return lin.history_checks(written)


def reindex_files(spark: SparkSession, paths: DataFrame, hunks: DataFrame, index_dir: str,
                  wm_dir: str, n_buckets: int = store.DEFAULT_BUCKETS) -> DataFrame:
    """Rebuild the given files from their whole history; others untouched.  A given file that has no
    history any more is published as gone."""
    k = file_key(hunks)
    paths = paths.select(*k).distinct()
    h = hunks.join(paths, k, "left_semi")
    wm = paths.join(new_watermarks(h), k, "left").withColumns({
        "n_lines": F.coalesce("n_lines", F.lit(0).cast("bigint")),
        "indexed_ts": F.coalesce("indexed_ts", F.localtimestamp().cast("timestamp_ntz"))})
    return lin.history_checks(publish(spark, lin.line_history(h), wm, index_dir, wm_dir, n_buckets))


def _requested_state(requests: DataFrame, index: DataFrame | None, hunks: DataFrame | None, watermarks: DataFrame | None,
                     counts: DataFrame | None) -> DataFrame:
    """One row for each requested file: ``_wm_seq`` and ``_wm_len`` (what its index holds), the place of its rows, ``_newer`` (the number of
    hunks after that), ``_len`` (its length now) and ``n_lines`` (the same, or what ``counts`` says).  As large as the requests; written once,
    since all that follows reads it, and small enough for the planner to broadcast or not, as it finds its size.

    What is known of a file comes together in one grouping: requests, log (or the index's line numbers) and hunks are
    brought to one row for each file by every task before they meet.
    """
    k = file_key(requests)
    none = {"_asked": "boolean", "_log": "struct<generation:bigint,ts:timestamp_ntz,seq:bigint,n_lines:bigint,n_buckets:bigint>",
            "_last": "bigint", "_d": "bigint", "_true": "bigint"}

    def part(df, **known):
        return df.select(*k, *(known.get(c, F.lit(None)).cast(t).alias(c) for c, t in none.items()))
    parts = [part(requests, _asked=F.lit(True))]
    if watermarks is not None:
        parts.append(part(watermarks, _log=F.struct(*(F.col(c) if c in watermarks.columns else F.lit(None)
                                                      for c in ("generation", "indexed_ts", "seq", "n_lines", "n_buckets")))))
    elif index is not None:
        parts.append(part(index, _last=F.col("line_no")))
    if hunks is not None and watermarks is None:
        parts.append(part(hunks, _d=F.col("new_count") - F.col("old_count")))
    if counts is not None:
        parts.append(part(counts, _true=F.col("n_lines")))
    u = parts[0]
    for x in parts[1:]:
        u = u.union(x)
    state = u.groupBy(*k).agg(F.max("_asked").alias("_asked"), F.max("_log").alias("_log"), F.max("_last").alias("_last"),
                              F.sum("_d").alias("_grown"), F.count("_d").alias("_newer"), F.max("_true").alias("_true")).where("_asked")
    if watermarks is not None:
        known = F.col("_log.seq").isNotNull() & F.col("_log.n_lines").isNotNull()  # other entries are as none
        state = state.withColumns({"_wm_seq": F.when(known, F.col("_log.seq")), "_wm_len": F.when(known, F.col("_log.n_lines"))})
        if hunks is not None:
            newer = hunks.join(state.select(*k, "_wm_seq"), k).where("_wm_seq is null or seq > _wm_seq")
            grown = newer.groupBy(*k).agg(F.sum(F.col("new_count") - F.col("old_count")).alias("_grown"), F.count(F.lit(1)).alias("_newer"))
            state = state.drop("_grown", "_newer").join(grown, k, "left")
    else:  # without a log, a file that has an index is taken to be up to date
        old = F.col("_last").isNotNull()
        state = state.withColumns({"_wm_seq": F.when(old, F.lit((1 << 63) - 1)), "_wm_len": F.col("_last"),
                                   "_grown": F.when(~old, F.col("_grown")), "_newer": F.when(~old, F.col("_newer"))})
    newer = F.coalesce("_newer", F.lit(0).cast("bigint"))
    length = F.when(newer > 0, F.coalesce("_wm_len", F.lit(0)) + F.col("_grown")).otherwise(F.col("_wm_len")).cast("bigint")
    state = state.select(*k, "_wm_seq", "_wm_len", newer.alias("_newer"), length.alias("_len"), F.coalesce("_true", length).alias("n_lines"),
                         F.col("_log.generation").alias("generation"), F.col("_log.n_buckets").alias("n_buckets"),
                         store.bucket_of(k, F.col("_log.n_buckets")).alias("bucket"))
    spark = requests.sparkSession
    path = scratch_table_path(spark, f"requested-{uuid.uuid4().hex}")
    state.write.parquet(path)
    return spark.read.schema(state.schema).parquet(path)


def _hits(requests: DataFrame, index: DataFrame | str | None, hunks: DataFrame | None, watermarks: DataFrame | None,
          counts: DataFrame | None, lookup: str) -> DataFrame:
    """Hits of all requests, from the requested files' rows alone.

    Files with hunks that their index does not hold yet (all hunks, without an index) are brought up to date in the
    plan: the requested lines are traced through those hunks on top of the index.  Others are looked up in it.  Both kinds of rows
    meet the requested lines in one join.
    """
    k, spark = file_key(requests), requests.sparkSession
    stored = isinstance(index, str)
    if stored and watermarks is None:
        index, stored = store.read_published(spark, index, None, requests), False
    state = _requested_state(requests, None if stored else index, hunks, watermarks, counts)
    if stored:
        index = store.read_places(spark, index, state)
    lines = ctx.expand_ranges(requests.join(state.select(*k, (F.col("_newer") > 0).alias("_stale")), k), state, clamp=True) \
        .select("req_id", *k, "line_no", "_stale")
    rows = []
    if index is not None:
        fresh = index.join(state.where("_newer = 0").select(*k), k, "left_semi")
        if lookup == "forward":
            near = ctx.nearest_forward(lines.where("not _stale"), fresh, all_asked=True)
            lines = lines.where("_stale").withColumn("key_line", F.col("line_no").cast("bigint")).unionByName(near)
        rows.append(ctx.as_line_commits(fresh))
    if "key_line" not in lines.columns:
        lines = lines.withColumn("key_line", F.col("line_no").cast("bigint"))
    if hunks is not None:
        stale = state.where("_newer > 0")
        newer = hunks.join(stale.select(*k, "_wm_seq"), k).where("_wm_seq is null or seq > _wm_seq").drop("_wm_seq")
        base = lengths = None
        if watermarks is not None and index is not None:  # else only files without an index are traced
            base = index.join(stale.select(*k), k, "left_semi")
            base = base if "commit_ids" in base.columns else lin.collect_history(base)
            lengths = stale.where("_wm_len is not null").select(*k, F.col("_wm_len").alias("n_lines"))
        sizes = stale.select(*k, F.col("_newer").alias("n_hunks"), F.col("_len").alias("n_lines"))
        hist = lin.line_history(newer, base=base, base_lengths=lengths, lines=lines.where("_stale").select(*k, "line_no"), with_text=False, sizes=sizes)
        rows.append(ctx.as_line_commits(hist))
    if not rows:
        return lines.select("req_id", *k, "line_no", F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("commit_id")).where(F.lit(False))
    found = rows[0] if len(rows) == 1 else rows[0].withColumn("line_no", F.col("line_no").cast("bigint")).union(rows[1])
    return lines.join(found.withColumnRenamed("line_no", "key_line"), [*k, "key_line"]).select("req_id", *k, "line_no", "pos", "commit_id")


def query_context(requests: DataFrame, index: DataFrame | str | None, touches: DataFrame, k: int = 10,
                  hunks: DataFrame | None = None, lookup: str = "exact", watermarks: DataFrame | None = None,
                  counts: DataFrame | None = None) -> DataFrame:
    """Top-k related files per request.  ``index``: rows, or the folder of a stored index, of which only the requested
    files' part is opened.  Requests on files without an
    index are answered from their hunks on the fly; with ``watermarks`` so are files with hunks after theirs (exact
    lines).  ``counts``: true file lengths, else the last line that is known."""
    return ctx.top_related_files(ctx.related_files(_hits(requests, index, hunks, watermarks, counts, lookup), touches), k)


def query_descriptions(requests: DataFrame, index: DataFrame | str | None, commits: DataFrame,
                       hunks: DataFrame | None = None, remote: str | None = None, watermarks: DataFrame | None = None,
                       counts: DataFrame | None = None) -> DataFrame:
    """The commits of each request described; indexed files use the
    nearest-forward lookup, files without a fresh index their exact lines.  ``index`` as in ``query_context``."""
    return ctx.describe_commits(_hits(requests, index, hunks, watermarks, counts, "forward"), commits, remote)
