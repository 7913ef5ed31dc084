"""Driver queries: one per operator, each over the fixture views of a scale
factor, with an equivalent DuckDB SQL text as its oracle.

Every query reads the whole driver tables through the views of
``fixtures``.  Array results are returned
as comma separated text so both engines compare them as plain values.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import text as tx
from .functions.text import join_ids
from .operators import context as ctx
from .operators import lineage as lin
from .operators import status as stt
from .operators import workspace as wsp
from .plans import jobs
from .session import checkpoint_dir
from .sources import claims
from .sources import history as src
from .sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = fx.with_views(oracle, *views)
        return fn
    return deco


def hunks_with_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_hunks with the text of its added and removed lines (``e<c>:<k>``, ``d<c>:<k>``)."""
    h = fx.view(spark, sf_dir, "fx_hunks")

    def lines(prefix, count):
        return F.transform(F.array_repeat(F.lit(0), F.col(count).cast("int")),
                           lambda _x, i: F.concat(F.lit(prefix), F.col("commit_id").cast("string"),
                                                  F.lit(":"), i.cast("string")))
    return h.withColumn("hunk_no", F.lit(1)).withColumn("deleted", lines("d", "old_count")) \
        .withColumn("added", lines("e", "new_count"))


# --------------------------------------------------------------------------
# Shared oracle pieces (DuckDB)
# --------------------------------------------------------------------------

_ORACLE_LINES = """
counts as (select path, max(line_no) as n_lines from fx_line_commits group by path),
lines as (
  select req_id, path, cast(unnest(generate_series(cast(start_line as bigint), e)) as bigint) as line_no
  from (select r.req_id, r.path, r.start_line,
               cast(case when r.end_line = 0 then c.n_lines else r.end_line end as bigint) as e
        from fx_requests r left join counts c on r.path = c.path) x
  where start_line <= e)
"""

_ORACLE_COVERS = """
keys as (select distinct path, cast(line_no as bigint) as k from fx_line_commits),
covers as (select path, k, coalesce(lag(k) over (partition by path order by k), -1) + 1 as lo from keys),
fwd as (select l.req_id, l.path, l.line_no, c.k as key_line
        from lines l join covers c on l.path = c.path and l.line_no between c.lo and c.k),
fwd_hits as (select f.req_id, f.path, f.line_no, f.key_line, lc.commit_id
             from fwd f join fx_line_commits lc on f.path = lc.path and f.key_line = lc.line_no)
"""


def _requests_index(spark, sf_dir):
    req, idx = fx.views(spark, sf_dir, "fx_requests", "fx_line_commits")
    lines = ctx.expand_ranges(req, ctx.line_counts_from_index(idx))
    return req, idx, lines


# --------------------------------------------------------------------------
# Range requests
# --------------------------------------------------------------------------

@query("related_files_topk", oracle=f"""
with {_ORACLE_LINES},
hits as (select l.req_id, lc.commit_id from lines l
         join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no),
mult as (select req_id, commit_id, count(*) as m from hits group by req_id, commit_id),
rel as (select req_id, t.path as related_path, cast(sum(m) as bigint) as occurrences
        from mult join fx_touches t on mult.commit_id = t.commit_id group by req_id, t.path)
select * from (select *, cast(row_number() over (partition by req_id order by occurrences desc, related_path) as bigint) as rank
               from rel) x where rank <= 10
""", views=("fx_requests", "fx_line_commits", "fx_touches"))
def q_related_files_topk(spark, sf_dir):
    """The headline slice: requests -> lines -> commits -> changed files -> top 10."""
    _, idx, lines = _requests_index(spark, sf_dir)
    touches = fx.view(spark, sf_dir, "fx_touches")
    hits = ctx.lines_to_commits(lines, idx)
    return ctx.top_related_files(ctx.related_files(hits, touches), k=10)


@query("expand_ranges", oracle=f"with {_ORACLE_LINES} select req_id, path, line_no from lines",
       views=("fx_requests", "fx_line_commits"))
def q_expand_ranges(spark, sf_dir):
    _, _, lines = _requests_index(spark, sf_dir)
    return lines.select("req_id", "path", "line_no")


@query("lines_in_range", oracle=f"""
with {_ORACLE_LINES}
select l.req_id, l.path, l.line_no, lc.commit_id from lines l
join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no
""", views=("fx_requests", "fx_line_commits"))
def q_lines_in_range(spark, sf_dir):
    req, idx = fx.views(spark, sf_dir, "fx_requests", "fx_line_commits")
    r = ctx.lines_in_range(idx, req, ctx.line_counts_from_index(idx))
    return r.select("req_id", "path", "line_no", "commit_id")


@query("lines_to_commits", oracle=f"""
with {_ORACLE_LINES}
select l.req_id, l.path, l.line_no, lc.commit_id from lines l
join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no
""", views=("fx_requests", "fx_line_commits"))
def q_lines_to_commits(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    return ctx.lines_to_commits(lines, idx).select("req_id", "path", "line_no", "commit_id")


@query("nearest_forward", oracle=f"""
with {_ORACLE_LINES}, {_ORACLE_COVERS}
select req_id, path, line_no, key_line from fwd
""", views=("fx_requests", "fx_line_commits"))
def q_nearest_forward(spark, sf_dir):
    req, idx, lines = _requests_index(spark, sf_dir)
    return ctx.nearest_forward(lines, idx, requests=req).select("req_id", "path", "line_no", "key_line")


@query("uncovered_exact", oracle=f"""
with {_ORACLE_LINES}
select req_id, path, line_no from lines l
where not exists (select 1 from fx_line_commits lc where lc.path = l.path and lc.line_no = l.line_no)
""", views=("fx_requests", "fx_line_commits"))
def q_uncovered_exact(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    return ctx.uncovered_lines(lines, idx, "exact").select("req_id", "path", "line_no")


@query("uncovered_forward", oracle=f"""
with {_ORACLE_LINES}
select req_id, path, line_no from lines l
where line_no > coalesce((select max(line_no) from fx_line_commits lc where lc.path = l.path), -1)
""", views=("fx_requests", "fx_line_commits"))
def q_uncovered_forward(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    return ctx.uncovered_lines(lines, idx, "forward").select("req_id", "path", "line_no")


@query("related_files_forward", oracle=f"""
with {_ORACLE_LINES}, {_ORACLE_COVERS},
mult as (select req_id, commit_id, count(*) as m from fwd_hits group by req_id, commit_id)
select req_id, t.path as related_path, cast(sum(m) as bigint) as occurrences
from mult join fx_touches t on mult.commit_id = t.commit_id group by req_id, t.path
""", views=("fx_requests", "fx_line_commits", "fx_touches"))
def q_related_files_forward(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    touches = fx.view(spark, sf_dir, "fx_touches")
    return ctx.related_files(ctx.request_hits(lines, idx, "forward"), touches)


@query("commits_of_range", oracle=f"""
with {_ORACLE_LINES}, {_ORACLE_COVERS},
ranked as (select req_id, commit_id, line_no, 0 as pos,
                  row_number() over (partition by req_id, commit_id order by line_no) as rn
           from fwd_hits)
select req_id, commit_id, line_no as first_line_no, cast(pos as bigint) as first_pos from ranked where rn = 1
""", views=("fx_requests", "fx_line_commits"))
def q_commits_of_range(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    return ctx.commits_of_range(ctx.request_hits(lines, idx, "forward"))


@query("describe_commits", oracle=f"""
with {_ORACLE_LINES}, {_ORACLE_COVERS},
firsts as (select req_id, commit_id, min(line_no) as first_line_no from fwd_hits group by req_id, commit_id)
select f.req_id, f.commit_id, f.first_line_no, cast(0 as bigint) as first_pos,
       c.title, '' as body, c.author, c.commit_ts,
       'https://github.com/linetrail/history/commit/' || c.commit_hash as url
from firsts f join fx_commits c on f.commit_id = c.commit_id
""", views=("fx_requests", "fx_line_commits", "fx_commits"))
def q_describe_commits(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    commits = fx.view(spark, sf_dir, "fx_commits")
    return ctx.describe_commits(ctx.request_hits(lines, idx, "forward"), commits,
                               remote="git@github.com:linetrail/history.git")


@query("authors_of_range", oracle=f"""
with {_ORACLE_LINES},
hits as (select l.req_id, l.line_no, lc.commit_id from lines l
         join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no)
select h.req_id, c.author, cast(count(distinct h.line_no) as bigint) as n_lines,
       cast(count(distinct h.commit_id) as bigint) as n_commits, max(c.commit_ts) as last_ts
from hits h join fx_commits c on h.commit_id = c.commit_id group by h.req_id, c.author
""", views=("fx_requests", "fx_line_commits", "fx_commits"))
def q_authors_of_range(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    commits = fx.view(spark, sf_dir, "fx_commits")
    return ctx.authors_of_range(ctx.lines_to_commits(lines, idx), commits)


# --------------------------------------------------------------------------
# Line lineage
# --------------------------------------------------------------------------

_ORACLE_WALK_T = """
recursive h as (
  select path, commit_id, new_start as s, old_count as o, new_count as n,
         coalesce(sum(new_count - old_count) over (partition by path order by seq
                  rows between unbounded preceding and 1 preceding), 0) as pre,
         row_number() over (partition by path order by seq desc) as step
  from {src}),
lens as (select path, sum(n - o) as n_final from h group by path),
walk(path, line_no, step, q, alive, commits, hc, hk) as (
  select path, cast(unnest(generate_series(1, cast(n_final as bigint))) as bigint), cast(0 as bigint),
         cast(unnest(generate_series(1, cast(n_final as bigint))) as bigint), true,
         cast([] as bigint[]), cast(null as bigint), cast(null as bigint)
  from lens
  union all
  select w.path, w.line_no, w.step + 1,
         case when h.n = 0 and w.q > h.s then w.q + h.o
              when h.n > 0 and w.q >= h.s + h.n then w.q - (h.n - h.o) else w.q end,
         case when h.n > 0 and w.q >= h.s and w.q < h.s + h.n then h.o > 0 and w.q <= h.pre else true end,
         case when h.n > 0 and w.q >= h.s and w.q < h.s + h.n then list_prepend(h.commit_id, w.commits) else w.commits end,
         case when w.hc is null and h.n > 0 and w.q >= h.s and w.q < h.s + h.n then h.commit_id else w.hc end,
         case when w.hc is null and h.n > 0 and w.q >= h.s and w.q < h.s + h.n then w.q - h.s else w.hk end
  from walk w join h on h.path = w.path and h.step = w.step + 1
  where w.alive),
final as (select path, line_no, arg_max(commits, step) as commits, arg_max(hc, step) as hc,
                 arg_max(hk, step) as hk
          from walk group by path, line_no)
"""


def oracle_walk(src: str = "fx_hunks") -> str:
    """DuckDB recursive walk of the backward rule over the hunks of ``src``."""
    return _ORACLE_WALK_T.replace("{src}", src)


_ORACLE_WALK = oracle_walk()


@query("line_history", oracle=f"""
with {_ORACLE_WALK}
select path, line_no, array_to_string(commits, ',') as commits,
       'e' || cast(hc as varchar) || ':' || cast(hk as varchar) as content
from final
""", views=("fx_hunks",))
def q_line_history(spark, sf_dir):
    hist = lin.line_history(hunks_with_text(spark, sf_dir))
    return hist.select("path", "line_no", join_ids("commit_ids").alias("commits"), "content")


@query("history_checks", oracle=f"""
with {_ORACLE_WALK},
g as (select path, count(*) as n_rows, count(distinct line_no) as n_distinct, min(line_no) as min_line,
             max(line_no) as max_line, sum(case when len(commits) = 0 then 1 else 0 end) as n_empty
      from final group by path)
select path, cast(n_rows as bigint) as n_lines, cast(min_line as bigint) as min_line,
       cast(max_line as bigint) as max_line, cast(n_empty as bigint) as n_empty,
       (n_rows = n_distinct and min_line = 1 and max_line = n_rows and n_empty = 0) as ok
from g
""", views=("fx_hunks",))
def q_history_checks(spark, sf_dir):
    return lin.history_checks(lin.line_history(fx.view(spark, sf_dir, "fx_hunks"), with_text=False))


@query("pair_previous", oracle="""
select path, commit_id, seq, lag(commit_id) over (partition by path order by seq, commit_id) as prev_commit_id
from (select distinct path, commit_id, seq from fx_hunks) t
""", views=("fx_hunks",))
def q_pair_previous(spark, sf_dir):
    return lin.pair_previous(fx.view(spark, sf_dir, "fx_hunks"))


# --------------------------------------------------------------------------
# Sources (O1-O8, O19, O53)
# --------------------------------------------------------------------------


@query("read_commits", oracle="""
select t.commit_id, t.path, c.commit_ts,
       cast(row_number() over (partition by t.path order by c.commit_ts, t.commit_id) as bigint) as seq
from fx_touches t join fx_commits c on t.commit_id = c.commit_id
""", views=("fx_commits", "fx_touches"))
def q_read_commits(spark, sf_dir):
    commits, touches = fx.views(spark, sf_dir, "fx_commits", "fx_touches")
    return src.read_commits(commits, touches)


@query("parse_messages", oracle="""
with p as (select conv_id, turn, string_split(raw, chr(10) || '--AUTHOR--' || chr(10)) as a from fx_messages),
p2 as (select conv_id, turn, a[1] as msg, string_split(a[2], chr(10) || '--DATE--' || chr(10)) as b
       from p where len(a) = 2),
p3 as (select conv_id, turn, regexp_replace(msg, '^\\s+|\\s+$', '', 'g') as m, b from p2 where len(b) = 2)
select conv_id, turn,
       regexp_replace(split_part(m, chr(10), 1), '^\\s+|\\s+$', '', 'g') as title,
       case when strpos(m, chr(10)) > 0
            then regexp_replace(substr(m, strpos(m, chr(10)) + 1), '^\\s+|\\s+$', '', 'g') else '' end as body,
       regexp_replace(b[1], '^\\s+|\\s+$', '', 'g') as author,
       try_strptime(substr(regexp_replace(b[2], '^\\s+|\\s+$', '', 'g'), 5), '%b %d %H:%M:%S %Y') as commit_ts
from p3
""", views=("fx_messages",))
def q_parse_messages(spark, sf_dir):
    return src.parse_messages(fx.view(spark, sf_dir, "fx_messages"))


@query("explode_changed_files", oracle="select commit_id, path from fx_touches",
       views=("fx_touches",))
def q_explode_changed_files(spark, sf_dir):
    t = fx.view(spark, sf_dir, "fx_touches")
    raw = t.groupBy("commit_id").agg(F.array_join(F.sort_array(F.collect_list("path")), "\n").alias("raw"))
    # git prints a trailing newline; keep it so empty entries are exercised
    return src.explode_changed_files(raw.withColumn("raw", F.concat("raw", F.lit("\n"))))


@query("parse_diffs", oracle="""
select path, commit_id % 4 as commit_id, cast(row_number() over (partition by path, commit_id % 4 order by seq) as int) as hunk_no,
       new_start as old_start, old_count, new_start, new_count,
       array_to_string(list_transform(range(old_count), lambda k: 'd' || cast(commit_id as varchar) || ':' || cast(k as varchar)), chr(10)) as deleted,
       array_to_string(list_transform(range(new_count), lambda k: 'e' || cast(commit_id as varchar) || ':' || cast(k as varchar)), chr(10)) as added
from fx_hunks
""", views=("fx_hunks",))
def q_parse_diffs(spark, sf_dir):
    """Diffs of many hunks each (a file's hunks in four diffs), rendered as git prints them (with no-newline markers
    and a trailing combined-diff section on some) and parsed back."""
    h = src.render_diffs(hunks_with_text(spark, sf_dir))
    hunk = F.concat(F.regexp_extract("diff", r"(?s)(@@.*)$", 1), F.when(
        F.col("commit_id") % 5 == 0, F.lit("\n\\ No newline at end of file")).otherwise(F.lit("")))
    d = h.groupBy("path", (F.col("commit_id") % 4).alias("commit_id")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", hunk.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    pre = F.concat(F.lit("diff --git a/x b/x\n--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"))
    d = d.withColumn("diff", F.concat(pre, "t", F.when(F.col("commit_id") == 1, F.lit("\n@@@ -1,1 -1,1 +1,2 @@@\n+merged\n@@ -1 +1 @@\n+no"))
                                      .otherwise(F.lit("\n"))))
    p = src.parse_diffs(d.select("path", "commit_id", "diff"))
    return p.select("path", "commit_id", "hunk_no", "old_start", "old_count", "new_start",
                    "new_count", F.array_join("deleted", "\n").alias("deleted"),
                    F.array_join("added", "\n").alias("added"))


@query("version_pair_hunks", oracle="""
with v as (select path, version, lag(version) over (partition by path order by version) as prev_version, text
           from fx_snapshots),
l as (select v.path, v.version, v.prev_version,
             case when v.text = '' then [] else string_split(regexp_replace(v.text, '\\n$', ''), chr(10)) end as b,
             case when p.text is null or p.text = '' then []
                  else string_split(regexp_replace(p.text, '\\n$', ''), chr(10)) end as a
      from v left join fx_snapshots p on p.path = v.path and p.version = v.prev_version),
pp as (select *, len(a) as m, len(b) as n, least(len(a), len(b)) as mn from l),
pr as (select *, coalesce(list_position(list_transform(range(1, mn + 1), lambda i: a[i] = b[i]), false) - 1, mn) as p
       from pp),
sf as (select *, coalesce(list_position(list_transform(range(1, mn - p + 1), lambda i: a[m - i + 1] = b[n - i + 1]), false) - 1,
                          mn - p) as s from pr),
h as (select *, m - p - s as oc, n - p - s as nc from sf)
select path, version, prev_version,
       cast(case when oc = 0 then p else p + 1 end as bigint) as old_start, cast(oc as bigint) as old_count,
       cast(case when nc = 0 then p else p + 1 end as bigint) as new_start, cast(nc as bigint) as new_count,
       md5(array_to_string(a[p + 1 : p + oc], chr(10))) as deleted_md5,
       md5(array_to_string(b[p + 1 : p + nc], chr(10))) as added_md5
from h where oc > 0 or nc > 0
""", views=("fx_snapshots",))
def q_version_pair_hunks(spark, sf_dir):
    h = src.version_pair_hunks(fx.view(spark, sf_dir, "fx_snapshots"))
    return h.select("path", "version", "prev_version", "old_start", "old_count", "new_start", "new_count",
                    F.md5(F.array_join("deleted", "\n")).alias("deleted_md5"),
                    F.md5(F.array_join("added", "\n")).alias("added_md5"))


_BLAME_RENDER = """
select path, line_no, commit_id,
       concat(case when line_no % 2 = 0 then '^' else '' end, lpad(cast(commit_id as string), 8, '0'), ' ',
              case when line_no % 3 = 0 then concat(path, ' ') else '' end,
              '(Author ', cast(commit_id % 97 as string), ' Name 2024-02-', lpad(cast(1 + commit_id % 28 as string), 2, '0'),
              ' 10:', lpad(cast(line_no % 60 as string), 2, '0'), ':00 +0000 ', cast(line_no as string), ') ',
              'let x', cast(line_no as string), ' = 1;') as raw
from fx_blame
"""


@query("parse_blame", oracle="""
select path, substr(lpad(cast(commit_id as varchar), 8, '0'), 1, 7) as commit_hash,
       'Author ' || cast(commit_id % 97 as varchar) || ' Name' as author,
       cast(strptime('2024-02-' || lpad(cast(1 + commit_id % 28 as varchar), 2, '0') || ' 10:'
                     || lpad(cast(line_no % 60 as varchar), 2, '0') || ':00', '%Y-%m-%d %H:%M:%S') as timestamp) as blame_ts,
       '+0000' as tz, cast(line_no as bigint) as line_no, 'let x' || cast(line_no as varchar) || ' = 1;' as content
from fx_blame
""", views=("fx_blame",))
def q_parse_blame(spark, sf_dir):
    fx.register_tables(spark, sf_dir, fx.VIEW_TABLES["fx_blame"])
    spark.sql(fx.VIEWS["fx_blame"]).createOrReplaceTempView("fx_blame")
    raw = spark.sql(_BLAME_RENDER).select("path", "raw")
    return src.parse_blame(raw)


@query("index_json_round_trip", oracle="select path, cast(line_no as bigint) as line_no, commit_id from fx_line_commits",
       views=("fx_line_commits",))
def q_index_json_round_trip(spark, sf_dir):
    lc = fx.view(spark, sf_dir, "fx_line_commits")
    docs = src.export_index_json(lin.collect_history(lc), lines_per_doc=8)
    back = src.import_index_json(docs.select("path", "doc"))
    return back.select("path", "line_no", F.col("commit").cast("bigint").alias("commit_id"))


# --------------------------------------------------------------------------
# Workspace
# --------------------------------------------------------------------------


_RULE_COLUMNS = ["rule_no", "pattern", "negated", "dir_only"]
_ORACLE_RULES = """
rules as (select rule_no, not ignore as negated, dirs as dir_only, rx from fx_ignore_rules where live)
"""


@query("filter_subfolders", oracle="""
select path, n_lines from fx_files where path like 'src/small/%' or path like 'src/promo/%'
""", views=("fx_files",))
def q_filter_subfolders(spark, sf_dir):
    return wsp.filter_subfolders(fx.view(spark, sf_dir, "fx_files"), "src/small, src/promo/")


@query("list_files", oracle=f"""
with {_ORACLE_RULES},
items as (select path, path as x, false as is_dir from fx_files
          union all
          select path, array_to_string(string_split(path, '/')[1:i], '/') as x, true as is_dir
          from (select path, unnest(range(1, len(string_split(path, '/')))) as i from fx_files) t),
dec as (select i.path, i.x, arg_max(not r.negated, r.rule_no) as ign
        from items i join rules r on (not r.dir_only or i.is_dir) and regexp_full_match(i.x, r.rx)
        group by i.path, i.x, i.is_dir)
select f.path, f.n_lines from fx_files f
where not exists (select 1 from dec d where d.path = f.path and d.ign)
""", views=("fx_files", "fx_ignore_rules"))
def q_list_files(spark, sf_dir):
    files, rules = fx.views(spark, sf_dir, "fx_files", "fx_ignore_rules")
    return wsp.list_files(files, rules.select(*_RULE_COLUMNS))


@query("list_dirs", oracle=f"""
with {_ORACLE_RULES},
dirs as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as d
         from (select path, unnest(range(1, len(string_split(path, '/')))) as i from fx_files) t),
items as (select d, d as x from dirs
          union all
          select d, array_to_string(string_split(d, '/')[1:i], '/') as x
          from (select d, unnest(range(1, len(string_split(d, '/')))) as i from dirs) t),
dec as (select it.d, it.x, arg_max(not r.negated, r.rule_no) as ign
        from items it join rules r on regexp_full_match(it.x, r.rx) group by it.d, it.x)
select d as path from dirs where not exists (select 1 from dec where dec.d = dirs.d and dec.ign)
""", views=("fx_files", "fx_ignore_rules"))
def q_list_dirs(spark, sf_dir):
    files, rules = fx.views(spark, sf_dir, "fx_files", "fx_ignore_rules")
    return wsp.list_dirs(files, rules.select(*_RULE_COLUMNS))


# Two repositories with the same files; the second has some rules of its own, one of them without any literal text.
_REPO_RULES_SQL = """select 'a' as repo, rule_no, pattern, negated, dir_only, live, ignore, dirs, rx from fx_ignore_rules
 union all select 'b', rule_no, pattern, negated, dir_only, live, ignore, dirs, rx from fx_ignore_rules where rule_no in (1, 3, 4)
 union all select 'b', 20, '[n-z]*', false, false, true, true, false, '^(.*/)?[n-z][^/]*$'
 union all select 'b', 21, '!src', false, false, true, false, false, '^(.*/)?src$'
 union all select 'b', 22, '!p*1.rs', false, false, true, false, false, '^(.*/)?p[^/]*1[.]rs$'
 union all select 'b', 23, 'src/**/brand2?', false, true, true, true, true, '^src/(.*/)?brand2[^/]$'"""
_ORACLE_REPO_RULES = f"""
rr as ({_REPO_RULES_SQL}),
rules as (select repo, rule_no, not ignore as negated, dirs as dir_only, rx from rr where live),
repos as (select 'a' as repo union all select 'b'),
files as (select repo, path, n_lines from fx_files cross join repos)
"""


def _repo_files(spark, sf_dir):
    files, rules = fx.views(spark, sf_dir, "fx_files", "fx_ignore_rules")
    rules.createOrReplaceTempView("fx_ignore_rules")
    files = files.withColumn("repo", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return files, spark.sql(_REPO_RULES_SQL).select("repo", *_RULE_COLUMNS)


@query("list_files_repos", oracle=f"""
with {_ORACLE_REPO_RULES},
items as (select repo, path, path as x, false as is_dir from files
          union all
          select repo, path, array_to_string(string_split(path, '/')[1:i], '/') as x, true as is_dir
          from (select repo, path, unnest(range(1, len(string_split(path, '/')))) as i from files) t),
dec as (select i.repo, i.path, i.x, arg_max(not r.negated, r.rule_no) as ign
        from items i join rules r on r.repo = i.repo and (not r.dir_only or i.is_dir) and regexp_full_match(i.x, r.rx)
        group by i.repo, i.path, i.x, i.is_dir)
select f.repo, f.path, f.n_lines from files f
where not exists (select 1 from dec d where d.repo = f.repo and d.path = f.path and d.ign)
""", views=("fx_files", "fx_ignore_rules"))
def q_list_files_repos(spark, sf_dir):
    return wsp.list_files(*_repo_files(spark, sf_dir))


@query("list_dirs_repos", oracle=f"""
with {_ORACLE_REPO_RULES},
dirs as (select distinct repo, array_to_string(string_split(path, '/')[1:i], '/') as d
         from (select repo, path, unnest(range(1, len(string_split(path, '/')))) as i from files) t),
items as (select repo, d, d as x from dirs
          union all
          select repo, d, array_to_string(string_split(d, '/')[1:i], '/') as x
          from (select repo, d, unnest(range(1, len(string_split(d, '/')))) as i from dirs) t),
dec as (select it.repo, it.d, it.x, arg_max(not r.negated, r.rule_no) as ign
        from items it join rules r on r.repo = it.repo and regexp_full_match(it.x, r.rx) group by it.repo, it.d, it.x)
select repo, d as path from dirs where not exists (select 1 from dec where dec.repo = dirs.repo and dec.d = dirs.d and dec.ign)
""", views=("fx_files", "fx_ignore_rules"))
def q_list_dirs_repos(spark, sf_dir):
    return wsp.list_dirs(*_repo_files(spark, sf_dir))


@query("relative_path", oracle="""
select path, case when starts_with(path, 'src/small/') then substr(path, 11) else path end as rel_path
from fx_files
""", views=("fx_files",))
def q_relative_path(spark, sf_dir):
    f = fx.view(spark, sf_dir, "fx_files")
    return f.select("path", wsp.relative_path("path", "src/small").alias("rel_path"))


@query("file_counts", oracle="""
select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder, cast(count(*) as bigint) as n_files
from fx_files group by 1
""", views=("fx_files",))
def q_file_counts(spark, sf_dir):
    return wsp.file_counts(fx.view(spark, sf_dir, "fx_files"))


@query("new_files", oracle="""
select path from fx_files f where not exists (
  select 1 from fx_touches t join fx_commits c on t.commit_id = c.commit_id
  where t.path = f.path and c.commit_ts < timestamp '1995-03-01')
""", views=("fx_files", "fx_touches", "fx_commits"))
def q_new_files(spark, sf_dir):
    """Files not in an index built from the history up to 1995-03-01."""
    files, touches, commits = fx.views(spark, sf_dir, "fx_files", "fx_touches", "fx_commits")
    indexed = touches.join(commits.where(F.col("commit_ts") < F.lit("1995-03-01").cast("timestamp_ntz"))
                           .select("commit_id"), "commit_id")
    return wsp.new_files(files, indexed)


# --------------------------------------------------------------------------
# Status and list operators
# --------------------------------------------------------------------------

@query("latest_commit", oracle="""
select path, commit_id as latest_commit_id from (
  select t.path, t.commit_id,
         row_number() over (partition by t.path order by c.commit_ts desc, t.commit_id desc) as rn
  from fx_touches t join fx_commits c on t.commit_id = c.commit_id) x where rn = 1
""", views=("fx_touches", "fx_commits"))
def q_latest_commit(spark, sf_dir):
    commits, touches = fx.views(spark, sf_dir, "fx_commits", "fx_touches")
    return stt.latest_commit(touches.join(commits.select("commit_id", "commit_ts"), "commit_id"))


_ORACLE_LAST_WM = """
last_wm as (select path, commit_id as indexed_commit_id from (
  select path, commit_id, row_number() over (partition by path order by indexed_ts desc, commit_id desc) as rn
  from fx_watermarks) x where rn = 1)
"""


@query("last_indexed", oracle=f"with {_ORACLE_LAST_WM} select * from last_wm", views=("fx_watermarks",))
def q_last_indexed(spark, sf_dir):
    return stt.last_indexed(fx.view(spark, sf_dir, "fx_watermarks"))


@query("line_counts", oracle="""
select path, version,
       cast(case when text = '' then 0 else len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) end as bigint) as n_lines
from fx_snapshots
""", views=("fx_snapshots",))
def q_line_counts(spark, sf_dir):
    return stt.line_counts(fx.view(spark, sf_dir, "fx_snapshots"))


_ORACLE_STATUS = f"""
{_ORACLE_LAST_WM},
latest as (select path, commit_id as latest_commit_id from (
  select path, commit_id, row_number() over (partition by path order by seq desc, commit_id desc) as rn
  from fx_hunks) x where rn = 1),
files as (select distinct path from fx_hunks),
status as (select f.path, l.latest_commit_id, w.indexed_commit_id,
                  case when l.latest_commit_id is null then 'no_commits'
                       when w.indexed_commit_id is null then 'never'
                       when w.indexed_commit_id = l.latest_commit_id then 'fresh' else 'stale' end as status
           from files f left join latest l on f.path = l.path left join last_wm w on f.path = w.path)
"""


def _status(spark, sf_dir):
    hunks, wm = fx.views(spark, sf_dir, "fx_hunks", "fx_watermarks")
    latest = stt.latest_commit(hunks.select("path", "commit_id", "seq"), order="seq")
    return stt.index_status(hunks.select("path"), latest, stt.last_indexed(wm))


@query("index_status", oracle=f"with {_ORACLE_STATUS} select * from status",
       views=("fx_hunks", "fx_watermarks"))
def q_index_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query("index_progress", oracle="""
with latest as (select path, commit_id as latest_commit_id from (
       select t.path, t.commit_id,
              row_number() over (partition by t.path order by c.commit_ts desc, t.commit_id desc) as rn
       from fx_touches t join fx_commits c on t.commit_id = c.commit_id) x where rn = 1),
oldest as (select path, min(commit_id) as c0 from fx_touches group by path),
status as (select f.path,
                  case when l.latest_commit_id is null then 'no_commits'
                       when length(f.path) % 3 = 2 then 'never'
                       when (case when length(f.path) % 3 = 0 then o.c0 else l.latest_commit_id end) = l.latest_commit_id
                            then 'fresh' else 'stale' end as status
           from fx_files f left join latest l on f.path = l.path left join oldest o on f.path = o.path)
select regexp_extract(path, '^(.*)/[^/]*$', 1) as folder,
       cast(sum(case when status = 'fresh' then 1 else 0 end) as bigint) as n_fresh,
       cast(sum(case when status = 'stale' then 1 else 0 end) as bigint) as n_stale,
       cast(sum(case when status = 'never' then 1 else 0 end) as bigint) as n_never,
       cast(sum(case when status = 'no_commits' then 1 else 0 end) as bigint) as n_no_commits,
       cast(count(*) as bigint) as n_files
from status group by 1
""", views=("fx_files", "fx_touches", "fx_commits"))
def q_index_progress(spark, sf_dir):
    """Progress per folder of the workspace files; watermarks are derived
    from the touches: the oldest commit, the latest, or none by path length."""
    files, touches, commits = fx.views(spark, sf_dir, "fx_files", "fx_touches", "fx_commits")
    latest = stt.latest_commit(touches.join(commits.select("commit_id", "commit_ts"), "commit_id"))
    oldest = touches.groupBy("path").agg(F.min("commit_id").alias("_c0"))
    idx = (latest.join(oldest, "path")
           .where(F.length("path") % 3 != 2)
           .select("path", F.when(F.length("path") % 3 == 0, F.col("_c0"))
                   .otherwise(F.col("latest_commit_id")).alias("indexed_commit_id")))
    return stt.index_progress(stt.index_status(files, latest, idx))


@query("merge_line_commits", oracle="""
with a as (select path, line_no, list(commit_id order by commit_id) as c from fx_line_commits group by path, line_no),
b as (select path, line_no, [commit_id] as c from fx_blame),
u as (select path, line_no, 0 as g, c from a union all select path, line_no, 1 as g, c from b)
select path, line_no, array_to_string(flatten(list(c order by g)), ',') as commits from u group by path, line_no
""", views=("fx_line_commits", "fx_blame"))
def q_merge_line_commits(spark, sf_dir):
    lc, bl = fx.views(spark, sf_dir, "fx_line_commits", "fx_blame")
    m = stt.merge_line_commits(lin.collect_history(lc),
                               bl.select("path", "line_no", F.array("commit_id").alias("commit_ids")))
    return m.select("path", "line_no", join_ids("commit_ids").alias("commits"))


@query("merge_commit_lists", oracle="""
with a as (select path, commit_id, row_number() over (partition by path order by commit_id) as o
           from fx_touches where commit_id % 2 = 0),
b as (select t.path, t.commit_id, row_number() over (partition by t.path order by c.commit_ts desc, t.commit_id) as o
      from fx_touches t join fx_commits c on t.commit_id = c.commit_id),
u as (select path, commit_id, min(g * 1000000000 + o) as k from
      (select path, commit_id, 0 as g, o from a union all select path, commit_id, 1 as g, o from b) x
      group by path, commit_id)
select path, commit_id, cast(row_number() over (partition by path order by k) - 1 as bigint) as ord from u
""", views=("fx_touches", "fx_commits"))
def q_merge_commit_lists(spark, sf_dir):
    from pyspark.sql import Window
    touches, commits = fx.views(spark, sf_dir, "fx_touches", "fx_commits")
    a = touches.where(F.col("commit_id") % 2 == 0).withColumn(
        "ord", F.row_number().over(Window.partitionBy("path").orderBy("commit_id")))
    b = touches.join(commits.select("commit_id", "commit_ts"), "commit_id").withColumn(
        "ord", F.row_number().over(Window.partitionBy("path").orderBy(F.col("commit_ts").desc(), "commit_id")))
    return lin.merge_commit_lists(a, b)


@query("commits_after", oracle=f"""
with {_ORACLE_LAST_WM},
pos as (select h.path, h.seq as wm_seq from last_wm w join fx_hunks h
        on h.path = w.path and h.commit_id = w.indexed_commit_id)
select h.path, h.commit_id, h.seq from fx_hunks h left join pos p on h.path = p.path
where p.wm_seq is null or h.seq > p.wm_seq
""", views=("fx_hunks", "fx_watermarks"))
def q_commits_after(spark, sf_dir):
    hunks, wm = fx.views(spark, sf_dir, "fx_hunks", "fx_watermarks")
    last = stt.last_indexed(wm).withColumnRenamed("indexed_commit_id", "commit_id")
    return lin.commits_after(hunks.select("path", "commit_id", "seq"), last)


@query("only_commits", oracle="""
select h.path, h.commit_id, w.indexed_ts as seq, h.new_start, h.old_count, h.new_count
from fx_hunks h join (select distinct commit_id, indexed_ts from fx_watermarks) w on h.commit_id = w.commit_id
""", views=("fx_hunks", "fx_watermarks"))
def q_only_commits(spark, sf_dir):
    """Hunks restricted to the commits of the watermark log, ordered as in
    the log: the list's own order key becomes ``seq`` (no global numbering)."""
    hunks, wm = fx.views(spark, sf_dir, "fx_hunks", "fx_watermarks")
    cl = wm.select("commit_id", F.col("indexed_ts").alias("ord")).distinct()
    return lin.only_commits(hunks, cl).select(
        "path", "commit_id", "seq", "new_start", "old_count", "new_count")


@query("blame_agreement", oracle="""
with h as (select path, line_no, list(commit_id) as c from fx_line_commits group by path, line_no)
select b.path, cast(count(*) as bigint) as n_lines,
       cast(sum(case when coalesce(list_contains(h.c, b.commit_id), false) then 1 else 0 end) as bigint) as n_agree,
       cast(sum(case when coalesce(list_contains(h.c, b.commit_id), false) then 0 else 1 end) as bigint) as n_fail
from fx_blame_off b left join h on b.path = h.path and b.line_no = h.line_no group by b.path
""", views=("fx_line_commits", "fx_blame_off"))
def q_blame_agreement(spark, sf_dir):
    lc, bl = fx.views(spark, sf_dir, "fx_line_commits", "fx_blame_off")
    return lin.blame_agreement(lin.collect_history(lc), bl)


@query("ordered_history", oracle="""
select path, line_no, array_to_string(list(commit_id order by commit_id), ',') as commits
from fx_line_commits group by path, line_no
""", views=("fx_line_commits",))
def q_ordered_history(spark, sf_dir):
    h = lin.ordered_history(lin.collect_history(fx.view(spark, sf_dir, "fx_line_commits")))
    return h.select("path", "line_no", join_ids("commit_ids").alias("commits"))


# --------------------------------------------------------------------------
# Column functions (O36, O47-O54) and replacement marking
# --------------------------------------------------------------------------


_REMOTE_SQL = """case commit_id % 4 when 0 then 'git@github.com:org/repo' || cast(commit_id % 10 as {s}) || '.git'
     when 1 then 'https://github.com/org/repo.git' when 2 then ' https://github.com/org/repo '
     else 'https://gitlab.com/org/repo.git' end"""
_URL_RX = "^(?:git@github\\.com:|https://github\\.com/)(.+?)(?:\\.git)?$"


@query("text_helpers", oracle=f"""
with t as (select commit_id, commit_hash, author, title,
                  case when commit_id % 2 = 0 then '^' else '' end || commit_hash || 'f00d' as h,
                  case when commit_id % 3 = 0 then '+' else '' end || title as marked,
                  author || ',' || title || ',' || commit_hash as lst,
                  trim({_REMOTE_SQL.format(s='varchar')}) as remote,
                  title || chr(10) || chr(10) || '  body of ' || author || '  ' || chr(10) as msg
           from fx_commits)
select commit_id, substr(regexp_replace(h, '^\\^', ''), 1, 7) as short_hash,
       regexp_replace(marked, '^\\+', '') as stripped,
       array_to_string(string_split(lst, ',')[1:2], ',') as trimmed,
       case when regexp_matches(remote, '{_URL_RX}')
            then 'https://github.com/' || regexp_extract(remote, '{_URL_RX}', 1) || '/commit/' || commit_hash
            else '' end as url,
       regexp_replace(split_part(regexp_replace(msg, '^\\s+|\\s+$', '', 'g'), chr(10), 1), '^\\s+|\\s+$', '', 'g') as msg_title,
       regexp_replace(substr(regexp_replace(msg, '^\\s+|\\s+$', '', 'g'),
                             strpos(regexp_replace(msg, '^\\s+|\\s+$', '', 'g'), chr(10)) + 1), '^\\s+|\\s+$', '', 'g') as msg_body
from t
""", views=("fx_commits",))
def q_text_helpers(spark, sf_dir):
    c = fx.view(spark, sf_dir, "fx_commits")
    remote = F.expr(_REMOTE_SQL.format(s="string"))
    h = F.concat(F.when(F.col("commit_id") % 2 == 0, F.lit("^")).otherwise(F.lit("")), "commit_hash", F.lit("f00d"))
    marked = F.concat(F.when(F.col("commit_id") % 3 == 0, F.lit("+")).otherwise(F.lit("")), "title")
    lst = F.concat_ws(",", "author", "title", "commit_hash")
    msg = F.concat("title", F.lit("\n\n  body of "), "author", F.lit("  \n"))
    m = tx.split_message(msg)
    return c.select("commit_id", tx.short_hash(h).alias("short_hash"), tx.strip_marker(marked).alias("stripped"),
                    tx.trim_list(lst, 2).alias("trimmed"), tx.commit_url(remote, F.col("commit_hash")).alias("url"),
                    m["title"].alias("msg_title"), m["body"].alias("msg_body"))


_HEADER_SQL = """case when commit_id % 13 = 0 then 'bad input'
     else '-' || cast(new_start as {s}) || case when old_count = 1 and commit_id % 2 = 0 then '' else ',' || cast(old_count as {s}) end
          || ' +' || cast(new_start as {s}) || case when new_count = 1 and commit_id % 3 = 0 then '' else ',' || cast(new_count as {s}) end
     end"""
_HDR_RX = "^-(\\d+)(?:,(\\d+))?\\s+\\+(\\d+)(?:,(\\d+))?$"


@query("hunk_headers", oracle=f"""
with t as (select path, commit_id, {_HEADER_SQL.format(s='varchar')} as hdr from fx_hunks),
p as (select path, commit_id, regexp_matches(hdr, '{_HDR_RX}') as ok,
             cast(nullif(regexp_extract(hdr, '{_HDR_RX}', 1), '') as bigint) as old_start,
             cast(coalesce(nullif(regexp_extract(hdr, '{_HDR_RX}', 2), ''), '1') as bigint) as old_count,
             cast(nullif(regexp_extract(hdr, '{_HDR_RX}', 3), '') as bigint) as new_start,
             cast(coalesce(nullif(regexp_extract(hdr, '{_HDR_RX}', 4), ''), '1') as bigint) as new_count
      from t)
select path, commit_id,
       case when ok then old_start end as old_start, case when ok then old_count end as old_count,
       case when ok then new_start end as new_start, case when ok then new_count end as new_count,
       case when not ok then null
            when old_count > 1 and new_count = 1 then 'few_replaced_with_single'
            when old_count >= 1 and new_count > 1 then 'few_replaced_with_few'
            when old_count = 1 and new_count = 0 then 'single_deleted'
            when old_count > 1 and new_count = 0 then 'few_deleted'
            when old_count = 1 and new_count = 1 then 'single_replaced_with_single'
            when old_count = 0 and new_count > 0 then 'new_lines_added'
            else 'none_found' end as category
from p
""", views=("fx_hunks",))
def q_hunk_headers(spark, sf_dir):
    """Headers rendered in every git form (counts of 1 left out, bad text),
    wrapped in ``@@ .. @@ context`` and parsed back."""
    h = fx.view(spark, sf_dir, "fx_hunks")
    line = F.concat(F.lit("@@ "), F.expr(_HEADER_SQL.format(s="string")), F.lit(" @@ fn main() {"))
    p = tx.parse_hunk_header(tx.hunk_header_body(line))
    return h.select("path", "commit_id", p.alias("h")).select(
        "path", "commit_id", "h.old_start", "h.old_count", "h.new_start", "h.new_count",
        tx.categorize_change(F.col("h.old_count"), F.col("h.new_count")).alias("category"))


_SIM_T = 3
_ORACLE_SIM = """
ranked as (select hunk_id, side, line_id, content,
                  row_number() over (partition by hunk_id, side order by line_id, content) - 1 as k
           from fx_similar_lines)
"""


def _similar_hunks(spark, sf_dir):
    s = fx.view(spark, sf_dir, "fx_similar_lines")

    def side(name):
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == name, F.struct("line_id", "content")))),
                           lambda x: x["content"])
    return s.groupBy("hunk_id").agg(side("deleted").alias("deleted"), side("added").alias("added")) \
        .withColumn("old_count", F.size("deleted")).withColumn("new_count", F.size("added"))


@query("mark_replaced", oracle=f"""
with {_ORACLE_SIM}
select a.hunk_id, cast(a.k as int) as k, a.content from ranked a
where a.side = 'added' and exists (select 1 from ranked d where d.hunk_id = a.hunk_id and d.side = 'deleted'
                                   and levenshtein(d.content, a.content) <= {_SIM_T})
""", views=("fx_similar_lines",))
def q_mark_replaced(spark, sf_dir):
    m = lin.mark_replaced(_similar_hunks(spark, sf_dir), threshold=_SIM_T)
    return m.select("hunk_id", "added", F.explode("replaced").alias("k")).select(
        "hunk_id", "k", F.element_at("added", F.col("k") + 1).alias("content"))


@query("mark_replaced_segments", oracle=f"""
with lines as (select cast(l_suppkey as bigint) as h, l_linenumber % 2 = 1 as old, p_name || ' ' || cast(l_quantity as integer) % 7 as t from lineitem join part on l_partkey = p_partkey)
select distinct a.h as hunk_id, a.t as content from lines a
where not a.old and exists (select 1 from lines d where d.h = a.h and d.old and abs(length(d.t) - length(a.t)) <= {_SIM_T} and levenshtein(d.t, a.t) <= {_SIM_T})
""")
def q_mark_replaced_segments(spark, sf_dir):
    """Hunks of hundreds of removed and of added lines, that meet by segments alone."""
    fx.register_tables(spark, sf_dir, ["lineitem", "part"])
    lines = spark.sql("""select cast(l_suppkey as bigint) as hunk_id, l_linenumber % 2 = 1 as old, p_name || ' ' || cast(l_quantity as integer) % 7 as t
        from lineitem join part on l_partkey = p_partkey""")
    side = lambda old: F.sort_array(F.collect_list(F.when(F.col("old") == old, F.col("t"))))
    h = lines.groupBy("hunk_id").agg(side(True).alias("deleted"), side(False).alias("added")) \
        .withColumn("old_count", F.size("deleted")).withColumn("new_count", F.size("added"))
    m = lin.mark_replaced(h, threshold=_SIM_T, product_up_to=0)
    return m.select("hunk_id", F.explode(F.transform("replaced", lambda k: F.element_at("added", k + 1))).alias("content")).distinct()


@query("edit_distance", oracle=f"""
with {_ORACLE_SIM}
select a.hunk_id, cast(a.k as int) as k, cast(levenshtein(d.content, a.content) as int) as distance,
       levenshtein(d.content, a.content) <= {_SIM_T} as similar
from ranked a join ranked d on a.hunk_id = d.hunk_id and a.k = d.k and a.side = 'added' and d.side = 'deleted'
""", views=("fx_similar_lines",))
def q_edit_distance(spark, sf_dir):
    """Added line k against removed line k of the same hunk (aligned pairs)."""
    h = _similar_hunks(spark, sf_dir)
    pairs = h.select("hunk_id", F.posexplode(F.arrays_zip("deleted", "added")).alias("k", "p")) \
        .where(F.col("p.deleted").isNotNull() & F.col("p.added").isNotNull())
    return pairs.select("hunk_id", F.col("k").cast("int").alias("k"),
                        tx.edit_distance("p.deleted", "p.added").alias("distance"),
                        tx.is_similar("p.deleted", "p.added", _SIM_T).alias("similar"))


# --------------------------------------------------------------------------
# Store, jobs and the stream
# --------------------------------------------------------------------------


def _scratch(spark, what):
    import os
    return os.path.join(checkpoint_dir(spark), "queries", f"{what}-{uuid.uuid4().hex}")


def _stored(spark, df, what):
    """Written once: plans that read a history several times would trace it again for each."""
    path = _scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@query("line_index_generations", oracle="""
select path, line_no, array_to_string(list(commit_id order by commit_id), ',') as commits
from fx_line_commits where length(path) % 2 = 1 or line_no <= 9 group by path, line_no
""", views=("fx_line_commits",))
def q_line_index_generations(spark, sf_dir):
    """Write the index, then a second generation for some files holding only
    their first lines; reading keeps each file's latest generation."""
    root = _scratch(spark, "index")
    hist = lin.collect_history(fx.view(spark, sf_dir, "fx_line_commits"))
    store.write_line_index(hist, root, n_buckets=8, generation=1)
    store.write_line_index(hist.where((F.length("path") % 2 == 0) & (F.col("line_no") <= 9)), root,
                           n_buckets=8, generation=2)
    back = store.read_line_index(spark, root)
    return back.select("path", "line_no", join_ids("commit_ids").alias("commits"))


@query("watermark_log", oracle=f"with {_ORACLE_LAST_WM} select * from last_wm", views=("fx_watermarks",))
def q_watermark_log(spark, sf_dir):
    """Append the log in two parts (before and after mid-2024), read it back."""
    root = _scratch(spark, "wm")
    wm = fx.view(spark, sf_dir, "fx_watermarks")
    cut = F.lit("2024-07-01").cast("timestamp_ntz")
    store.append_watermarks(wm.where(F.col("indexed_ts") < cut), root)
    store.append_watermarks(wm.where(F.col("indexed_ts") >= cut), root)
    return stt.last_indexed(store.read_watermarks(spark, root)).select("path", "indexed_commit_id")


_LH_OUT = """
select path, line_no, array_to_string(commits, ',') as commits,
       'e' || cast(hc as varchar) || ':' || cast(hk as varchar) as content
from final
"""


def _lh_out(df):
    return df.select("path", "line_no", join_ids("commit_ids").alias("commits"), "content")


_SPLIT_SEQ = 30


@query("update_index", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_update_index(spark, sf_dir):
    """Index the history up to seq 30, then bring it up to date incrementally;
    the result must equal the full line history."""
    h = hunks_with_text(spark, sf_dir)
    part1 = h.where(F.col("seq") <= _SPLIT_SEQ)
    checkpoint_dir(spark)
    base = lin.line_history(part1).checkpoint(eager=True)  # the stored index
    wm = jobs.new_watermarks(part1)
    upd, new_wm = jobs.update_index(base, h, wm)
    # the new watermarks name the updated files (one row each), without re-running the fold
    full = base.join(new_wm.select("path"), "path", "left_anti").unionByName(upd)
    return _lh_out(full)


@query("build_index", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_build_index(spark, sf_dir):
    """Build the index of every file, then run the build again (all files are
    fresh and skipped); read the index back."""
    h = hunks_with_text(spark, sf_dir)
    files = h.select("path").distinct()
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=8)
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=8)
    return _lh_out(store.read_line_index(spark, idx))


_REINDEX_SEL = """fx_hunks_sel as (select * from fx_hunks
  where seq <= 30 or cast(regexp_extract(path, 'u(\\d+)\\.rs', 1) as bigint) % 3 = 0)"""


@query("reindex_files", oracle="with " + oracle_walk("fx_hunks_sel").replace(
    "recursive h as", f"recursive {_REINDEX_SEL}, h as", 1) + _LH_OUT, views=("fx_hunks",))
def q_reindex_files(spark, sf_dir):
    """Index the history up to seq 30, then re-index a third of the files
    from their whole history; the other files keep their older rows."""
    h = hunks_with_text(spark, sf_dir)
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    jobs.build_index(spark, h.select("path").distinct(), h.where(F.col("seq") <= _SPLIT_SEQ), idx, wmd,
                     n_buckets=8)
    paths = h.select("path").distinct().where(
        F.regexp_extract("path", r"u(\d+)\.rs", 1).cast("bigint") % 3 == 0)
    jobs.reindex_files(spark, paths, h, idx, wmd, n_buckets=8)
    return _lh_out(store.read_line_index(spark, idx))


@query("stream_index", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_stream_index(spark, sf_dir):
    """Hunk files land in two drops (up to seq 30, then the rest); a stream
    with Trigger.AvailableNow keeps the index current after each drop."""
    from .streaming.index_stream import stream_index
    h = hunks_with_text(spark, sf_dir)
    land, idx, wmd, ck = (_scratch(spark, w) for w in ("hunks", "index", "wm", "stream"))
    schema = h.schema
    for part in (h.where(F.col("seq") <= _SPLIT_SEQ), h.where(F.col("seq") > _SPLIT_SEQ)):
        part.write.mode("append").parquet(land)
        q = stream_index(spark, land, schema, idx, wmd, ck, n_buckets=8)
        q.awaitTermination()
    return _lh_out(store.read_line_index(spark, idx))


_UREQ = """
ureq as (select -min(commit_id) - 1 as req_id, path, 1 + min(commit_id) % 10 as start_line,
                case when min(commit_id) % 4 = 0 then 0 else 20 + min(commit_id) % 15 end as end_line
         from fx_hunks group by path)
"""


def _job_inputs(spark, sf_dir):
    """Requests on indexed and on unindexed files, the folder of the published index with its log, and the hunks.
    They are stored tables in real use; here they are
    written once to the shared folder instead of being re-derived from
    lineitem and events in every branch of the plan."""
    req, lc, hunks = fx.views(spark, sf_dir, "fx_requests", "fx_line_commits", "fx_hunks")
    root = _scratch(spark, "inputs")
    wm = lc.groupBy("path").agg(F.max("commit_id").alias("commit_id"), F.max("line_no").alias("n_lines")) \
        .withColumns({"seq": F.lit(1), "indexed_ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")})
    jobs.publish(spark, lc, wm, root + "/index", root + "/log", n_buckets=8)
    hunks.write.parquet(root + "/hunks")
    hunks = spark.read.parquet(root + "/hunks")
    ureq = hunks.groupBy("path").agg(F.min("commit_id").alias("_c")).select(
        (-F.col("_c") - 1).alias("req_id"), "path", (1 + F.col("_c") % 10).alias("start_line"),
        F.when(F.col("_c") % 4 == 0, F.lit(0)).otherwise(20 + F.col("_c") % 15).alias("end_line"))
    req.unionByName(ureq).write.parquet(root + "/requests")
    return spark.read.parquet(root + "/requests"), root + "/index", store.read_watermarks(spark, root + "/log"), hunks


_ORACLE_JOB_LINES = f"""
with {_ORACLE_WALK},
{_UREQ.strip()},
reqs as (select req_id, path, start_line, end_line from fx_requests union all select * from ureq),
counts as (select path, max(line_no) as n_lines from fx_line_commits group by path
           union all select path, sum(new_count - old_count) from fx_hunks group by path),
lines as (
  select req_id, path, cast(unnest(generate_series(cast(start_line as bigint), e)) as bigint) as line_no
  from (select r.req_id, r.path, r.start_line,
               cast(case when r.end_line = 0 then c.n_lines else r.end_line end as bigint) as e
        from reqs r left join counts c on r.path = c.path) x
  where start_line <= e),
uhits as (select l.req_id, l.path, l.line_no, unnest(f.commits) as commit_id,
                 unnest(generate_series(0, len(f.commits) - 1)) as pos
          from lines l join final f on l.path = f.path and l.line_no = f.line_no)
"""


@query("query_context", oracle=_ORACLE_JOB_LINES + """,
hits as (select l.req_id, lc.commit_id from lines l join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no
         union all select req_id, commit_id from uhits),
mult as (select req_id, commit_id, count(*) as m from hits group by req_id, commit_id),
rel as (select req_id, t.path as related_path, cast(sum(m) as bigint) as occurrences
        from mult join fx_touches t on mult.commit_id = t.commit_id group by req_id, t.path)
select * from (select *, cast(row_number() over (partition by req_id order by occurrences desc, related_path) as bigint) as rank
               from rel) x where rank <= 10
""", views=("fx_requests", "fx_line_commits", "fx_hunks", "fx_touches"))
def q_query_context(spark, sf_dir):
    """Top 10 related files for requests on indexed files and on files with
    no index (answered from their hunks on the fly)."""
    reqs, index, log, hunks = _job_inputs(spark, sf_dir)
    touches = fx.view(spark, sf_dir, "fx_touches")
    return jobs.query_context(reqs, index, touches, k=10, hunks=hunks, watermarks=log)


@query("query_descriptions", oracle=_ORACLE_JOB_LINES + """,
keys as (select distinct path, cast(line_no as bigint) as k from fx_line_commits),
covers as (select path, k, coalesce(lag(k) over (partition by path order by k), -1) + 1 as lo from keys),
fwd_hits as (select l.req_id, l.line_no, 0 as pos, lc.commit_id
             from lines l join covers c on l.path = c.path and l.line_no between c.lo and c.k
             join fx_line_commits lc on c.path = lc.path and c.k = lc.line_no),
hits as (select req_id, line_no, pos, commit_id from fwd_hits
         union all select req_id, line_no, pos, commit_id from uhits),
firsts as (select req_id, commit_id, arg_min(line_no, line_no * 100000 + pos) as first_line_no,
                  cast(arg_min(pos, line_no * 100000 + pos) as bigint) as first_pos
           from hits group by req_id, commit_id)
select f.req_id, f.commit_id, f.first_line_no, f.first_pos, c.title, '' as body, c.author, c.commit_ts,
       'https://github.com/linetrail/history/commit/' || c.commit_hash as url
from firsts f join fx_commits c on f.commit_id = c.commit_id
""", views=("fx_requests", "fx_line_commits", "fx_hunks", "fx_commits"))
def q_query_descriptions(spark, sf_dir):
    reqs, index, log, hunks = _job_inputs(spark, sf_dir)
    commits = fx.view(spark, sf_dir, "fx_commits")
    return jobs.query_descriptions(reqs, index, commits, hunks=hunks, watermarks=log,
                                   remote="https://github.com/linetrail/history.git")


@query("commits_to_files", oracle=f"""
with {_ORACLE_LINES},
hits as (select l.req_id, lc.commit_id from lines l
         join fx_line_commits lc on l.path = lc.path and l.line_no = lc.line_no),
mult as (select req_id, commit_id, cast(count(*) as bigint) as multiplicity from hits group by req_id, commit_id)
select m.req_id, m.commit_id, m.multiplicity, t.path as related_path
from mult m join fx_touches t on m.commit_id = t.commit_id
""", views=("fx_requests", "fx_line_commits", "fx_touches"))
def q_commits_to_files(spark, sf_dir):
    _, idx, lines = _requests_index(spark, sf_dir)
    touches = fx.view(spark, sf_dir, "fx_touches")
    return ctx.commits_to_files(ctx.lines_to_commits(lines, idx), touches)


@query("line_history_sql", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_line_history_sql(spark, sf_dir):
    """The same history with the pure-JVM engine (one aggregate per line)."""
    return _lh_out(lin.line_history(hunks_with_text(spark, sf_dir), engine="sql"))


@query("blame_text_agreement", oracle="""
with h as (select path, line_no, commit_id from fx_line_commits),
b as (select path, line_no, substr(lpad(cast(commit_id as varchar), 8, '0'), 1, 7) as sh from fx_blame_off)
select b.path, cast(count(*) as bigint) as n_lines,
       cast(sum(case when exists (select 1 from h where h.path = b.path and h.line_no = b.line_no
                                  and substr(lpad(cast(h.commit_id as varchar), 8, '0'), 1, 7) = b.sh)
                     then 1 else 0 end) as bigint) as n_agree,
       cast(sum(case when exists (select 1 from h where h.path = b.path and h.line_no = b.line_no
                                  and substr(lpad(cast(h.commit_id as varchar), 8, '0'), 1, 7) = b.sh)
                     then 0 else 1 end) as bigint) as n_fail
from b group by b.path
""", views=("fx_line_commits", "fx_blame_off"))
def q_blame_text_agreement(spark, sf_dir):
    """Blame text parsed to 7-character hashes, compared with the line
    history by abbreviated hash (the check of the reference's real-history test)."""
    fx.view(spark, sf_dir, "fx_blame_off").createOrReplaceTempView("fx_blame_off")
    blame = src.parse_blame(spark.sql(_BLAME_RENDER.replace("fx_blame", "fx_blame_off")).select("path", "raw")) \
        .select("path", "line_no", F.col("commit_hash").alias("commit_id"), "content")
    lc = fx.view(spark, sf_dir, "fx_line_commits")
    hist = lin.collect_history(lc).withColumn(
        "commit_ids", F.transform("commit_ids", lambda c: F.lpad(c.cast("string"), 8, "0")))
    return lin.blame_agreement(hist, blame, short=True)


@query("line_history_generations", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_line_history_generations(spark, sf_dir):
    """Each file's history in three parts, every part continuing the lines of the one before."""
    h = hunks_with_text(spark, sf_dir)
    part = F.least(F.lit(2), F.floor(F.col("seq") / 20))
    cur = _stored(spark, lin.line_history(h.where(part == 0)), "generation")
    for i in (1, 2):
        new = h.where(part == i)
        nxt = lin.line_history(new, base=cur)
        cur = cur.join(new.select("path").distinct(), "path", "left_anti").unionByName(nxt)
        cur = _stored(spark, cur, "generation") if i == 1 else cur
    return _lh_out(cur)


@query("line_index_compaction", oracle="""
select path, line_no, array_to_string(list(commit_id order by commit_id), ',') as commits
from fx_line_commits where length(path) % 2 = 1 or line_no <= 9 group by path, line_no
""", views=("fx_line_commits",))
def q_line_index_compaction(spark, sf_dir):
    """Two generations with different numbers of buckets, then the live rows written to a new folder; the answer is unchanged."""
    root = _scratch(spark, "index")
    hist = lin.collect_history(fx.view(spark, sf_dir, "fx_line_commits"))
    store.write_line_index(hist, root, n_buckets=8, generation=1)
    store.write_line_index(hist.where((F.length("path") % 2 == 0) & (F.col("line_no") <= 9)), root,
                           n_buckets=16, generation=2)
    store.compact_line_index(spark, root, root + "-live")
    back = store.read_line_index(spark, root + "-live")
    return back.select("path", "line_no", join_ids("commit_ids").alias("commits"))


# --------------------------------------------------------------------------
# Emptied files, crashes, other bucket counts, long ranges, skew, repositories
# --------------------------------------------------------------------------


def _emptied(spark, sf_dir):
    h = fx.view(spark, sf_dir, "fx_emptied_hunks")
    text = F.transform(F.array_repeat(F.lit(0), F.col("new_count").cast("int")),
                       lambda _x, i: F.concat(F.lit("e"), F.col("commit_id").cast("string"), F.lit(":"), i.cast("string")))
    return h.withColumn("hunk_no", F.lit(1)).withColumn("added", text)


_EMPTIED_OUT = f"with {oracle_walk('fx_emptied_hunks')} {_LH_OUT}"


@query("index_deleted_file", oracle=_EMPTIED_OUT, views=("fx_emptied_hunks",))
def q_index_deleted_file(spark, sf_dir):
    """Files grow, are emptied and filled again, with a build after each step; a third of them stays empty."""
    h = _emptied(spark, sf_dir)
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    for seq in (2, 3, 4):
        jobs.build_index(spark, h.select("path").distinct(), h.where(F.col("seq") <= seq), idx, wmd, n_buckets=8)
    return _lh_out(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd)))


@query("index_crash_replay", oracle=_EMPTIED_OUT, views=("fx_emptied_hunks",))
def q_index_crash_replay(spark, sf_dir):
    """A build dies after its rows and before its watermarks, and runs again with another number of buckets."""
    h = _emptied(spark, sf_dir)
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    files = h.select("path").distinct()
    jobs.build_index(spark, files, h.where("seq <= 2"), idx, wmd, n_buckets=8)
    wm = store.read_watermarks(spark, wmd)
    rows, _ = jobs.update_index(store.read_published(spark, idx, wm), h, wm)
    store.write_line_index(rows, idx, n_buckets=8)  # and here it dies
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=16)
    return _lh_out(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd)))


@query("stream_crash_replay", oracle=_EMPTIED_OUT, views=("fx_emptied_hunks",))
def q_stream_crash_replay(spark, sf_dir):
    """Micro-batches that are given again: one whose watermarks were lost, one that had been published."""
    from .streaming.index_stream import _batch_update
    h = _emptied(spark, sf_dir)
    idx, wmd, hs = (_scratch(spark, w) for w in ("index", "wm", "hunks"))
    run = lambda df, epoch, wm: _batch_update(spark, df, epoch, h.schema, idx, wm, hs, 8)
    run(h.where("seq <= 2"), 0, wmd)
    wm = store.read_watermarks(spark, wmd)
    rows, _ = jobs.update_index(store.read_published(spark, idx, wm), h.where("seq <= 3"), wm)
    store.write_line_index(rows, idx, 8)  # the batch of epoch 1 dies here and is replayed
    run(h.where("seq = 3"), 1, wmd)
    run(h.where("seq = 4"), 2, wmd)
    run(h.where("seq = 4"), 2, wmd)
    return _lh_out(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd)))


@query("index_line_merge", oracle="""
with g as (select path, line_no, commit_id, 1 as g from fx_line_commits
           union all select path, line_no, -commit_id, 2 as g from fx_line_commits where line_no <= 9),
t as (select path, line_no, max(g) as g from g group by path, line_no)
select g.path, g.line_no, array_to_string(list(g.commit_id order by g.commit_id), ',') as commits
from g join t on g.path = t.path and g.line_no = t.line_no and g.g = t.g group by g.path, g.line_no
""", views=("fx_line_commits",))
def q_index_line_merge(spark, sf_dir):
    """A second generation holds only the first lines of each file; line by line the later one wins."""
    root = _scratch(spark, "index")
    lc = fx.view(spark, sf_dir, "fx_line_commits")
    store.write_line_index(lin.collect_history(lc), root, n_buckets=8, generation=1)
    store.write_line_index(lin.collect_history(lc.where("line_no <= 9").withColumn("commit_id", -F.col("commit_id"))), root,
                           n_buckets=32, generation=2)
    back = store.read_line_index(spark, root, paths=lc.select("path").distinct(), resolve="line")
    return back.select("path", "line_no", join_ids("commit_ids").alias("commits"))


@query("build_index_rules", oracle=f"""
with {_ORACLE_WALK}
select path, line_no, array_to_string(commits, ',') as commits from final
where path not like 'u1%' and path <> 'u20.rs' and regexp_matches(path, '^u[0-9]*[02468][.]rs$')
""", views=("fx_hunks",))
def q_build_index_rules(spark, sf_dir):
    """Files under two folders, less those that ignore rules name, are built."""
    h = fx.view(spark, sf_dir, "fx_hunks")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("int")
    h = h.withColumn("path", F.concat(F.when(number % 2 == 0, "even/").otherwise("odd/"), "path"))
    rules = spark.createDataFrame([(1, "# u*.rs"), (2, "u1*.rs  "), (3, "even/u2[0].rs"), (4, "odd/deep/")], "rule_no int, pattern string")
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    jobs.build_index(spark, h.select("path").distinct(), h, idx, wmd, rules=rules, subfolders="even, odd/deep", n_buckets=8)
    back = store.read_line_index(spark, idx)
    return back.select(wsp.relative_path("path", "even").alias("path"), "line_no", join_ids("commit_ids").alias("commits"))


@query("long_ranges", oracle="""
select r.s_suppkey as req_id, lc.path, cast(lc.line_no as bigint) as line_no, lc.commit_id
from supplier r join fx_line_commits lc on lc.path = 's' || cast(r.s_suppkey as varchar) || '.rs' and lc.line_no >= r.s_suppkey % 20
""", views=("fx_line_commits",))
def q_long_ranges(spark, sf_dir):
    """Every request ends at line 3,000,000,000."""
    req, idx = fx.views(spark, sf_dir, "fx_requests", "fx_line_commits")
    req = req.withColumn("end_line", F.lit(3_000_000_000))
    return ctx.lines_in_range(idx, req).select("req_id", "path", F.col("line_no").cast("bigint").alias("line_no"), "commit_id")


@query("skewed_numbering", oracle="""
with t as (select case when l_orderkey % 3 = 0 then 'hot' else 'k' || cast(l_partkey % 50 as varchar) end as k,
                  case when l_orderkey = 3 then timestamp '1970-01-01' else l_shipdate end as ts, l_orderkey, l_linenumber, l_quantity from lineitem)
select k, l_orderkey, l_linenumber, cast(row_number() over w as bigint) as rn,
       cast(coalesce(sum(l_linenumber) over (w rows between unbounded preceding and 1 preceding), 0) as bigint) as before,
       lag(l_orderkey) over w as prev
from t window w as (partition by k order by ts, l_orderkey, l_linenumber)
""")
def q_skewed_numbering(spark, sf_dir):
    """Numbers, running sums and previous values with a third of all rows under one key, one date far off, in small chunks."""
    from .plans.scan import keyed_scan
    fx.register_tables(spark, sf_dir, ["lineitem"])
    t = spark.sql("""select case when l_orderkey % 3 = 0 then 'hot' else concat('k', cast(l_partkey % 50 as string)) end as k,
        case when l_orderkey = 3 then timestamp_ntz '1970-01-01' else l_shipdate end as ts, l_orderkey, l_linenumber from lineitem""")
    out = keyed_scan(t, ["k"], ["ts", "l_orderkey", "l_linenumber"], number="rn", running_sum=("l_linenumber", "before"),
                     previous=("l_orderkey", "prev"), chunk_rows=1000)
    return out.select("k", "l_orderkey", "l_linenumber", "rn", F.col("before").cast("bigint").alias("before"), "prev")


# --------------------------------------------------------------------------
# Ranges as intervals, commit lists, mass-change commits
# --------------------------------------------------------------------------

_FAR = 3_000_000_000
_ORACLE_FAR = f"""
r as (select r.req_id, r.path, cast(r.start_line as bigint) as s,
             cast(case when r.req_id % 3 = 0 then {_FAR} when r.end_line = 0 then c.n else r.end_line end as bigint) as e
      from (select * from fx_requests union all select -s_suppkey, 'none' || cast(s_suppkey as varchar) || '.rs', 5, 8 from supplier) r
      left join (select path, max(line_no) as n from fx_line_commits group by path) c on c.path = r.path),
q as (select * from r where s <= e)
"""


def _far_requests(spark, sf_dir):
    """The requests, a third of them up to line 3,000,000,000, and as many on files that have no index."""
    req, idx = fx.views(spark, sf_dir, "fx_requests", "fx_line_commits")
    none = req.select((-F.col("req_id")).alias("req_id"), F.concat(F.lit("none"), F.col("req_id").cast("string"), F.lit(".rs")).alias("path"),
                      F.lit(5).alias("start_line"), F.lit(8).alias("end_line"))
    req = req.unionByName(none).withColumn("end_line", F.when(F.col("req_id") % 3 == 0, F.lit(_FAR)).otherwise(F.col("end_line")))
    return req, idx


@query("uncovered_ranges", oracle=f"""
with {_ORACLE_FAR},
keys as (select distinct path, cast(line_no as bigint) as k from fx_line_commits),
gaps as (select path, coalesce(lag(k) over (partition by path order by k), -1000) + 1 as a, k - 1 as b from keys
         union all select path, max(k) + 1, {1 << 62} from keys group by path),
g as (select * from gaps where a <= b)
select req_id, q.path, greatest(s, a) as start_line, least(e, b) as end_line from q join g on g.path = q.path and a <= e and s <= b
union all select req_id, path, s, e from q where path not in (select path from keys)
""", views=("fx_requests", "fx_line_commits"))
def q_uncovered_ranges(spark, sf_dir):
    """What the index lacks of each request, as ranges: a request of three billion lines gives a few rows."""
    req, idx = _far_requests(spark, sf_dir)
    return ctx.uncovered_ranges(req, idx, counts=ctx.line_counts_from_index(idx))


@query("uncovered_ranges_forward", oracle=f"""
with {_ORACLE_FAR},
last as (select path, cast(max(line_no) as bigint) as k from fx_line_commits group by path)
select * from (select req_id, q.path, greatest(s, coalesce(k + 1, s)) as start_line, e as end_line from q left join last on last.path = q.path) x
where start_line <= end_line
""", views=("fx_requests", "fx_line_commits"))
def q_uncovered_ranges_forward(spark, sf_dir):
    req, idx = _far_requests(spark, sf_dir)
    return ctx.uncovered_ranges(req, idx, "forward", ctx.line_counts_from_index(idx))


_ULINES = f"""{_UREQ.strip()},
ulines as (select r.req_id, f.path, f.line_no, f.commits from final f join ureq r on r.path = f.path
           and f.line_no >= r.start_line and (r.end_line = 0 or f.line_no <= r.end_line))"""


def _list_index(spark, sf_dir):
    """Requests on the files of the hunks, their lines, and the line history with its lists, both stored."""
    hunks = fx.view(spark, sf_dir, "fx_hunks")
    rows, lists = lin.list_dictionary(_stored(spark, lin.line_history(hunks, with_text=False), "history"))
    root = _scratch(spark, "lists")
    rows.write.parquet(root + "/rows")
    lists.write.parquet(root + "/lists")
    rows, lists = spark.read.parquet(root + "/rows"), spark.read.parquet(root + "/lists")
    reqs = hunks.groupBy("path").agg(F.min("commit_id").alias("_c")).select(
        (-F.col("_c") - 1).alias("req_id"), "path", (1 + F.col("_c") % 10).alias("start_line"),
        F.when(F.col("_c") % 4 == 0, F.lit(0)).otherwise(20 + F.col("_c") % 15).alias("end_line"))
    return ctx.expand_ranges(reqs, ctx.line_counts_from_index(rows), clamp=True), rows, lists


@query("related_files_lists", oracle=f"""
with {_ORACLE_WALK}, {_ULINES},
hits as (select req_id, unnest(commits) as commit_id from ulines)
select req_id, t.path as related_path, cast(count(*) as bigint) as occurrences from hits h join fx_touches t on t.commit_id = h.commit_id group by all
""", views=("fx_hunks", "fx_touches"))
def q_related_files_lists(spark, sf_dir):
    """Related files from commit lists that are counted before they are unfolded."""
    lines, rows, lists = _list_index(spark, sf_dir)
    return ctx.related_files_by_lists(ctx.lines_to_lists(lines, rows), lists, fx.view(spark, sf_dir, "fx_touches"))


@query("commits_of_range_lists", oracle=f"""
with {_ORACLE_WALK}, {_ULINES},
hits as (select req_id, line_no, unnest(commits) as commit_id, unnest(generate_series(0, len(commits) - 1)) as pos from ulines)
select req_id, commit_id, arg_min(line_no, line_no * 100000 + pos) as first_line_no, cast(arg_min(pos, line_no * 100000 + pos) as bigint) as first_pos
from hits group by req_id, commit_id
""", views=("fx_hunks",))
def q_commits_of_range_lists(spark, sf_dir):
    lines, rows, lists = _list_index(spark, sf_dir)
    return ctx.commits_of_range_by_lists(ctx.lines_to_lists(lines, rows), lists)


@query("list_dictionary", oracle=f"with {_ORACLE_WALK} select path, line_no, array_to_string(commits, ',') as commits from final", views=("fx_hunks",))
def q_list_dictionary(spark, sf_dir):
    """The index taken apart into rows and lists, and put together again."""
    _, rows, lists = _list_index(spark, sf_dir)
    return lin.with_lists(rows, lists).select("path", "line_no", join_ids("commit_ids").alias("commits"))


@query("list_dictionary_counts", oracle=f"""
with {_ORACLE_WALK}, {_ULINES}
select 'lists' as fact, cast(count(*) as bigint) as n from (select distinct commits from final) x
union all select 'ids in lists', cast(sum(len(commits)) as bigint) from (select distinct commits from final) x
union all select 'ids in rows', cast(sum(len(commits)) as bigint) from final
union all select 'unfolded by line', cast(sum(len(commits)) as bigint) from ulines
union all select 'unfolded by list', cast(sum(len(commits)) as bigint) from (select distinct req_id, commits from ulines) x
""", views=("fx_hunks",))
def q_list_dictionary_counts(spark, sf_dir):
    """What the dictionary saves: commit ids stored with and without it, and rows that look-ups unfold by line and by list."""
    lines, rows, lists = _list_index(spark, sf_dir)
    lists = lists.select("list_id", F.size("commit_ids").alias("_n"))
    hits = ctx.lines_to_lists(lines, rows).join(lists, "list_id")
    total = F.sum("_n").cast("bigint").alias("n")
    parts = [("lists", lists.agg(F.count(F.lit(1)).alias("n"))), ("ids in lists", lists.agg(total)),
             ("ids in rows", rows.join(lists, "list_id").agg(total)), ("unfolded by line", hits.agg(total)),
             ("unfolded by list", hits.select("req_id", "list_id", "_n").distinct().agg(total))]
    out = [df.select(F.lit(name).alias("fact"), "n") for name, df in parts]
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


@query("related_files_mass_commit", oracle="""
with touch as (select distinct case when commit_id % 3 = 0 then 0 else commit_id end as commit_id, path from fx_touches),
hits as (select distinct l_suppkey as req_id, l_orderkey, case when l_orderkey % 3 = 0 then 0 else l_orderkey end as commit_id from lineitem),
mult as (select req_id, commit_id, count(*) as m from hits group by req_id, commit_id)
select req_id, path as related_path, cast(sum(m) as bigint) as occurrences from mult join touch using (commit_id) group by all
""", views=("fx_touches",))
def q_related_files_mass_commit(spark, sf_dir):
    """One commit with a third of all touches, in all requests: its files are joined in parts."""
    commit = F.when(F.col("commit_id") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("commit_id"))
    root = _scratch(spark, "touches")
    fx.view(spark, sf_dir, "fx_touches").withColumn("commit_id", commit).distinct().write.parquet(root)  # read several times, made once
    touches = spark.read.parquet(root)
    fx.register_tables(spark, sf_dir, ["lineitem"])
    hits = spark.sql("select distinct l_suppkey as req_id, l_orderkey, l_orderkey as commit_id from lineitem").withColumn("commit_id", commit)
    return ctx.related_files(hits, touches, ctx.mass_commits(touches, 1000))


_REPO_WALK = _ORACLE_WALK_T.replace("{src}", "(select repo || '/' || path as path, * exclude (path, repo) from fx_repo_hunks)")
_REPO_SPLIT = "split_part(path, '/', 1) as repo, split_part(path, '/', 2) as path"


@query("line_history_repos", oracle=f"""
with {_REPO_WALK} select {_REPO_SPLIT}, line_no, array_to_string(commits, ',') as commits from final
""", views=("fx_repo_hunks",))
def q_line_history_repos(spark, sf_dir):
    hist = lin.line_history(fx.view(spark, sf_dir, "fx_repo_hunks"))
    return hist.select("repo", "path", "line_no", join_ids("commit_ids").alias("commits"))


@query("build_index_repos", oracle=f"""
with {_REPO_WALK} select {_REPO_SPLIT}, line_no, array_to_string(commits, ',') as commits from final
""", views=("fx_repo_hunks",))
def q_build_index_repos(spark, sf_dir):
    """Two builds over two repositories with equal paths, read back by files."""
    h = fx.view(spark, sf_dir, "fx_repo_hunks")
    files = h.select("repo", "path").distinct()
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    for part in (h.where("seq <= 20"), h):
        jobs.build_index(spark, files, part, idx, wmd, n_buckets=8)
    wm = store.read_watermarks(spark, wmd, repo=True)
    return store.read_line_index(spark, idx, files, watermarks=wm) \
        .select("repo", "path", "line_no", join_ids("commit_ids").alias("commits"))


@query("query_context_repos", oracle=f"""
with {_REPO_WALK},
touch as (select distinct repo, path, commit_id from fx_repo_hunks),
reqs as (select min(commit_id) as req_id, repo, path from touch group by repo, path),
hits as (select r.req_id, r.repo, unnest(f.commits) as commit_id from reqs r join final f on f.path = r.repo || '/' || r.path and f.line_no between 3 and 30),
rel as (select h.req_id, h.repo, t.path as related_path, cast(count(*) as bigint) as occurrences
        from hits h join touch t on t.repo = h.repo and t.commit_id = h.commit_id group by all)
select * from (select *, cast(row_number() over (partition by req_id order by occurrences desc, related_path) as bigint) as rank from rel) x where rank <= 10
""", views=("fx_repo_hunks",))
def q_query_context_repos(spark, sf_dir):
    """Requests on stale files: the index holds each file up to its tenth hunk, the rest is folded in the plan."""
    h = fx.view(spark, sf_dir, "fx_repo_hunks")
    reqs = h.groupBy("repo", "path").agg(F.min("commit_id").alias("req_id")) \
        .withColumns({"start_line": F.lit(3), "end_line": F.lit(30)})
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    jobs.build_index(spark, reqs.where("req_id % 3 <> 0").select("repo", "path"), h.where("seq <= 10"), idx, wmd, n_buckets=8)
    wm = store.read_watermarks(spark, wmd, repo=True)
    index = store.read_line_index(spark, idx, reqs, watermarks=wm)
    return jobs.query_context(reqs, index, h.select("repo", "path", "commit_id").distinct(), hunks=h, watermarks=wm)


@query("index_clock_back", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_index_clock_back(spark, sf_dir):
    """The index is built up to seq 30; then the clock goes back ten minutes and the rest is built: the later write counts."""
    h = hunks_with_text(spark, sf_dir)
    files = h.select("path").distinct()
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    jobs.build_index(spark, files, h.where(F.col("seq") <= _SPLIT_SEQ), idx, wmd, n_buckets=8)
    back = F.localtimestamp() - F.expr("interval 10 minutes")
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=8, now=back)
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=8, now=back)  # all files are fresh
    return _lh_out(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd)))


@query("index_two_writers", oracle=f"""
with {_ORACLE_WALK}
select path, line_no, array_to_string(commits, ',') as commits from final
where cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 3 <> 2
""", views=("fx_hunks",))
def q_index_two_writers(spark, sf_dir):
    """Two writers build at once, from the same state: the first to claim has the history up to seq 30, the second all of it, for two
    thirds of the files each; the second publishes first.  Where both wrote, the later claim counts; files that only the first
    wrote are left out here."""
    h = hunks_with_text(spark, sf_dir)
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    number = F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 3
    one = h.where((number != 0) & (F.col("seq") <= _SPLIT_SEQ))
    two = h.where(number != 2)
    first, second = claims.claim_generation(spark, idx), claims.claim_generation(spark, idx)
    assert first < second
    jobs.publish(spark, lin.line_history(two), jobs.new_watermarks(two), idx, wmd, 8, second)
    jobs.publish(spark, lin.line_history(one), jobs.new_watermarks(one), idx, wmd, 16, first)
    back = store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd))
    return back.where(number != 2).select("path", "line_no", join_ids("commit_ids").alias("commits"))


@query("build_progress", oracle="""
with f as (select path, sum(new_count - old_count) as n, max(seq) as last, cast(regexp_extract(path, '([0-9]+)', 1) as bigint) % 3 as k from fx_hunks group by path),
s as (select *, case when k = 0 then 'never' when last > 30 then 'stale' else 'fresh' end as status from f)
select 'status ' || x.status as fact, cast(count(s.path) as bigint) as observed, cast(count(s.path) as bigint) as counted
from (select unnest(['fresh', 'stale', 'never', 'no_commits']) as status) x left join s on s.status = x.status group by x.status
union all select 'files', count(*), count(*) from s where status <> 'fresh'
union all select 'lines', cast(sum(n) as bigint), cast(sum(n) as bigint) from s where status <> 'fresh'
union all select 'lines written', cast(sum(n) as bigint), cast(sum(n) as bigint) from s where status <> 'fresh'
""", views=("fx_hunks",))
def q_build_progress(spark, sf_dir):
    """Two thirds of the files are indexed up to seq 30; then all are built in three waves.  What the jobs said on their way, and what the tables say."""
    h = hunks_with_text(spark, sf_dir)
    idx, wmd = _scratch(spark, "index"), _scratch(spark, "wm")
    old = F.regexp_extract("path", r"(\d+)", 1).cast("bigint") % 3 != 0
    files = h.select("path").distinct()
    jobs.build_index(spark, files.where(old), h.where(F.col("seq") <= _SPLIT_SEQ), idx, wmd, n_buckets=8)
    last = store.read_watermarks(spark, wmd).agg(F.max("generation")).first()[0]
    told = []
    jobs.build_index(spark, files, h, idx, wmd, n_buckets=8, waves=3, progress=told.append)
    observed = {f"status {x}": n for x, n in told[0]["status"].items()}
    observed |= {fact: sum(t[key] for t in told[1:]) for fact, key in (("files", "files"), ("lines", "lines"), ("lines written", "lines_written"))}
    log = store.read_watermarks(spark, wmd)
    new = log.where(F.col("generation") > last)
    before = stt.index_status(files, stt.latest_commit(h.select("path", "commit_id", "seq"), order="seq"), stt.last_indexed(log.where(F.col("generation") <= last)))
    known = spark.createDataFrame([(s, f"status {s}") for s in stt.STATUSES], "status string, fact string")
    counted = known.join(before, "status", "left").groupBy("fact").agg(F.count("path").alias("counted")) \
        .union(new.agg(F.lit("files"), F.count(F.lit(1)))).union(new.agg(F.lit("lines"), F.sum("n_lines"))) \
        .union(store.read_line_index(spark, idx, watermarks=new).agg(F.lit("lines written"), F.count(F.lit(1))))
    return spark.createDataFrame(list(observed.items()), "fact string, observed long").join(counted, "fact").select("fact", "observed", "counted")


@query("stream_progress", oracle="""
with b as (select 'hunks' as fact, cast(count(*) as bigint) as n from fx_hunks
 union all select 'files', sum(c) from (select count(distinct path) as c from fx_hunks where seq <= 30 union all select count(distinct path) from fx_hunks where seq > 30) x
 union all select 'lines', cast(sum(n) as bigint) from (select sum(new_count - old_count) as n from fx_hunks where seq <= 30
   union all select sum(new_count - old_count) from fx_hunks where path in (select path from fx_hunks where seq > 30)) y)
select fact, cast(n as bigint) as observed, cast(n as bigint) as counted from b
""", views=("fx_hunks",))
def q_stream_progress(spark, sf_dir):
    """What a stream observes of its two micro-batches, and what the landed hunks and the log come to."""
    from .streaming.index_stream import stream_index
    h = hunks_with_text(spark, sf_dir)
    land, idx, wmd, ck = (_scratch(spark, w) for w in ("hunks", "index", "wm", "stream"))
    told, landed = [], 0
    for part in (h.where(F.col("seq") <= _SPLIT_SEQ), h.where(F.col("seq") > _SPLIT_SEQ)):
        part.write.mode("append").parquet(land)
        q = stream_index(spark, land, h.schema, idx, wmd, ck, n_buckets=8, progress=told.append)
        q.awaitTermination()
        landed += sum(p["observedMetrics"]["landed"]["hunks"] for p in q.recentProgress if "landed" in p["observedMetrics"])
    observed = {"hunks": landed, "files": sum(t["files"] for t in told), "lines": sum(t["lines"] for t in told)}
    log = store.read_watermarks(spark, wmd)
    counted = spark.read.parquet(land).agg(F.lit("hunks").alias("fact"), F.count(F.lit(1)).alias("counted")) \
        .union(log.agg(F.lit("files"), F.count(F.lit(1)))).union(log.agg(F.lit("lines"), F.sum("n_lines")))
    return spark.createDataFrame(list(observed.items()), "fact string, observed long").join(counted, "fact").select("fact", "observed", "counted")


@query("stream_bucket_change", oracle=f"with {_ORACLE_WALK} {_LH_OUT}", views=("fx_hunks",))
def q_stream_bucket_change(spark, sf_dir):
    """A stream goes on with 32 buckets after 8; what lands then has late hunks, so files are rebuilt from all that the store has."""
    from .streaming.index_stream import stream_index
    h = hunks_with_text(spark, sf_dir)
    land, idx, wmd, ck = (_scratch(spark, w) for w in ("hunks", "index", "wm", "stream"))
    late = F.col("seq") % 7 == 3
    for part, n in ((h.where((F.col("seq") <= _SPLIT_SEQ) & ~late), 8), (h.where((F.col("seq") > _SPLIT_SEQ) | late), 32)):
        part.write.mode("append").parquet(land)
        stream_index(spark, land, h.schema, idx, wmd, ck, n_buckets=n).awaitTermination()
    return _lh_out(store.read_line_index(spark, idx, watermarks=store.read_watermarks(spark, wmd)))


# --------------------------------------------------------------------------
# Broken histories, the order of ordered rows, combined diffs
# --------------------------------------------------------------------------


@query("history_checks_broken", oracle="""
with g as (select path, line_no, list(commit_id) as c from fx_line_commits group by path, line_no),
b as (select path, cast(line_no / 3 as bigint) as line_no, case when line_no = 9 and length(path) % 2 = 0 then 0 else len(c) end as n from g
      where not (line_no = 6 and path like '%1.rs')
      union all select path, 4, 1 from g where line_no = 3 and path like '%2.rs')
select path, cast(count(*) as bigint) as n_lines, min(line_no) as min_line, max(line_no) as max_line,
       cast(sum(case when n = 0 then 1 else 0 end) as bigint) as n_empty,
       count(*) = count(distinct line_no) and min(line_no) = 1 and max(line_no) = count(*) and sum(case when n = 0 then 1 else 0 end) = 0 as ok
from b group by path
""", views=("fx_line_commits",))
def q_history_checks_broken(spark, sf_dir):
    """Histories with a missing line, a line that is there twice, a line without commits, and sound ones."""
    h = lin.collect_history(fx.view(spark, sf_dir, "fx_line_commits"))
    twice = h.where("line_no = 3 and path like '%2.rs'").withColumns({"line_no": F.lit(4).cast("bigint"), "commit_ids": F.slice("commit_ids", 1, 1)})
    h = h.where("not (line_no = 6 and path like '%1.rs')").withColumn(
        "commit_ids", F.when((F.col("line_no") == 9) & (F.length("path") % 2 == 0), F.array().cast("array<bigint>")).otherwise(F.col("commit_ids")))
    return lin.history_checks(h.withColumn("line_no", (F.col("line_no") / 3).cast("bigint")).unionByName(twice))


@query("ordered_history_order", oracle="""
select path, cast(count(distinct line_no) as bigint) as n_lines, cast(0 as bigint) as n_out_of_order from fx_line_commits group by path
""", views=("fx_line_commits",))
def q_ordered_history_order(spark, sf_dir):
    """Rows that come before a smaller row of their file, in the order that ordered_history gives."""
    from pyspark.sql import Window
    h = lin.ordered_history(lin.collect_history(fx.view(spark, sf_dir, "fx_line_commits"))).withColumn("_at", F.monotonically_increasing_id())
    before = F.lag("line_no").over(Window.partitionBy("path").orderBy("_at"))
    return h.withColumn("_b", before).groupBy("path").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.when(F.col("_b") > F.col("line_no"), 1).otherwise(0)).cast("bigint").alias("n_out_of_order"))


@query("drop_merge_diffs", oracle="""
select path, commit_id, cast(2 + new_count as bigint) as n_kept from fx_hunks
""", views=("fx_hunks",))
def q_drop_merge_diffs(spark, sf_dir):
    """Diff lines with a combined part at the end of every diff, kept up to it."""
    h = fx.view(spark, sf_dir, "fx_hunks")
    plus = F.array_repeat(F.lit("+x"), F.col("new_count").cast("int"))
    d = h.select("path", "commit_id", F.concat(F.lit("--- a\n@@ -1 +1 @@"), F.when(F.col("new_count") > 0, F.lit("\n")).otherwise(F.lit("")),
                                               F.array_join(plus, "\n"), F.lit("\n@@@ -1 -1 +1 @@@\n++y\n@@ -1 +1 @@\n+z")).alias("diff"))
    return lin.drop_merge_diffs(src.diff_lines(d)).groupBy("path", "commit_id").agg(F.count(F.lit(1)).alias("n_kept"))
