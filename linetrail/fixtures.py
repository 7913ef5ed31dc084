"""Test views: the driver tables projected onto the history schemas.

Each view is one SQL text that runs unchanged in Spark SQL and in DuckDB.
The Spark side registers it as a temporary view over the parquet files;
the DuckDB oracle inlines the same text as a CTE.  The views only rename
and reshape the given tables, so their size grows with the scale factor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")

_PART_PATH = ("concat('src/', lower(p_type), '/', lower(replace(p_brand, '#', '')), "
              "'/p', cast(p_partkey as string), '.rs')")

VIEWS: dict[str, str] = {
    "fx_commits": """
select o_orderkey as commit_id, lpad(cast(o_orderkey as string), 7, '0') as commit_hash,
       c_name as author, o_orderdate as commit_ts, o_orderpriority as title
from orders join customer on o_custkey = c_custkey
""",
    "fx_files": f"""
select {_PART_PATH} as path,
       p_size as n_lines
from part
""",
    "fx_touches": f"""
select distinct l_orderkey as commit_id,
       {_PART_PATH} as path
from lineitem join part on l_partkey = p_partkey
""",
    "fx_line_commits": """
select distinct concat('s', cast(l_suppkey as string), '.rs') as path,
       l_linenumber * 3 as line_no, l_orderkey as commit_id
from lineitem
""",
    "fx_requests": """
select s_suppkey as req_id, concat('s', cast(s_suppkey as string), '.rs') as path,
       s_suppkey % 20 as start_line,
       case when s_suppkey % 10 = 0 then 0 else s_suppkey % 20 + s_suppkey % 7 end as end_line
from supplier
""",
    "fx_hunks": """
select concat('u', cast(user_id as string), '.rs') as path, event_id as commit_id, cast(seq as bigint) as seq,
       case when seq = 1 then 1 when nc0 = 0 then p0 - 1 else p0 end as new_start,
       case when seq = 1 then 0 else oc0 end as old_count,
       case when seq = 1 then 200 else nc0 end as new_count
from (select user_id, event_id,
             row_number() over (partition by user_id order by ts, event_id) as seq,
             1 + (event_id * 31) % 20 as p0, event_id % 3 as oc0, (event_id * 7) % 5 as nc0
      from events) t
where seq = 1 or oc0 + nc0 > 0
""",
    "fx_snapshots": """
select source as path, doc_id as version, text from documents
""",
    "fx_messages": """
select conv_id, turn,
       concat(text, chr(10), chr(10), '--AUTHOR--', chr(10), role, chr(10), '--DATE--', chr(10),
              'Mon Jan ', cast(1 + (conv_id + turn) % 28 as string), ' 10:00:0', cast(turn % 10 as string), ' 2024', chr(10)) as raw
from conversations
""",
    "fx_watermarks": """
select concat('u', cast(user_id as string), '.rs') as path, event_id as commit_id, ts as indexed_ts
from events where event_type = 'purchase' and user_id % 5 <> 0
""",
    "fx_blame": """
select path, line_no, min(commit_id) as commit_id
from (select distinct concat('s', cast(l_suppkey as string), '.rs') as path,
             l_linenumber * 3 as line_no, l_orderkey as commit_id
      from lineitem) t
group by path, line_no
""",
    # Blame that names an unknown commit on some lines.
    "fx_blame_off": """
select path, line_no, case when line_no = 18 then commit_id + 100000000 else commit_id end as commit_id
from (select path, line_no, min(commit_id) as commit_id
      from (select distinct concat('s', cast(l_suppkey as string), '.rs') as path,
                   l_linenumber * 3 as line_no, l_orderkey as commit_id
            from lineitem) t
      group by path, line_no) b
""",
    # Hunks of two repositories that use the same paths.
    "fx_repo_hunks": """
select case when user_id % 2 = 0 then 'even' else 'odd' end as repo,
       concat('u', cast(cast(floor(user_id / 2) as bigint) as string), '.rs') as path, event_id as commit_id, cast(seq as bigint) as seq,
       case when seq = 1 then 1 when nc0 = 0 then p0 - 1 else p0 end as new_start,
       case when seq = 1 then 0 else oc0 end as old_count,
       case when seq = 1 then 40 + user_id % 7 else nc0 end as new_count
from (select user_id, event_id,
             row_number() over (partition by user_id order by ts, event_id) as seq,
             1 + (event_id * 31) % 20 as p0, event_id % 3 as oc0, event_id % 3 + event_id % 2 as nc0
      from events) t
where seq = 1 or oc0 + nc0 > 0
""",
    # Files that are emptied by their third hunk and, but for every third of them, filled again by the fourth.
    "fx_emptied_hunks": """
select concat('e', cast(user_id as string), '.rs') as path, event_id as commit_id, cast(seq as bigint) as seq,
       case when seq = 3 then 0 when seq = 2 then 2 else 1 end as new_start,
       case when seq = 1 then 0 when seq = 2 then 1 when seq = 3 then 6 + user_id % 3 else 0 end as old_count,
       case when seq = 1 then 5 + user_id % 3 when seq = 2 then 2 when seq = 3 then 0 else 1 + user_id % 4 end as new_count
from (select user_id, event_id, row_number() over (partition by user_id order by ts, event_id) as seq from events) t
where seq <= case when user_id % 3 = 0 then 3 else 4 end
""",
    # Patterns in all forms; live, ignore, dirs and rx say what each means.
    "fx_ignore_rules": """
select rule_no, replace(pattern0, '{BS}', chr(92)) as pattern, negated, dir_only, live, ignore, dirs, rx from (values
  (1, '*.log', false, false, true, true, false, '^(.*/)?[^/]*[.]log$'),
  (2, 'src/small/', false, false, true, true, true, '^src/small$'),
  (3, 'src/*/brand1', false, false, true, true, false, '^src/[^/]*/brand1$'),
  (4, 'src/promo/brand1', true, false, true, false, false, '^src/promo/brand1$'),
  (5, 'p1*.rs   ', false, false, true, true, false, '^(.*/)?p1[^/]*[.]rs$'),
  (6, '# p*.rs', false, false, false, true, false, 'x'),
  (7, 'p2[0-4]?.rs', false, false, true, true, false, '^(.*/)?p2[0-4][^/][.]rs$'),
  (8, '!p21[!5-9].rs', false, false, true, false, false, '^(.*/)?p21[^5-9/][.]rs$'),
  (9, 'p4{BS}*.rs', false, false, true, true, false, '^(.*/)?p4[*][.]rs$'),
  (10, '{BS}#p*.rs', false, false, true, true, false, '^(.*/)?[#]p[^/]*[.]rs$'),
  (11, 'src/eco*/**/p3?.rs', false, false, true, true, false, '^src/eco[^/]*/(.*/)?p3[^/][.]rs$'),
  (12, 'brand2', false, true, true, true, true, '^(.*/)?brand2$'),
  (13, 'p5.rs', false, true, true, true, true, '^(.*/)?p5[.]rs$'))
  as t(rule_no, pattern0, negated, dir_only, live, ignore, dirs, rx)
""",
    "fx_similar_lines": """
select l_orderkey as hunk_id, case when l_linenumber % 2 = 1 then 'deleted' else 'added' end as side,
       l_linenumber as line_id, p_name as content
from lineitem join part on l_partkey = p_partkey
""",
}


# Driver tables each view reads.
VIEW_TABLES = {
    "fx_commits": ("orders", "customer"), "fx_files": ("part",), "fx_touches": ("lineitem", "part"),
    "fx_line_commits": ("lineitem",), "fx_requests": ("supplier",), "fx_hunks": ("events",),
    "fx_snapshots": ("documents",), "fx_messages": ("conversations",), "fx_watermarks": ("events",),
    "fx_blame": ("lineitem",), "fx_blame_off": ("lineitem",), "fx_repo_hunks": ("events",), "fx_emptied_hunks": ("events",),
    "fx_ignore_rules": (), "fx_similar_lines": ("lineitem", "part"),
}


def register_tables(spark: SparkSession, sf_dir: str, names=BASE_TABLES) -> None:
    """Register driver parquet tables as temporary views of the same name."""
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One fixture view as a DataFrame over the parquet files of ``sf_dir``."""
    register_tables(spark, sf_dir, VIEW_TABLES[name])
    return spark.sql(VIEWS[name])


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views as CTEs (for the DuckDB oracle)."""
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in names)
    body = sql.strip()
    if body[:5].lower() == "with ":
        rest = body[5:].lstrip()
        if rest[:10].lower() == "recursive ":
            return f"with recursive {ctes},\n{rest[10:]}"
        return f"with {ctes},\n{rest}"
    return f"with {ctes}\n{body}"
