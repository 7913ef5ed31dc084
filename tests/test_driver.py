"""The driver contract: entry() runs, and every registered query equals its
DuckDB oracle on the smallest scale factor."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from linetrail.fixtures import BASE_TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) == {"req_id", "related_path", "occurrences", "rank"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def _norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and v == int(v):
                v = int(v)
            vals.append("NULL" if v is None else str(v))
        out.append("|".join(vals))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_cols)
    assert _norm(s_rows, df.columns) == _norm(d_rows, d_cols)


def test_histories_read_several_times_are_traced_once(spark, monkeypatch, tmpdir_path):
    """What reads a history more than once reads it from a written table."""
    import datetime
    from linetrail import queries as q
    rows = [(u * 100 + i, u, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), "view") for u in range(3) for i in range(50)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string").write.parquet(tmpdir_path + "/events.parquet")
    bases, heads, line_history, list_dictionary = [], [], q.lin.line_history, q.lin.list_dictionary

    def traced(hunks, base=None, **kw):
        bases.append(base)
        return line_history(hunks, base=base, **kw)

    def taken_apart(history):
        heads.append(history)
        return list_dictionary(history)
    monkeypatch.setattr(q.lin, "line_history", traced)
    monkeypatch.setattr(q.lin, "list_dictionary", taken_apart)
    assert q.QUERIES["line_history_generations"](spark, tmpdir_path).count() > 0
    q._list_index(spark, tmpdir_path)
    for df in [b for b in bases if b is not None] + heads:
        assert "MapInArrow" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert len(bases) == 4 and len(heads) == 1
