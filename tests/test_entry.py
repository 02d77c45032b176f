"""The entry points, and a few queries against their SQL; compare.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canon

DIR = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def check(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(tuple(canon(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(canon(r[c]) for c in cols) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["findings_capped", "suppressed_findings", "file_suppressions", "baseline_report", "check_runs", "score_excluding_fp", "group_validated", "merge_precedence", "plan_latest", *[f"rule_{k}" for k in ("unsafe_io", "silent_error", "global_mutation", "no_caching", "mixed_response_shapes", "data_shape_assumption", "async_misuse")]])
def test_query_equals_sql(spark, name):
    check(spark, name)
