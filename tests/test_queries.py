"""Some registered queries against their SQL, over the smallest tables where they are there."""

import glob
import os

import pytest

import __spark_entry__

FOLDER = "/root/testdata/sf0.001"


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", ["scan_objects", "c_xf3", "c_ratio_tc", "c_areas", "sink_diff_text"])
def test_query_is_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(found.columns)
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == columns
    rows = lambda picked: sorted(repr(tuple(plain(v) for v in r)) for r in picked)
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert rows(found.select(*columns).collect()) == rows(want.project(quoted).fetchall())


def test_every_query_has_sql_or_says_why():
    """Grid queries without SQL: the stack rule on tags that don't balance."""
    from gridweft.queries import ORACLE_SQL, QUERIES

    assert set(QUERIES) - set(ORACLE_SQL) == {"scan_close_index"}
