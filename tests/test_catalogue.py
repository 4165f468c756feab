"""Every query of the catalogue against its SQL in DuckDB, over whole small tables."""

import glob
import math
import os

import duckdb
import pytest

from cartulary import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    rows = catalogue.queries()[name](spark, SF)
    columns = sorted(rows.columns)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows.collect()) == want


def test_every_query_has_sql_but_the_stream():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"q38_stream_classify"}
