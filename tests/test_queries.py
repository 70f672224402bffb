"""The catalogue against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from streetloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    expected, got = db.sql(catalogue.ORACLES[name]).df(), catalogue.QUERIES[name](spark, DATA).toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got[list(expected.columns)]) == rows(expected)


def test_edge_names_has_every_edge(spark, tmp_path):
    """All edges of a nation have names, in the query and in its SQL, however many there are."""
    db = duckdb.connect()
    db.execute(f"copy (select range as s_suppkey, cast(range % 2 as int) as s_nationkey, cast(range * range % 70 as double) as s_acctbal from range(40)) to '{tmp_path}/supplier.parquet'")
    db.execute(f"copy (select range as c_custkey, cast(range % 3 as int) as c_nationkey, cast(range * 37 % 101 as double) as c_acctbal from range(90)) to '{tmp_path}/customer.parquet'")
    for name in ("supplier", "customer"):
        db.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    got = catalogue.QUERIES["edge_names"](spark, str(tmp_path)).toPandas()
    assert sorted(zip(got["eid"], got["k"], strict=True)) == sorted((k % 2, k) for k in range(38))
    assert rows(got) == rows(db.sql(catalogue.ORACLES["edge_names"]).df())


def test_entry_imports_and_lists_all_queries():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert set(catalogue.QUERIES) <= set(found)
    assert set(__spark_entry__.oracle_sql()) <= set(found)
