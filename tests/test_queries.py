"""Every registered query of the core matches its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from quillframe.plans import coverage, queries  # noqa: F401
from quillframe.plans import registry as core

SF = "/root/testdata/sf0.001"
SLOW = ("filter_null_table", "infer_types")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(SLOW)))
def test_oracle(spark, con, name):
    want = con.sql(core.ORACLES[name])
    columns = sorted(want.columns)
    got = core.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    rows = got.select(*[f"`{c}`" for c in columns]).collect()
    picked = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({core.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, picked))


def test_contract(spark):
    assert len(core.QUERIES) >= 130 and set(core.QUERIES) == set(core.ORACLES)
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
    assert __spark_entry__.entry(spark).count() == 20
