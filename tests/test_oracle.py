"""Every registered query of the burst engine against its SQL."""

import glob
import os

import duckdb
import pytest

from pulsegrid.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(repr(r) for r in duck.sql(f"SELECT {names} FROM ({ORACLE_SQL[name]})").fetchall())
    assert got == want


def test_acceptance_numbers(spark):
    from pyspark.sql import functions as F

    from pulsegrid.queries import CFG, found, read

    rows = read(spark, DATA)
    assert tuple(rows.agg(F.count("*"), F.count_if(F.col("observed") < CFG.gate), F.count_if(F.col("status") == "flat"), F.count_if(F.col("intensity") >= CFG.k)).first()) == (3823, 411, 0, 108)
    assert found(spark, DATA).count() == 50
