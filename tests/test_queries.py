"""Every registered core query against DuckDB on whole tables."""

import math
from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest
from tidewell import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, datetime | date):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    if isinstance(value, bytes | bytearray):
        return bytes(value).hex()
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(([plain(r[k]) for k in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_equals_duckdb(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    got = table(df.columns, df.collect())
    found = duck.execute(core.ORACLE_SQL[name])
    want = table([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_each_query_has_sql():
    assert set(core.QUERIES) == set(core.ORACLE_SQL)
