"""Every core query runs on the smallest tables, and agrees with its oracle where it has one."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from verify import _rows

DATA = "/root/testdata/sf0.001"
CORE = {k: f for m in entry._modules() if not m.__name__.startswith("marlspike.llm") for k, f in m.QUERIES.items()}
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["base_account", "activity_day"]


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data absent")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, db, name):
    df = CORE[name](spark, DATA)
    got = _rows(df.columns, df.collect())
    if name in ORACLE:
        result = db.execute(ORACLE[name])
        columns = [c[0] for c in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert got == _rows(columns, result.fetchall())
