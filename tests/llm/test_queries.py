from pathlib import Path

import duckdb
import pytest

from marlspike.llm import queries as q
from verify import _rows

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="test data absent")
@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, name):
    df = q.QUERIES[name](spark, DATA)
    got = _rows(df.columns, df.collect())
    if name in q.ORACLE:
        db = duckdb.connect()
        for f in Path(DATA).glob("*.parquet"):
            db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
        result = db.execute(q.ORACLE[name])
        columns = [c[0] for c in result.description]
        assert got == _rows(columns, result.fetchall())
