"""The queries that have SQL, and all queries on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tesserae.llm import queries as Q

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, name):
    df = Q.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    assert got or name in ("p5_found",)
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for f in DATA.iterdir():
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        result = con.execute(Q.oracle_sql()[name])
        names = [d[0] for d in result.description]
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
