"""Every query with SQL gives the rows of its SQL in DuckDB over the smallest tables; the others give rows."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
duckdb = pytest.importorskip("duckdb")
import compare  # noqa: E402

from stratalog.plans import problems, store  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
QUERIES = store.R.queries | problems.R.queries
SQL = store.R.sql | problems.R.sql


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    compare.views(c, SF)
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = compare.rows(df.columns, [tuple(x.asDict(True).values()) for x in df.collect()])
    if name not in SQL:
        assert got
        return
    rel = con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == compare.rows(rel.columns, rel.fetchall())
