"""Every core query with SQL gives the same rows as DuckDB; every other one runs and gives a stable schema."""

from pathlib import Path

import compare
import pytest
from gavel.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name not in SQL:
        assert df.columns and df.count() >= 0
        return
    names, got, _ = compare.rows_of_spark(df)
    sql_names, want, _ = compare.rows_of_sql(compare.connect(FOLDER), SQL[name])
    assert names == sql_names
    assert got == want


def test_every_query_is_documented():
    for name, run in catalog.queries().items():
        assert run.__doc__, name
