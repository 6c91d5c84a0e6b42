"""The named queries on the smallest tables: exact columns, and SQL where there is some."""

from pathlib import Path

import compare
import pytest

queries = pytest.importorskip("gavel.llm.queries")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
COLUMNS = {
    "p1_found": ["query_kind", "query_id", "tag_id"], "p3_found": ["field", "record_id"], "p4_found": ["first_id", "turn_id"], "p5_found": ["debate_id", "seq_start", "seq_end"],
    "p6_found": ["kind", "record_id", "group_tag_id"], "p7_found": ["field", "record_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, FOLDER)
    assert df.columns == COLUMNS.get(name, df.columns)
    sql = queries.oracle_sql().get(name)
    if sql is None:
        got = [tuple(map(str, r)) for r in df.collect()]
        assert not name.endswith("_found") or len(set(got)) == len(got) > 0
        return
    names, got, _ = compare.rows_of_spark(df)
    sql_names, want, _ = compare.rows_of_sql(compare.connect(FOLDER), sql)
    assert (names, got) == (sql_names, want)
