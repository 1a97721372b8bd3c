import pytest

from selvedge.llm import queries
from tests.compare import database, rows, sql_rows

FOUND = {
    "p1_found": ["field", "kind", "msg", "row_index", "start_pos", "tbl"],
    "p2_found": ["defect", "field", "row_index", "tbl"],
    "p3_found": ["copy_id", "keep_id", "tbl"],
    "p4_found": ["field", "row_index", "tbl"],
    "p6_found": ["id_a", "id_b"],
    "p7_found": ["id_a", "id_b", "tbl"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf, name):
    columns, got = rows(queries.queries()[name](spark, sf))
    sql = queries.oracle_sql().get(name)
    if sql:
        assert (columns, got) == sql_rows(database(sf), sql)
    if name in FOUND:
        assert columns == FOUND[name] and len(got) == len(set(got))
