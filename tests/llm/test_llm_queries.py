import compare
import pytest

from recuento.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", QUERIES, ids=lambda q: q.name)
def test_query(spark, query):
    rows = compare.spark_rows(query.run(spark, SF))
    assert rows[1]
    if query.sql:
        assert compare.difference(rows, compare.sql_rows(compare.connect(SF), query.sql)) is None
