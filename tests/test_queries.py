import os

import pytest

from duck_rows import compare
from nestlake import record_queries  # noqa: F401 - registers its queries
from nestlake.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        compare(df, ORACLE[name], SF)
    else:
        assert df.columns and df.count() >= 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
