"""Every registered query against its DuckDB SQL on the smallest driver tables."""
import os

import pytest

from rivulet.plans.catalog import QUERIES
from rivulet.plans.oracle import oracle_sql
from rivulet.plans.verify import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver tables not present")


def test_every_query_has_an_oracle():
    assert set(oracle_sql()) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF, [name], verbose=False)[name]
    assert res["cols_match"], res
    assert res["spark_rows"] == res["duck_rows"], res
    assert res["hash_match"], res


def test_entry_smoke(spark):
    import __spark_entry__ as e
    df = e.entry(spark)
    assert df.count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(QUERIES) <= set(e.oracle_sql()) <= set(e.queries())
