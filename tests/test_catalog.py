import pytest

from tallyloom.plans import catalog
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, sf_dir, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE[name], sf_dir)
