"""Every SQL query gives DuckDB's rows."""

import pytest

from tests import oracle
from tidemark.functions.ratios import FACTORS, RATIOS
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_oracle(spark, con, name):
    oracle.assert_same(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name])


def test_registry_is_whole():
    assert len(RATIOS) == 29
    assert abs(sum(f[1] for f in FACTORS) - 1) < 1e-9
