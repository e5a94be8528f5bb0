"""The corpus queries with SQL against it, and none without SQL or a plain version."""

from __future__ import annotations

import pytest

from churnlens.llm.oracle import ORACLE_SQL
from churnlens.llm.queries import QUERIES
from churnlens.plans.oracle_check import compare, duck
from tests.conftest import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_ORACLE: duck(SF_ORACLE)}


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_ORACLE])
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, cons, name, sf_dir):
    ok, why = compare(QUERIES[name](spark, sf_dir), cons[sf_dir], ORACLE_SQL[name])
    assert ok, f"{name} @ {sf_dir}: {why}"
