"""Every registered query of the library itself against its independent DuckDB SQL (the driver's gate)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_mod
from tests.conftest import SF_ORACLE, SF_SMALL
from churnlens.plans.catalog import registry
from churnlens.plans.oracle import ORACLE_SQL as ORACLE
from churnlens.plans.oracle_check import compare, duck

QUERIES = registry()


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


def test_a_broken_corpus_import_is_not_swallowed(monkeypatch):
    import builtins
    real = builtins.__import__

    def failing(name, *args, **kwargs):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("no such module", name=missing)
        return real(name, *args, **kwargs)
    monkeypatch.setattr(builtins, "__import__", failing)
    for missing in ("corpus_pipeline", "churnlens.llm"):
        assert set(entry_mod.queries()) == set(QUERIES)
    missing = "churnlens.llm.qualty"
    with pytest.raises(ModuleNotFoundError):
        entry_mod.queries()


@pytest.fixture(scope="module")
def cons():
    return {SF_SMALL: duck(SF_SMALL), SF_ORACLE: duck(SF_ORACLE)}


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_ORACLE])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, cons, name, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    ok, why = compare(df, cons[sf_dir], ORACLE[name])
    assert ok, f"{name} @ {sf_dir}: {why}"


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert df.columns == ["total_customers", "total_churned", "total_active",
                          "churn_rate_pct", "retention_rate_pct"]
    assert rows[0]["total_customers"] == 150 and rows[0]["total_churned"] == 49
