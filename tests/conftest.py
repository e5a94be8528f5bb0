"""Shared fixtures: one local session for the whole run, the table bundles."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from churnlens.plans.catalog import TableCache  # noqa: E402
from churnlens.plans.tables import ChurnTables  # noqa: E402
from churnlens.schemas import WIDE_SCHEMA  # noqa: E402
from churnlens.session import build_session, checkpoint_root  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session(app_name="churnlens-tests", master="local[4]", shuffle_partitions=8)
    # uses spark.checkpoint.dir when the environment sets it; a temporary folder otherwise
    checkpoint_root(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def cache():
    return TableCache(materialize=True)


@pytest.fixture(scope="session")
def small_tables(spark, cache):
    return cache.get(spark, SF_SMALL)


@pytest.fixture()
def make_tables(spark):
    """Build a table bundle from hand-written wide rows (dicts; missing keys -> NULL)."""
    def build(rows: list[dict]) -> ChurnTables:
        names = [f.name for f in WIDE_SCHEMA.fields]
        data = [tuple(r.get(n) for n in names) for r in rows]
        return ChurnTables.from_wide(spark.createDataFrame(data, WIDE_SCHEMA))
    return build
