"""Every query of the plans against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from packetloom import plans

from .oracle import connect, differences


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: Beyond SQL; each has a test of its own against brute force.
NO_SQL = {"boosted_predictions"}


def test_every_query_has_sql():
    assert set(plans.QUERIES) == set(plans.ORACLES) | NO_SQL
    assert set(plans.QUERIES) <= set(entry.queries()) and set(plans.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query(spark, sf_dir, con, name):
    assert differences(plans.QUERIES[name](spark, sf_dir), plans.ORACLES[name], con) == ""


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 13 and sum(r["share"] for r in rows) == pytest.approx(1.0, abs=1e-4)
