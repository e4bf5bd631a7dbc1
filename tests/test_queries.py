"""Every registered query against its SQL twin, and the contract of the entry module."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_module
from fieldtally.catalog import ORACLES, QUERIES

from .compare import compare, oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    problems = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert not problems, "\n".join(problems)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
