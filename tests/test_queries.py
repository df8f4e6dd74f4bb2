"""Every registered query against its DuckDB SQL on the smallest tables."""

import pytest
from compare import compare, duck

import __spark_entry__ as entry
from footlamp.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    result = compare(spark, con, name, SF)
    assert result["ok"], result["note"]
    assert not result["note"].startswith("types"), result["note"]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
