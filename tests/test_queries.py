"""Every table query against its SQL."""

import importlib
from pathlib import Path

import pytest

from compare import differences, duck
from ratewell import scale
from ratewell.operators import rates
from ratewell.table_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
PLATE_QUERIES = {"kinetic_rates", "screen_fold_change", "kinetic_from_sheets", "stability_rates"}
driver = importlib.import_module("__spark_entry__")
NAMES = sorted(QUERIES)

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables absent")


@pytest.fixture(scope="module")
def database():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    assert differences(driver.queries()[name](spark, FOLDER), database.sql(driver.oracle_sql()[name])) == []


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(NAMES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_when_everything_is_heavy(spark, database, monkeypatch, name):
    """All groups above 20 rows count as heavy and no table may be broadcast by size."""
    monkeypatch.setattr(scale, "GROUP_ROWS", 64 * 20 if name in PLATE_QUERIES else 20)
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(rates, "CHUNK_ROWS", 25)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert differences(driver.queries()[name](spark, FOLDER), database.sql(driver.oracle_sql()[name])) == []
    finally:
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
