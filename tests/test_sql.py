"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
import check

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(entry_points.REGISTERED)


@pytest.fixture(scope="module")
def db():
    return check.connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    ours = entry_points.queries()[name](spark, SF_DIR).toPandas()
    sql = entry_points.oracle_sql().get(name)
    assert len(ours) > 0
    if sql:
        assert check.difference(ours, db.sql(sql).df()) is None


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == ["item_id", "other_id", "score", "rank"]
    assert frame.limit(1).count() == 1
