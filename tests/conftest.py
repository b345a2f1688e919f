from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kindred.session import local_session

    settings = {
        "spark.sql.shuffle.partitions": "4",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
    }
    session = local_session(8, "8g", settings)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def baskets(spark):
    """Four users; one row is given twice."""
    rows = [(1, 10), (1, 20), (1, 30), (2, 10), (2, 20), (3, 20), (3, 30), (4, 10), (4, 10)]
    return spark.createDataFrame(
        [("CH-1", user, item, "view") for user, item in rows],
        "channel_id string, user_id bigint, item_id bigint, action string",
    )


@pytest.fixture(scope="session")
def ratings(spark):
    rows = [
        (1, 10, 5), (1, 20, 3), (1, 30, 1), (2, 10, 4), (2, 20, 2),
        (3, 20, 5), (3, 30, 5), (5, 10, 2), (5, 20, 5), (5, 30, 4),
    ]
    return spark.createDataFrame(
        [("CH-1", user, item, "rating", float(rating)) for user, item, rating in rows],
        "channel_id string, user_id bigint, item_id bigint, action string, rating double",
    )


def scores(frame, value="score"):
    return {(r["item_id"], r["other_id"]): r[value] for r in frame.collect()}
