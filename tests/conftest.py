import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from netfabric.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(master="local[4]", app="netfabric-tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def at():
    """``at("2026-06-05 12:00:00")`` as an aware UTC datetime."""
    return lambda s: datetime.fromisoformat(s).replace(tzinfo=timezone.utc)


@pytest.fixture(scope="session")
def snap(spark, at):
    """A snapshot table from ``(provider, device, command, body[, truncated])`` tuples."""
    def make(*rows):
        data = [(r[0], r[1], r[2], at("2026-06-05 12:00:00"), r[4] if len(r) > 4 else False, r[3]) for r in rows]
        return spark.createDataFrame(
            data, "provider string, device string, command string, collected_at timestamp, truncated boolean, body string"
        )
    return make
