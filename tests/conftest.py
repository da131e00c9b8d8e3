"""Shared fixtures: one local session, frame builders and row comparison."""

from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402

START = dt.datetime(2025, 1, 1)


def hours(n: float) -> dt.datetime:
    """A moment n hours after the fixed start."""
    return START + dt.timedelta(hours=n)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """Build a frame whose rows arrive in scattered order over several partitions."""

    def build(schema: str, rows: list[tuple]):
        return spark.createDataFrame(rows, schema).repartition(7)

    return build


def rows_of(df, *names):
    """All rows as a sorted list of tuples (of the named columns)."""
    picked = df.select(*[f"`{n}`" for n in names]) if names else df
    rows = [tuple(r) for r in picked.collect()]
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)) if v is None else v) for v in r))
