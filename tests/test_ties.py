"""Queries and their SQL twins where a sum or a rounding falls on an edge."""

import datetime as dt

import pytest

import __spark_entry__ as contract
from check_oracle import difference

MONDAY = dt.datetime(2025, 1, 6)
SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def compared(spark, folder, name, events):
    """What differs between a query and its SQL over events of (user, hour, type, value)."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, MONDAY + dt.timedelta(hours=h), u, kind, v, '{"k": 1}') for i, (u, h, kind, v) in enumerate(events)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/events.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return difference(contract.queries()[name](spark, str(folder)), connection.execute(contract.oracle_sql()[name]))


RATES = [
    # No weight, a rate that ends in a half at the seventh decimal, volumes that cancel out either way, half a mL/kg/h.
    (1, 0, "purchase", 0.0), (1, 1, "click", 5.0), (1, 3, "click", 5.0), (1, 7, "click", 5.0),
    *[(u, h, kind, v) for u in range(2, 60) for h, kind, v in ((0, "purchase", 32.0), (1, "click", 0.01 * u), (3, "click", 10.0 + u))],
    (70, 0, "purchase", 10.0), (70, 1, "click", 0.3), (70, 4, "signup", 0.1), (70, 7, "signup", 0.2),
    (71, 0, "purchase", 10.0), (71, 1, "click", 0.1), (71, 4, "click", 0.2), (71, 7, "signup", 0.3),
    (72, 0, "purchase", 20.0), (72, 1, "click", 59.7), (72, 4, "click", 0.1), (72, 7, "click", 0.2),
]


@pytest.mark.parametrize("name", ["urine_rate", "urine_arm"])
def test_rates_on_edges(spark, tmp_path, name):
    assert compared(spark, tmp_path, name, RATES) is None


@pytest.mark.parametrize("name", ["onset_two_arms", "onset_gated", "diagnosis_events_appended", "detector_confusion", "detector_metrics"])
def test_onsets_on_edges(spark, tmp_path, name):
    """Their SQL adds the volumes of a window from the earliest on and does not round them."""
    errors = [(u, h, "error", 5.0 + u) for u in range(1, 60) for h in (0, 2)]
    late = [(u, h + 60, kind, v) for u, h, kind, v in RATES]
    assert compared(spark, tmp_path, name, errors + [(u, 0, "error", 30.0) for u in (70, 71, 72)] + late) is None


def test_bins_of_a_group_share_one_mean(spark, tmp_path):
    values = [0.01, 0.02, 0.02, 0.03, 0.03, 0.03, 0.03, 0.05]
    events = [(u, 0, "view", v + u) for u in range(20) for v in values[: 8 - u % 2]]
    assert compared(spark, tmp_path, "bin_faults", events) is None
    found = contract.queries()["bin_faults"](spark, str(tmp_path))
    # Worked out twice, the mean of an even group may fall to either side of a half.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
