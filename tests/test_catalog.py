"""Every registered query against its SQL on the smallest tables."""

from datetime import datetime

import pytest

from gridwright.catalog import REGISTRY
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    ok, message = compare(spark, con, FOLDER, REGISTRY[name])
    assert ok, message


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def matches_on(spark, folder, name, *events):
    """One registered query against its SQL on events (event_id, ts, value)."""
    import duckdb

    table = spark.createDataFrame(
        [(i, ts, 1, "click", float(v)) for i, ts, v in events],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double")
    table.coalesce(1).write.parquet(f"{folder}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    ok, message = compare(spark, con, str(folder), REGISTRY[name])
    assert ok, message


def test_stop_passes_over_blank_cells(spark, tmp_path):
    """Cells 37 and 111 are blank: the message names 41 and 97."""
    at = datetime(2024, 1, 1)
    matches_on(spark, tmp_path, "invalid_numbers_stop_at_first_cell",
               *[(i, at, 1) for i in (37, 40, 41, 60, 82, 97, 111)])


def test_daily_means_of_events_at_one_instant(spark, tmp_path):
    """Day 1 repeats an instant, day 2 has invalid cells only, day 3 has no row."""
    at = datetime(2024, 1, 1, 8)
    matches_on(spark, tmp_path, "clean_convert_average_daily",
               (1, at, 1.5), (2, at, 2.25), (3, at, 9), (4, datetime(2024, 1, 1, 23), 0.07),
               (41, datetime(2024, 1, 2, 1), 3), (5, datetime(2024, 1, 4), 7))
