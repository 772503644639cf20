"""Every registered query with SQL against DuckDB, and the history queries again in chunked form."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from busline.operators import chunked
from busline.plans import crowd

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

# order-dependent queries: with these widths their keys are cut into many chunks
SMALL = {"ARRIVAL_CHUNK": 500, "HOUR_MS": 610_000}
HISTORY = ["stateful_ingest", "trip_context", "alert_persistent_off_route", "behaviour_windows", "alert_stationary",
           "alert_stationary_by_speed", "alert_communication_loss", "alert_trip_not_started", "dwell", "smoothed_speed",
           "trip_requests", "report_consensus"]


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def text(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def compare(spark, database, name, folder=SF):
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    result = database.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(text(r[names.index(c)]) for c in columns) for r in result.fetchall())
    got = sorted(tuple(text(v) for v in r) for r in df.select(*columns).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, database, name):
    compare(spark, database, name)


@pytest.mark.parametrize("name", HISTORY)
def test_chunked_history_equals_sql(spark, database, name, monkeypatch):
    for width, small in SMALL.items():
        monkeypatch.setattr(chunked, width, small)
    monkeypatch.setattr(crowd, "CROWD_CHUNK", 1_250_000)
    compare(spark, database, name)


def test_records_of_buses_at_their_last_stop_equal_sql(spark, tmp_path):
    """A month later every bus that moves stands at the end of its line, at distance 0 from the last stop."""
    con = duckdb.connect()
    for f in os.listdir(SF):
        later = " REPLACE (ts + INTERVAL 30 DAY AS ts)" if f == "events.parquet" else ""
        con.execute(f"COPY (SELECT *{later} FROM '{SF}/{f}') TO '{tmp_path}/{f}'")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{f}'")
    compare(spark, con, "eta_stream_records", str(tmp_path))
    assert con.execute(entry.oracle_sql()["eta_stream_records"] + " WHERE next_stop_m = 0").fetchall()


def test_queries_without_sql_run(spark):
    for name in sorted(set(entry.queries()) - set(entry.oracle_sql())):
        assert entry.queries()[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
