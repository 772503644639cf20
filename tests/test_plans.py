"""Physical plans and packaging."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from busline.session import spread

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")

NO_CROSS = ["training_reports", "trip_cache_status", "startup_buffer", "scaffold_physics", "training_sufficiency", "import_routes",
            "stops_near", "connecting_routes", "live_occupancy", "subscriber_feed", "stop_resolution"]


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_CROSS)
def test_no_cross_join(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scan_reads_only_what_is_used(spark):
    text = plan(spark, "crowd_features")
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in text
    assert "props" not in text


def test_telemetry_is_not_moved_for_the_route_tables(spark):
    text = plan(spark, "enriched_telemetry")
    assert "hashpartitioning(route_id" not in text and text.count("BroadcastHashJoin") >= 2


def test_work_runs_where_the_package_is_not_installed(tmp_path):
    """Python workers start without the repository on their path; the code travels with the job."""
    script = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
              "from busline.session import build_session\n"
              "from busline.operators.chunked import spaced\n"
              "s = build_session('ship', 'local[2]', spark__ui__enabled='false')\n"
              "df = s.range(0, 2000).selectExpr('\"k\" AS k', 'id * 3 AS t')\n"
              "print('rows', spaced(df, ['k'], 't', 10, False, 500).count(), spaced(df, ['k'], 't', 10, False, 1 << 60).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 500 500" in done.stdout, done.stderr[-2000:]


HISTORY = ["stateful_ingest", "strictly_newer", "trip_context", "dwell", "smoothed_speed", "alert_persistent_off_route", "behaviour_windows",
           "alert_stationary", "alert_stationary_by_speed", "alert_communication_loss", "alert_trip_not_started"]


def test_building_history_queries_starts_no_job(spark):
    """The small dimension tables and the tables' schemas are read once before; telemetry is not touched until a result is asked for."""
    context = spark.sparkContext
    entry.queries()["enriched_telemetry"](spark, SF)
    entry.queries()["trip_requests"](spark, SF)
    for name in HISTORY:
        context.setJobGroup(f"building {name}", name)
        entry.queries()[name](spark, SF)
        assert not context.statusTracker().getJobIdsForGroup(f"building {name}"), name
    context.setJobGroup("tests", "")


def test_costly_rows_are_dealt_by_the_size_of_their_files(spark, tmp_path):
    """A table in few large splits is dealt to more parts as it grows, so that no task grows with it."""
    path = f"{tmp_path}/t.parquet"
    spark.range(200_000).selectExpr("id", "uuid() AS u").coalesce(8).write.parquet(path)
    table = spark.read.parquet(path)
    assert spread(table, 256 << 10).rdd.getNumPartitions() > 2 * spread(table).rdd.getNumPartitions()


def test_points_become_readings_in_one_hash_aggregation(spark):
    text = plan(spark, "history_pivot")
    assert "SortAggregate" not in text and text.count("hashpartitioning") == 1
