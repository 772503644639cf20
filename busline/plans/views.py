"""Deterministic views of the driver's tables, written once as SQL text that both engines accept.

A literal such as ``6.5d`` is rewritten to exponent form, which both engines read as a double.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.operators.validate import once
from busline.session import spread

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
BASE_MS = 1_777_716_000_000
AS_OF_MS = BASE_MS + 20_000_000
#: Each event becomes messages that are written and parsed: some ten thousands of them are a task's work.
PART_BYTES = {"events": 512 << 10}


def _doubles(sql: str) -> str:
    return re.sub(r"(\d+\.\d+)d\b", r"\1e0", sql)


def _int(expr: str) -> str:
    return f"CAST(floor({expr}) AS BIGINT)"


# micros since 2024-01-01 by event timestamp; the one dialect difference
_MICROS = {"spark": "unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000", "duckdb": "epoch_us(ts) - 1704067200000000"}

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, _doubles(sql))


_view("ev", [], "SELECT event_id, user_id, event_type, value, {micros} AS us FROM events")

_view("tele_clock", ["ev"], f"""
SELECT event_id, user_id, event_type, value,
  {BASE_MS} + CASE user_id % 3 WHEN 0 THEN {_int('us / 19440000.0d')} WHEN 1 THEN {_int('us / 3888000.0d')}
    ELSE {_int('us / 200000.0d')} END - CASE WHEN event_id % 17 = 0 THEN 25000 ELSE 0 END AS t,
  20.0d * CASE WHEN user_id % 4 = 0 THEN 0.5d ELSE least(1.0d, us / 2592000000000.0d) END AS f20
FROM ev""")

_view("tele_seg", ["tele_clock"], f"SELECT *, least(19, {_int('f20')}) AS i FROM tele_clock")

_view("tele_once", ["tele_seg"], f"""
SELECT event_id, 4 * event_id + 1 AS arrival, CAST(user_id AS STRING) AS bus_id, user_id % 5 AS home_route,
  CASE WHEN event_id % 19 = 0 THEN 'T' || user_id || '-0' END AS payload_trip, t,
  CASE WHEN event_id % 41 = 0 THEN 0.0d WHEN event_id % 43 = 0 THEN NULL
    ELSE round(6.5d + 0.02d * f20 + CASE WHEN user_id % 4 = 0 THEN 0.00001d * (event_id % 5) ELSE 0.0d END, 6) END AS lat,
  round(79.9d + 0.1d * (user_id % 5) + 0.005d * ((i * i) % 5 + (f20 - i) * (((i + 1) * (i + 1)) % 5 - (i * i) % 5))
    + CASE WHEN user_id % 4 <> 0 AND event_type IN ('error', 'signup') THEN 0.0012d
           WHEN user_id % 4 = 0 AND event_id % 7 = 0 THEN 0.0012d ELSE 0.0d END, 6) AS lon,
  CASE WHEN user_id % 4 = 0 THEN value / 100.0d ELSE value END AS speed,
  CAST((event_id * 37) % 360 AS DOUBLE) AS heading, event_id % 47 = 0 AS malformed
FROM tele_seg""")

# some readings arrive twice
_view("telemetry", ["tele_once"], """
SELECT * FROM tele_once
UNION ALL
SELECT event_id, arrival + 1 AS arrival, bus_id, home_route, payload_trip, t, lat, lon, speed, heading, malformed
FROM tele_once WHERE event_id % 23 = 0""")

_view("lifecycle", ["tele_clock"], f"""
SELECT 4 * event_id AS arrival, CAST(user_id AS STRING) AS bus_id,
  CASE WHEN event_id % 30 = 20 THEN 'TRIP_ENDED' WHEN event_id % 70 = 0 THEN 'INCIDENT_REPORTED' ELSE 'TRIP_STARTED' END AS event,
  'T' || user_id || '-' || ({_int('event_id / 10.0d')} % 2) AS trip_id, CAST(user_id % 5 AS STRING) AS route_id, t
FROM tele_clock WHERE event_id % 10 = 0 AND user_id % 7 <> 3""")

_view("routes", [], """
SELECT CAST(r_regionkey AS BIGINT) AS route_id, r_name AS route_name,
  CASE WHEN r_regionkey % 2 = 0 THEN CAST(100 + r_regionkey AS STRING) ELSE '' END AS route_number FROM region""")

_view("point_index", [], "SELECT r_regionkey, {numbers} AS i FROM region")

_view("route_points", ["point_index"], """
SELECT CAST(r_regionkey AS BIGINT) AS route_id, CAST(i AS BIGINT) AS seq, 6.5d + 0.02d * i AS lat,
  79.9d + 0.1d * r_regionkey + 0.005d * ((i * i) % 5) AS lon FROM point_index""")

_view("stops", [], f"""
SELECT stop_id, stop_name, 6.5d + 0.02d * i AS lat, 79.9d + 0.1d * (stop_id % 5) + 0.005d * ((i * i) % 5) AS lon FROM (
  SELECT CAST(n_nationkey AS BIGINT) AS stop_id, n_name AS stop_name,
    least(20, 4 * ({_int('n_nationkey / 5.0d')} + 1)) AS i FROM nation) AS placed""")

_view("links", [], f"""
SELECT CAST(n_regionkey AS BIGINT) AS route_id, CAST(n_nationkey AS BIGINT) AS stop_id,
  {_int('n_nationkey / 5.0d')} + 1 AS stop_order FROM nation
UNION ALL
SELECT CAST((n_regionkey + 1) % 5 AS BIGINT), CAST(n_nationkey AS BIGINT), {_int('n_nationkey / 5.0d')} + 101 FROM nation""")

_view("schedules", [], """
SELECT p_partkey AS schedule_id, p_partkey % 5 AS route_id, CAST(p_size % 7 AS BIGINT) AS day_of_week,
  CAST(p_size AS BIGINT) AS size_code FROM part""")

_view("trips", [], """
SELECT 'TRIP-' || o_orderkey AS trip_id, o_orderkey AS trip_seq, o_orderkey % 200 AS schedule_id, o_custkey AS bus_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 97 END AS driver_id, CAST(o_orderdate AS DATE) AS date,
  CASE o_orderstatus WHEN 'P' THEN 'EN_ROUTE' WHEN 'O' THEN 'WAITING_AT_DEPOT' ELSE 'ARRIVED_DESTINATION' END AS status
FROM orders""")

_view("buses", [], """
SELECT c_custkey AS bus_id, CAST(c_nationkey % 5 AS BIGINT) AS route_id, 'BUS-' || c_custkey AS fleet_code,
  'NA-' || c_custkey AS plate_number, c_name AS bus_name, 50 AS capacity FROM customer""")

_view("drivers", [], """
SELECT s_suppkey AS driver_id, s_name AS driver_name, 'LIC-' || s_suppkey AS licence, 'AUTH-' || s_suppkey AS auth_id,
  CAST(s_nationkey AS BIGINT) AS depot FROM supplier""")

# requests about trips, two to four per order line group
_view("requests", ["ev"], """
SELECT 'TRIP-' || (event_id % 400) AS trip_id, event_id AS arrival,
  CASE WHEN event_type IN ('click', 'view') THEN 'start' WHEN event_type = 'purchase' THEN 'end'
       WHEN event_type = 'signup' THEN 'delay' ELSE 'incident' END AS kind,
  us AS t, CASE WHEN event_type = 'signup' THEN event_id % 60 END AS delay_minutes,
  CASE WHEN event_type = 'error' THEN 'TYPE-' || (event_id % 4) END AS incident_type FROM ev""")

_view("crowd_reports", ["ev"], f"""
SELECT event_id AS arrival, 'T' || user_id AS trip_id, user_id % 5 AS route_id,
  CASE WHEN event_id % 13 = 0 THEN 99 ELSE user_id % 5 + 5 * (event_id % 2) END AS stop_id,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 2 AS BIGINT) END AS direction_id,
  least(100, {_int('value')}) AS score,
  CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 9 = 0 THEN 'synthetic' ELSE 'p' || (event_id % 20) END AS passenger_id,
  {BASE_MS} + 5000 * event_id AS t
FROM ev WHERE event_type = 'view'""")

_view("eta_records", [], """
SELECT 'T' || l_orderkey AS trip_id, l_suppkey % 5 AS route_id, l_partkey % 5 AS stop_id,
  1775001600000 + 3600000 * ((l_orderkey * 7 + l_linenumber) % 240) + 1000 * (l_orderkey % 3600) AS t,
  l_quantity * 20 AS eta_seconds, l_extendedprice AS distance_m, l_quantity / 4.0d AS speed_ms,
  CAST(l_linenumber AS BIGINT) AS stops_remaining, l_returnflag = 'R' AS off_route, l_orderkey AS record_seq,
  CAST(l_linenumber AS BIGINT) AS line FROM lineitem""")

_NUMBERS = {"spark": "explode(sequence(0, 20))", "duckdb": "unnest(range(21))"}


def view_sql(name: str, dialect: str) -> str:
    return VIEWS[name][1].replace("{micros}", _MICROS[dialect]).replace("{numbers}", _NUMBERS[dialect])


def _ordered(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        for need in _ordered(VIEWS[name][0]):
            if need not in out:
                out.append(need)
        if name not in out:
            out.append(name)
    return out


def oracle(select: str, *views: str, extra: dict[str, str] | None = None) -> str:
    """DuckDB text: the needed views, then named extra parts, then the query."""
    parts = [f"{n} AS ({view_sql(n, 'duckdb')})" for n in _ordered(list(views))]
    parts += [f"{n} AS ({_doubles(sql)})" for n, sql in (extra or {}).items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + _doubles(select)


_SOURCES: dict[tuple[str, str, str, int], str] = {}


def stamp(spark: SparkSession, sf_dir: str) -> int:
    """Changes when a table of the folder is written anew."""
    root = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    return hash(tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files)))


def _source(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Name of a temporary view over one parquet table; its schema is read once per application and state."""
    key = (spark.sparkContext.applicationId, sf_dir, name, stamp(spark, sf_dir))
    if key not in _SOURCES:
        alias = f"busline_{len(_SOURCES)}_{name}"
        spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"), PART_BYTES.get(name)).createOrReplaceTempView(alias)
        _SOURCES[key] = alias
    return _SOURCES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.table(_source(spark, sf_dir, name))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; its parts are common table expressions over the parquet files."""
    names = _ordered([name])
    text = " ".join(view_sql(n, "spark") for n in names)
    tables = [t for t in TABLES if re.search(rf"\bFROM {t}\b", text)]
    ctes = [f"{t} AS (SELECT * FROM {_source(spark, sf_dir, t)})" for t in tables]
    ctes += [f"{n} AS ({view_sql(n, 'spark')})" for n in names]
    return spark.sql("WITH " + ",\n".join(ctes) + f"\nSELECT * FROM {name}")


def gps_json(telemetry: DataFrame) -> DataFrame:
    """The telemetry view as raw messages: (arrival, value)."""
    body = F.to_json(F.struct(
        F.col("bus_id").alias("busId"), F.col("payload_trip").alias("tripId"), "lat", "lon", "speed", "heading",
        F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")))
    # one evaluation per row, as if the text had been read from a topic
    return once(telemetry, F.when(F.col("malformed"), F.lit("{bad")).otherwise(body).alias("value")).select("arrival", "value")
