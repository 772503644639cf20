"""Inputs that several queries share, each with its SQL counterpart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from busline.functions import geo
from busline.operators import chunked, context, enrich, validate
from busline.plans.views import stamp, view
from busline.session import written


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry rows that pass the physics rules."""
    # the view's formulas stand for stored columns, so they are evaluated once per row
    raw = view(spark, sf_dir, "telemetry")
    computed = ["payload_trip", "t", "lat", "lon", "speed", "heading", "malformed"]
    rows = validate.once(raw.select("bus_id", "arrival", "event_id", *[F.col(c).alias(f"_{c}") for c in computed]),
                         *[F.col(f"_{c}").alias(c) for c in computed])
    reason = validate.physics_reason(F.col("malformed"), F.col("lat"), F.col("lon"), F.col("speed"))
    return rows.filter(reason.isNull()).select(
        "bus_id", "arrival", "event_id", "payload_trip", F.lit(None).cast("string").alias("payload_route"), "t", "lat",
        "lon", "speed", "heading")


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    trips = view(spark, sf_dir, "trips").filter("bus_id % 7 <> 3")
    return context.bootstrap_trips(trips, view(spark, sf_dir, "schedules"))


def in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.attach_trips(cleaned(spark, sf_dir), view(spark, sf_dir, "lifecycle"), bootstrap(spark, sf_dir),
                                width=chunked.ARRIVAL_CHUNK)


def shapes(spark: SparkSession, sf_dir: str, text_key: bool = True) -> DataFrame:
    built = geo.route_segments(view(spark, sf_dir, "route_points"))
    return built.withColumn("route_id", F.col("route_id").cast("string")) if text_key else built


def route_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "links").withColumn("route_id", F.col("route_id").cast("string"))
    stops = view(spark, sf_dir, "stops").withColumn("stop_id", F.col("stop_id").cast("int"))
    links = links.withColumns({"stop_id": F.col("stop_id").cast("int"), "stop_order": F.col("stop_order").cast("int")})
    return enrich.stops_along(links, stops, shapes(spark, sf_dir))


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned stream. The dimension tables are written once: they are the same for every row."""
    lines, listed, cells = dimensions(spark, sf_dir)
    return enrich.enrich(in_context(spark, sf_dir), lines, listed, cells)


_DIMENSIONS: dict[tuple[str, str, int], tuple[DataFrame, DataFrame, DataFrame]] = {}


def dimensions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(route segments, stops along routes, segment short lists), built once per application and state of the tables."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir))
    if key not in _DIMENSIONS:
        lines = materialised(shapes(spark, sf_dir))
        _DIMENSIONS[key] = (lines, materialised(route_stops(spark, sf_dir)), materialised(geo.route_cells(lines)))
    return _DIMENSIONS[key]


def materialised(df: DataFrame) -> DataFrame:
    """Written once, by columns, and read by several consumers."""
    return written(df, "shared")


def steady(value: str | Column, digits: int) -> Column:
    """Rounding whose result does not hang on the last bit: halves always go up, by a clear margin."""
    column = F.col(value) if isinstance(value, str) else value
    return F.floor(column * 10.0 ** digits + 0.500001) / 10.0 ** digits


def steady_sql(expr: str, digits: int) -> str:
    return f"(floor(({expr}) * 1e{digits} + 0.500001e0) / 1e{digits})"


# --- the same, as SQL --------------------------------------------------------------------------

def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2}))"
         f" * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))")
    return f"(2 * 6371000.0d * atan2(sqrt({a}), sqrt(1 - {a})))"


BOUNDS = "lat BETWEEN 5.85 AND 9.95 AND lon BETWEEN 79.4 AND 81.95"

SQL = {
    "cleaned": f"SELECT * FROM telemetry WHERE NOT malformed AND {BOUNDS} AND speed BETWEEN 0 AND 200",
    "boot": """SELECT CAST(bus_id AS STRING) AS bus_id, arg_max(trip_id, trip_seq) AS boot_trip,
        CAST(arg_max(route_id, trip_seq) AS STRING) AS boot_route
        FROM trips JOIN schedules USING (schedule_id) WHERE status = 'EN_ROUTE' AND bus_id % 7 <> 3 GROUP BY bus_id""",
    "marks": "SELECT * FROM lifecycle WHERE event <> 'INCIDENT_REPORTED'",
    "line": """SELECT bus_id, arrival, t, CAST(NULL AS BIGINT) AS mark FROM cleaned
        UNION ALL SELECT bus_id, arrival, NULL, arrival FROM marks""",
    "behind": """SELECT bus_id, arrival, t, max(mark) OVER w AS mark, max(t) OVER w AS newest FROM line
        WINDOW w AS (PARTITION BY bus_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "newer": "SELECT * FROM behind WHERE t IS NOT NULL AND (newest IS NULL OR t > newest)",
    "known": """SELECT n.bus_id, n.arrival, max(k.arrival) AS mark FROM newer n JOIN cleaned c USING (bus_id, arrival)
        JOIN marks k ON k.bus_id = n.bus_id AND k.trip_id = c.payload_trip AND k.arrival < n.arrival GROUP BY ALL""",
    "ctx": """SELECT c.*, coalesce(c.payload_trip, CASE WHEN m.event = 'TRIP_STARTED' THEN m.trip_id END,
          CASE WHEN m.event IS NULL THEN b.boot_trip END) AS trip_id,
        coalesce(CASE WHEN m.event = 'TRIP_STARTED' THEN m.route_id END, CASE WHEN m.event IS NULL THEN b.boot_route END,
          CASE WHEN k.event = 'TRIP_STARTED' THEN k.route_id END) AS route_id,
        m.event AS mark_event, b.boot_trip IS NOT NULL AS has_boot
        FROM newer n JOIN cleaned c ON c.bus_id = n.bus_id AND c.arrival = n.arrival
        LEFT JOIN marks m ON m.bus_id = n.bus_id AND m.arrival = n.mark
        LEFT JOIN known kn ON kn.bus_id = n.bus_id AND kn.arrival = n.arrival
        LEFT JOIN marks k ON k.bus_id = n.bus_id AND k.arrival = kn.mark
        LEFT JOIN boot b ON b.bus_id = n.bus_id""",
    "legs": """SELECT route_id, seq, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2
        FROM route_points WINDOW w AS (PARTITION BY route_id ORDER BY seq)""",
    "measured": f"SELECT *, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS len FROM legs WHERE lat2 IS NOT NULL",
    "segs": """SELECT *, coalesce(sum(len) OVER (PARTITION BY route_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS cum, sum(len) OVER (PARTITION BY route_id) AS total FROM measured""",
    "ratios": f"""SELECT p.pk, p.lat, p.lon, s.*, greatest(0.0d, least(1.0d, (pow({hav('p.lat', 'p.lon', 'lat1', 'lon1')}, 2)
        + len * len - pow({hav('p.lat', 'p.lon', 'lat2', 'lon2')}, 2)) / (2 * len * len))) AS ratio
        FROM pts p JOIN segs s ON CAST(s.route_id AS STRING) = p.route_id""",
    "feet": f"""SELECT *, {hav('lat', 'lon', '(lat1 + ratio * (lat2 - lat1))', '(lon1 + ratio * (lon2 - lon1))')} AS d
        FROM ratios""",
    "near": """SELECT pk, d AS off_m, cum + ratio * len AS along_m, total FROM feet
        QUALIFY row_number() OVER (PARTITION BY pk ORDER BY d, seq) = 1""",
    "stop_pts": """SELECT CAST(l.route_id AS STRING) || '/' || l.stop_order AS pk, CAST(l.route_id AS STRING) AS route_id,
        s.lat, s.lon, l.stop_order, s.stop_id, s.stop_name FROM links l JOIN stops s USING (stop_id)""",
    "pts": """SELECT 'r' || arrival AS pk, route_id, lat, lon FROM ctx WHERE route_id IS NOT NULL
        UNION ALL SELECT pk, route_id, lat, lon FROM stop_pts""",
    "stop_pos": "SELECT s.*, n.along_m FROM stop_pts s JOIN near n USING (pk)",
    "ahead": """SELECT c.arrival, s.stop_id, s.stop_name, s.stop_order, round(s.along_m - n.along_m, 2) AS ahead_m
        FROM ctx c JOIN near n ON n.pk = 'r' || c.arrival JOIN stop_pos s ON s.route_id = c.route_id AND s.along_m >= n.along_m""",
    "ahead_one": """SELECT arrival, count(*) AS stops_remaining, arg_min(stop_id, stop_order) AS next_stop_id,
        arg_min(ahead_m, stop_order) AS next_stop_m FROM ahead GROUP BY arrival""",
    "enriched": """SELECT c.*, coalesce(n.off_m, 0) > 50 AS off_route, round(coalesce(n.off_m, 0), 2) AS off_route_m,
        round(CASE WHEN n.total IS NULL THEN 0 ELSE greatest(0, n.total - n.along_m) END, 2) AS remaining_m,
        round(CASE WHEN n.total IS NULL THEN 0 ELSE least(100, n.along_m / n.total * 100) END, 2) AS progress_pct,
        a.next_stop_id, coalesce(a.next_stop_m, 0) AS next_stop_m, coalesce(a.stops_remaining, 0) AS stops_remaining,
        CASE WHEN lat BETWEEN 6.78 AND 6.82 AND lon BETWEEN 79.96 AND 80.02 THEN 'expressway' ELSE 'urban' END AS segment_mode
        FROM ctx c LEFT JOIN near n ON n.pk = 'r' || c.arrival LEFT JOIN ahead_one a ON a.arrival = c.arrival""",
}
CONTEXT_PARTS = ["cleaned", "boot", "marks", "line", "behind", "newer", "known", "ctx"]
GEO_PARTS = ["legs", "measured", "segs"]
NEAR_PARTS = ["ratios", "feet", "near"]
ENRICHED_PARTS = [*CONTEXT_PARTS, *GEO_PARTS, "stop_pts", "pts", *NEAR_PARTS, "stop_pos", "ahead", "ahead_one", "enriched"]
CONTEXT_VIEWS = ["telemetry", "lifecycle", "trips", "schedules"]
ENRICHED_VIEWS = [*CONTEXT_VIEWS, "route_points", "stops", "links"]


def parts(names: list[str], **more: str) -> dict[str, str]:
    return {**{n: SQL[n] for n in names}, **more}
