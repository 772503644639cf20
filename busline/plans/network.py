"""Queries over routes, stops and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import network
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import oracle, view

# riders ask from where buses were seen
_ASK = """SELECT arrival AS request_id, lat, lon, CASE event_id % 3 WHEN 0 THEN 60.0d WHEN 1 THEN 500.0d ELSE 2500.0d END AS radius_m FROM cleaned"""
_LABELS = """SELECT l.stop_id, string_agg(CASE WHEN route_number = '' THEN route_name ELSE route_number END, ',' ORDER BY
  CASE WHEN route_number = '' THEN route_name ELSE route_number END) AS routes FROM links l JOIN routes USING (route_id) GROUP BY 1"""


def _asked(spark, sf):
    return S.cleaned(spark, sf).select(F.col("arrival").alias("request_id"), "lat", "lon",
                                       F.when(F.col("event_id") % 3 == 0, 60.0).when(F.col("event_id") % 3 == 1, 500.0).otherwise(2500.0).alias("radius_m"))


@query("stops_near", oracle(f"""
SELECT request_id, stop_id, stop_name, round(d, 1) AS distance_m, labels.routes FROM (
  SELECT a.request_id, a.radius_m, s.stop_id, s.stop_name, {S.hav('a.lat', 'a.lon', 's.lat', 's.lon')} AS d FROM ask a CROSS JOIN stops s)
JOIN labels USING (stop_id) WHERE d <= radius_m""", "telemetry", "stops", "links", "routes",
    extra=S.parts(["cleaned"], ask=_ASK, labels=_LABELS)))
def stops_near(spark, sf):
    out = network.stops_near(_asked(spark, sf), view(spark, sf, "stops"), view(spark, sf, "links"), view(spark, sf, "routes"))
    return out.withColumn("routes", F.array_join("routes", ","))


# from where a bus is towards the end of a line
_TRIPS = """SELECT arrival AS request_id, lat AS start_lat, lon AS start_lon, 6.9d AS end_lat, 79.9d + 0.1d * home_route AS end_lon,
  3000.0d AS radius_m FROM cleaned"""


@query("connecting_routes", oracle(f"""
SELECT request_id, route_id, start_stop_id, end_stop_id FROM (
  SELECT t.request_id, x.route_id, x.stop_id AS start_stop_id, y.stop_id AS end_stop_id,
    row_number() OVER (PARTITION BY t.request_id, x.route_id ORDER BY x.stop_order, y.stop_order) AS n
  FROM ask t JOIN stops a ON {S.hav('t.start_lat', 't.start_lon', 'a.lat', 'a.lon')} <= 3000
  JOIN stops b ON {S.hav('t.end_lat', 't.end_lon', 'b.lat', 'b.lon')} <= 3000
  JOIN links x ON x.stop_id = a.stop_id JOIN links y ON y.stop_id = b.stop_id AND y.route_id = x.route_id AND y.stop_order > x.stop_order)
WHERE n = 1""", "telemetry", "stops", "links", extra=S.parts(["cleaned"], ask=_TRIPS)))
def connecting_routes(spark, sf):
    rows = S.cleaned(spark, sf)
    asked = rows.select(F.col("arrival").alias("request_id"), F.col("lat").alias("start_lat"), F.col("lon").alias("start_lon"),
                        F.lit(6.9).alias("end_lat"), (79.9 + 0.1 * (F.col("bus_id").cast("long") % 5)).alias("end_lon"),
                        F.lit(3000.0).alias("radius_m"))
    out = network.connecting_routes(asked, view(spark, sf, "stops"), view(spark, sf, "links"), view(spark, sf, "routes"))
    return out.select("request_id", "route_id", "start_stop_id", "end_stop_id")


@query("stops_with_routes", oracle("SELECT s.stop_id, s.stop_name, l.routes FROM stops s LEFT JOIN labels l USING (stop_id)",
                                   "stops", "links", "routes", extra={"labels": _LABELS}))
def stops_with_routes(spark, sf):
    labels = network.stop_labels(view(spark, sf, "links"), view(spark, sf, "routes"))
    return view(spark, sf, "stops").join(labels, "stop_id", "left").select("stop_id", "stop_name", F.array_join("routes", ",").alias("routes"))


@query("routes_of_stop", oracle("SELECT l.stop_id, r.route_id, r.route_name, r.route_number FROM links l JOIN routes r USING (route_id)",
                                "links", "routes"))
def routes_of_stop(spark, sf):
    return view(spark, sf, "links").join(view(spark, sf, "routes"), "route_id").select("stop_id", "route_id", "route_name", "route_number")


@query("route_stop_list", oracle("SELECT l.route_id, l.stop_order, l.stop_id, s.stop_name FROM links l JOIN stops s USING (stop_id) ORDER BY 1, 2",
                                 "links", "stops"))
def route_stop_list(spark, sf):
    return network.route_stop_list(view(spark, sf, "links"), view(spark, sf, "stops")).select(
        "route_id", "stop_order", "stop_id", "stop_name").orderBy("route_id", "stop_order")


@query("route_features", oracle("""SELECT route_id, (SELECT count(*) FROM route_points p WHERE p.route_id = r.route_id) AS n_points,
  (SELECT count(*) FROM links l WHERE l.route_id = r.route_id) AS n_stops FROM routes r""", "routes", "route_points", "links"))
def route_features(spark, sf):
    """GeoJSON per route, summarised by parsing it back."""
    out = network.feature_collection(view(spark, sf, "routes"), view(spark, sf, "route_points"), view(spark, sf, "links"), view(spark, sf, "stops"))
    parsed = F.try_parse_json("geojson")
    features = F.try_variant_get(parsed, "$.features", "array<variant>")
    line = F.try_variant_get(parsed, "$.features[0].geometry.coordinates", "array<variant>")
    return out.select("route_id", F.size(line).cast("long").alias("n_points"), (F.size(features) - 1).cast("long").alias("n_stops"))


@query("transit_shapes", oracle("""SELECT route_id, CAST(21 AS BIGINT) AS path_points,
  (SELECT string_agg(stop_name, '>' ORDER BY stop_order) FROM links l JOIN stops s USING (stop_id) WHERE l.route_id = r.route_id) AS stop_names
  FROM routes r""", "routes", "links", "stops"))
def transit_shapes(spark, sf):
    out = network.transit_shape(view(spark, sf, "routes"), view(spark, sf, "route_points"), view(spark, sf, "links"), view(spark, sf, "stops"))
    return out.select("route_id", F.size("path").cast("long").alias("path_points"), F.array_join("stops.stop_name", ">").alias("stop_names"))


_LOCATE = """SELECT p.pk, p.target_stop_order, s.*, greatest(0.0d, least(1.0d, ((p.lon - lon1) * (lon2 - lon1) + (p.lat - lat1) * (lat2 - lat1))
  / (pow(lon2 - lon1, 2) + pow(lat2 - lat1, 2)))) AS ratio, p.lat, p.lon FROM spots p JOIN segs s ON s.route_id = p.route_id"""
_PROGRESS = {
    "reqs": """SELECT arrival AS request_id, CASE WHEN event_id % 9 = 0 THEN 77 ELSE home_route END AS route_id, lat, lon,
        CASE WHEN event_id % 8 = 0 THEN 55 ELSE 1 + event_id % 5 END AS target_stop_order FROM cleaned""",
    "spots": """SELECT 'r' || request_id AS pk, route_id, target_stop_order, lat, lon FROM reqs
        UNION ALL SELECT 's' || l.route_id || '/' || l.stop_order, l.route_id, l.stop_order, s.lat, s.lon FROM links l JOIN stops s USING (stop_id)""",
    "located": _LOCATE,
    "foot": """SELECT pk, cum + ratio * len AS along, row_number() OVER (PARTITION BY pk ORDER BY
        pow(lat - (lat1 + ratio * (lat2 - lat1)), 2) + pow(lon - (lon1 + ratio * (lon2 - lon1)), 2), seq) AS n FROM located""",
    "pts": "SELECT 'r' || request_id AS pk, CAST(route_id AS STRING) AS route_id, lat, lon FROM reqs",
}


@query("progress_requests", oracle("""
SELECT request_id, reason, CASE WHEN reason IS NULL THEN round(bus, 2) END AS travelled_m,
  CASE WHEN reason IS NULL THEN round(greatest(0, stop - bus), 2) END AS remaining_m,
  CASE WHEN reason IS NULL THEN round(bus / (bus + greatest(0, stop - bus)) * 100, 2) END AS progress_pct FROM (
SELECT r.request_id, b.along AS bus, t.along AS stop, CASE WHEN b.pk IS NULL THEN 'ROUTE_NOT_FOUND' WHEN t.pk IS NULL THEN 'TARGET_STOP_NOT_FOUND'
  WHEN n.off_m > 100 THEN 'TOO_FAR_FROM_ROUTE' END AS reason FROM reqs r
LEFT JOIN foot b ON b.pk = 'r' || r.request_id AND b.n = 1
LEFT JOIN foot t ON t.pk = 's' || r.route_id || '/' || r.target_stop_order AND t.n = 1
LEFT JOIN near n ON n.pk = 'r' || r.request_id)""", "telemetry", "route_points", "links", "stops", extra=S.parts(
    ["cleaned", *S.GEO_PARTS], **_PROGRESS, **{n: S.SQL[n] for n in S.NEAR_PARTS})))
def progress_requests(spark, sf):
    home = F.col("bus_id").cast("long") % 5
    asked = S.cleaned(spark, sf).select(
        F.col("arrival").alias("request_id"), F.when(F.col("event_id") % 9 == 0, 77).otherwise(home).alias("route_id"), "lat", "lon",
        F.when(F.col("event_id") % 8 == 0, 55).otherwise(1 + F.col("event_id") % 5).alias("target_stop_order"))
    lines, _, cells = S.dimensions(spark, sf)
    number = F.col("route_id").cast("long")
    out = network.progress_requests(asked, lines.withColumn("route_id", number), view(spark, sf, "links"), view(spark, sf, "stops"),
                                    cells.withColumn("route_id", number))
    return out.select("request_id", "reason", "travelled_m", "remaining_m", "progress_pct")


@query("assigned_buses", oracle("""SELECT r.route_id, r.route_name, count(b.bus_id) AS bus_count,
  CASE WHEN count(b.bus_id) > 0 THEN count(b.bus_id) || ' buses assigned' ELSE 'No buses assigned' END AS message
  FROM routes r LEFT JOIN buses b USING (route_id) GROUP BY ALL""", "routes", "buses"))
def assigned_buses(spark, sf):
    return network.assigned_buses(view(spark, sf, "routes"), view(spark, sf, "buses"))


@query("live_buses", oracle("""SELECT b.bus_id, b.fleet_code, n.t AS seen_t, n.t IS NOT NULL AS live FROM buses b LEFT JOIN (
  SELECT bus_id, max(t) AS t FROM cleaned GROUP BY 1) n ON n.bus_id = CAST(b.bus_id AS STRING)""", "buses", "telemetry", extra=S.parts(["cleaned"])))
def live_buses(spark, sf):
    rows = S.cleaned(spark, sf).withColumn("bus_id", F.col("bus_id").cast("long"))
    newest = rows.groupBy("bus_id").agg(F.max_by(F.struct("t", "lat", "lon"), "t").alias("s")).select("bus_id", "s.*")
    return network.live_positions(view(spark, sf, "buses"), newest).select("bus_id", "fleet_code", "seen_t", "live")


@query("lookup_buses", oracle("""SELECT e.event_id AS request_id, b.fleet_code, b.bus_id IS NOT NULL AS found FROM ev e
  LEFT JOIN buses b ON b.bus_id = e.user_id * 20""", "ev", "buses"))
def lookup_buses(spark, sf):
    asked = view(spark, sf, "ev").select(F.col("event_id").alias("request_id"), (F.col("user_id") * 20).alias("bus_id"))
    return network.lookup(asked, view(spark, sf, "buses"), "bus_id").select("request_id", "fleet_code", "found")


@query("buses_on_route", oracle("SELECT bus_id, fleet_code FROM buses WHERE route_id = 2", "buses"))
def buses_on_route(spark, sf):
    return network.conditional(view(spark, sf, "buses"), route_id=2).select("bus_id", "fleet_code")


@query("validate_routes", oracle("""SELECT route_id, CASE WHEN route_id % 5 = 1 THEN 'name length must be 3..150'
  WHEN route_id % 5 = 2 THEN 'at least 2 coordinates required' WHEN route_id % 5 = 3 THEN 'coordinate out of bounds'
  WHEN route_id % 5 = 4 THEN 'at least 2 stops required; stop out of bounds' ELSE '' END AS reasons, CASE WHEN route_id % 5 = 4 THEN '1' ELSE '1,7' END AS orders
  FROM (SELECT p_partkey AS route_id FROM part)"""))
def validate_routes(spark, sf):
    """One candidate route per part, four of five with a defect."""
    kind = F.col("schedule_id") % 5
    pair = lambda lat: F.struct(F.lit(lat).alias("lat"), F.lit(80.0).alias("lon"))
    stop = lambda lat, order: F.struct(F.lit("s").alias("stop_name"), F.lit(lat).alias("lat"), F.lit(80.0).alias("lon"),
                                       F.lit(order).cast("int").alias("stop_order"))
    rows = view(spark, sf, "schedules").select(
        F.col("schedule_id").alias("route_id"), F.when(kind == 1, " x ").otherwise("Line").alias("route_name"),
        F.when(kind == 2, F.array(pair(6.9))).when(kind == 3, F.array(pair(6.9), pair(20.0))).otherwise(
            F.array(pair(6.9), pair(7.0))).alias("coordinates"),
        F.when(kind == 4, F.array(stop(1.0, None))).otherwise(F.array(stop(6.9, None), stop(7.0, 7))).alias("stops"))
    out = network.validate_geometry(rows)
    return out.select("route_id", F.array_join("reasons", "; ").alias("reasons"),
                      F.array_join(F.transform("stops", lambda s: s["stop_order"].cast("string")), ",").alias("orders"))


# route files: one per part, named after its brand; the part number is the upload time
_IMPORT = {
    "files": "SELECT p_brand AS route_name, p_partkey AS loaded_at FROM part",
    "latest": "SELECT route_name, max(loaded_at) AS loaded_at FROM files GROUP BY 1",
    "imported": """SELECT 1 + row_number() OVER (ORDER BY CAST('0x' || substr(sha256(route_name), 1, 15) AS BIGINT)) + 3 AS route_id, route_name, loaded_at FROM latest""",
    "listed": """SELECT route_id, loaded_at, 1 AS stop_order, 'NATION_' || (loaded_at % 25) AS stop_name FROM imported
        UNION ALL SELECT route_id, loaded_at, 2, 'NEW_' || (loaded_at % 40) FROM imported""",
    "fresh": "SELECT DISTINCT stop_name FROM listed WHERE stop_name LIKE 'NEW%'",
    "stop_ids": """SELECT stop_name, 24 + row_number() OVER (ORDER BY CAST('0x' || substr(sha256(stop_name), 1, 15) AS BIGINT)) AS stop_id FROM fresh
        UNION ALL SELECT n_name, CAST(n_nationkey AS BIGINT) FROM nation""",
}


@query("import_routes", oracle("SELECT l.route_id, CAST(l.stop_order AS BIGINT) AS stop_order, s.stop_id FROM listed l JOIN stop_ids s USING (stop_name)",
                               extra=_IMPORT))
def import_routes(spark, sf):
    """Upsert of parsed route files: links with new and reused ids."""
    parts = spark.read.parquet(f"{sf}/part.parquet")
    at = F.col("p_partkey")
    stop = lambda name: F.struct(name.alias("stop_name"), F.lit(6.9).alias("lat"), F.lit(80.0).alias("lon"))
    parsed = parts.select(F.col("p_brand").alias("route_name"), at.alias("loaded_at"),
                          F.array(F.array(F.lit(80.0), F.lit(6.9)), F.array(F.lit(80.0), F.lit(7.0))).alias("coordinates"),
                          F.array(stop(F.concat(F.lit("NATION_"), (at % 25).cast("string"))),
                                  stop(F.concat(F.lit("NEW_"), (at % 40).cast("string")))).alias("stops"))
    out = network.import_routes(parsed, view(spark, sf, "routes"), view(spark, sf, "stops"))
    return out["links"].select("route_id", F.col("stop_order").cast("long").alias("stop_order"), "stop_id")


@query("delete_routes", oracle("SELECT route_id, stop_id, stop_order FROM links WHERE route_id NOT IN (1, 3)", "links"))
def delete_routes(spark, sf):
    deleted = view(spark, sf, "routes").filter("route_id IN (1, 3)").select("route_id")
    return network.delete_routes(view(spark, sf, "routes"), view(spark, sf, "links"), deleted)[1]


@query("subscriber_feed", oracle("""SELECT s.driver_id AS subscriber_id, c.arrival FROM cleaned c JOIN drivers s ON s.driver_id % 4 <> 3
  AND (s.driver_id % 4 NOT IN (0, 1) OR s.driver_id % 5 = c.home_route) AND (s.driver_id % 4 NOT IN (0, 2) OR CAST(s.driver_id % 15 AS STRING) = c.bus_id)
UNION ALL SELECT NULL, arrival FROM cleaned WHERE EXISTS (SELECT 1 FROM drivers WHERE driver_id % 4 = 3)""", "telemetry", "drivers", extra=S.parts(["cleaned"])))
def subscriber_feed(spark, sf):
    messages = S.cleaned(spark, sf).select("arrival", "bus_id", "t", (F.col("bus_id").cast("long") % 5).cast("string").alias("route_id"))
    kind = F.col("driver_id") % 4
    subs = view(spark, sf, "drivers").select(
        F.col("driver_id").alias("subscriber_id"), F.when(kind.isin(0, 1), (F.col("driver_id") % 5).cast("string")).alias("want_route"),
        F.when(kind.isin(0, 2), (F.col("driver_id") % 15).cast("string")).alias("want_bus"))
    return network.subscriber_feed(messages, subs).select("subscriber_id", "arrival")
