"""Queries over raw telemetry: validation, context, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.functions import geo, scalars
from busline.operators import chunked, context, enrich, spatial, validate
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import AS_OF_MS, BASE_MS, gps_json, oracle, view


@query("classify_telemetry", oracle(f"""
SELECT arrival, CASE WHEN malformed THEN 'MALFORMED_JSON' WHEN lat IS NULL THEN 'MISSING_OR_INVALID_COORDINATES'
  WHEN NOT ({S.BOUNDS}) THEN 'OUT_OF_SRI_LANKA_BOUNDS' WHEN speed > 200 OR speed < 0 THEN 'UNREALISTIC_SPEED' END AS invalid_reason
FROM telemetry""", "telemetry"))
def classify_telemetry(spark, sf):
    """Raw JSON messages through decode and physics classification."""
    messages = validate.drop_blank(gps_json(view(spark, sf, "telemetry")))
    return validate.classify(validate.decode_gps(messages)).select("arrival", "invalid_reason")


@query("split_counts", oracle(f"""
SELECT 'cleaned' AS side, CAST(count(*) AS BIGINT) AS n FROM cleaned
UNION ALL SELECT 'invalid', CAST((SELECT count(*) FROM telemetry) - (SELECT count(*) FROM cleaned) AS BIGINT)""",
    "telemetry", extra=S.parts(["cleaned"])))
def split_counts(spark, sf):
    good, bad = validate.split(validate.classify(validate.decode_gps(gps_json(view(spark, sf, "telemetry")))))
    return (good.agg(F.lit("cleaned").alias("side"), F.count("*").alias("n"))
            .unionByName(bad.agg(F.lit("invalid").alias("side"), F.count("*").alias("n"))))


# messages with every kind of defect: the remainder of the event id picks it
_DIRTY = {
    1: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":30', 2: '"busId":"  ","lat":6.9,"lon":80.1,"speed":30,"timestamp":"{t}"',
    3: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":"fast","timestamp":"{t}"',
    5: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":30,"heading":"north","timestamp":"{t}"',
    6: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":30,"timestamp":"yesterday"',
    7: '"bus_id":"{b}","lat":"6.9","lon":80.1,"speed":"30.5","timestamp":"{t}"',
    8: '"busId":"{b}","lat":6.9,"lon":80.1,"timestamp":"{t}"',
    9: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":250,"heading":400,"timestamp":"{t}"',
    10: '"busId":"{b}","lat":91,"lon":80.1,"speed":30,"timestamp":"{t}"',
    11: '"busId":"{b}","lat":20.5,"lon":80.1,"speed":30,"tripId":"T{b}","timestamp":"{t}"',
    12: '"busId":"{b}","lat":6.9,"lon":80.1,"speed":30,"tripId":"T{b}","heading":null,"timestamp":"{t}"',
    13: '"busId":"{b}","lon":80.1,"speed":30,"timestamp":"{t}"',
}


def dirty_messages(spark, sf):
    """(event_id, value): well-formed messages with a share of defective ones."""
    rows = view(spark, sf, "tele_once").withColumn(
        "_ts", F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))

    def fill(text: str):
        pieces = []
        for chunk in text.replace("{b}", "\x00b\x00").replace("{t}", "\x00t\x00").split("\x00"):
            pieces.append(F.col("bus_id") if chunk == "b" else F.col("_ts") if chunk == "t" else F.lit(chunk))
        return F.concat(F.lit("{"), *pieces, F.lit("}"))

    kind = F.col("event_id") % 53
    value = F.when(kind == 0, "{bad").when(kind == 4, "[1, 2]")
    for number, text in _DIRTY.items():
        value = value.when(kind == number, fill(text))
    good = fill('"busId":"{b}","lat":6.9,"lon":80.1,"speed":30,"heading":90,"tripId":"T{b}","timestamp":"{t}"')
    return rows.select("event_id", value.otherwise(good).alias("value"))


@query("validate_schema_only", """
SELECT event_id, CASE event_id % 53 WHEN 0 THEN 'JSON_PARSE' WHEN 4 THEN 'SCHEMA_VALIDATION' WHEN 1 THEN 'MISSING_TIMESTAMP'
  WHEN 2 THEN 'SCHEMA_VALIDATION' WHEN 3 THEN 'SCHEMA_VALIDATION' WHEN 5 THEN 'SCHEMA_VALIDATION' WHEN 6 THEN 'SCHEMA_VALIDATION'
  WHEN 8 THEN 'SCHEMA_VALIDATION' WHEN 12 THEN 'SCHEMA_VALIDATION' WHEN 13 THEN 'SCHEMA_VALIDATION' END AS error_type,
  CASE event_id % 53 WHEN 0 THEN 'Failed to parse JSON' WHEN 4 THEN 'payload must be a JSON object'
  WHEN 1 THEN 'Missing required event timestamp' WHEN 2 THEN 'busId is required' WHEN 3 THEN 'speed must be numeric'
  WHEN 5 THEN 'heading must be numeric' WHEN 6 THEN 'timestamp must be ISO 8601' WHEN 8 THEN 'speed is required'
  WHEN 12 THEN 'heading must be numeric' WHEN 13 THEN 'lat is required' END AS error_reason
FROM events""")
def validate_schema_only(spark, sf):
    return validate.schema_only(validate.decode_gps(dirty_messages(spark, sf))).select(
        "event_id", "error_type", "error_reason")


def _contract_sql(trip: str) -> str:
    """Verdicts of the GPS contract; ``trip`` is what a message without a trip adds to its failing fields."""
    fields = {2: None, 3: "speed: must be between 0 and 200", 5: "heading: must be between 0 and 360", 6: "timestamp: must be ISO 8601", 7: None,
              8: "speed: must be between 0 and 200", 9: "speed: must be between 0 and 200; heading: must be between 0 and 360",
              10: "lat: must be between -90 and 90", 13: "lat: must be between -90 and 90"}
    texts = {k: "; ".join(x for x in (v, trip) if x) for k, v in fields.items()} | {12: "heading: must be between 0 and 360"}
    texts = {k: v for k, v in texts.items() if v}
    reasons = " ".join(f"WHEN {k} THEN '{v}'" for k, v in texts.items())
    return f"""
SELECT event_id, CASE WHEN event_id % 53 = 0 THEN 'JSON_PARSE' WHEN event_id % 53 = 1 THEN 'MISSING_TIMESTAMP'
  WHEN event_id % 53 = 4 OR event_id % 53 IN ({", ".join(map(str, texts))}) THEN 'SCHEMA_VALIDATION' WHEN event_id % 53 = 11 THEN 'GEO_BOUNDS' END AS error_type,
  CASE event_id % 53 WHEN 0 THEN 'json_parse' WHEN 4 THEN 'schema_validation' WHEN 1 THEN 'Missing required event timestamp'
    WHEN 11 THEN 'Coordinates out of bounds' {reasons} END AS error_reason FROM events"""


@query("validate_location", _contract_sql(""))
def validate_location(spark, sf):
    return validate.location_contract(validate.decode_gps(dirty_messages(spark, sf))).select("event_id", "error_type", "error_reason")


@query("validate_with_trip", _contract_sql("tripId: length must be 1..50"))
def validate_with_trip(spark, sf):
    checked = validate.location_contract(validate.decode_gps(dirty_messages(spark, sf)), require_trip=True)
    return checked.select("event_id", "error_type", "error_reason")


@query("ingest_counters", """
WITH r AS (SELECT CASE event_id % 53 WHEN 0 THEN 'JSON_PARSE' WHEN 1 THEN 'MISSING_TIMESTAMP' WHEN 11 THEN 'GEO_BOUNDS'
    ELSE CASE WHEN event_id % 53 IN (3, 4, 5, 6, 8, 9, 10, 12, 13) THEN 'SCHEMA_VALIDATION' END END AS e FROM events),
 k AS (SELECT unnest(['JSON_PARSE','MISSING_TIMESTAMP','SCHEMA_VALIDATION','GEO_BOUNDS','DUPLICATE','INACTIVE_TRIP',
  'TRIP_CACHE_REBUILDING','RATE_LIMIT','RATE_LIMIT_EVENT_TIME','SEQUENCE_ERROR','FUTURE_TIMESTAMP','STALE_REPLAY']) AS reason)
SELECT k.reason, CAST(count(r.e) AS BIGINT) AS n FROM k LEFT JOIN r ON r.e = k.reason GROUP BY 1
UNION ALL SELECT 'RECEIVED', count(*) FROM r UNION ALL SELECT 'VALIDATED', count(*) FROM r WHERE e IS NULL""")
def ingest_counters(spark, sf):
    return validate.ingest_counters(validate.location_contract(validate.decode_gps(dirty_messages(spark, sf))))


@query("validate_heartbeat", """
SELECT event_id, CASE WHEN event_id % 37 = 0 THEN 'MISSING_TIMESTAMP' WHEN event_id % 29 = 0 OR event_id % 31 = 0
    THEN 'SCHEMA_VALIDATION' END AS error_type,
  CASE WHEN event_id % 37 = 0 THEN 'Missing required event timestamp' WHEN event_id % 29 = 0 AND event_id % 31 = 0 THEN 'satellites: must be between 0 and 100; batteryVoltage: must be at least 0'
   WHEN event_id % 29 = 0 THEN 'satellites: must be between 0 and 100' WHEN event_id % 31 = 0 THEN 'batteryVoltage: must be at least 0' END AS error_reason
FROM events""")
def validate_heartbeat(spark, sf):
    rows = view(spark, sf, "tele_once")
    stamp = F.when(F.col("event_id") % 37 != 0, F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    beat = F.to_json(F.struct(
        F.col("bus_id").alias("busId"), stamp.alias("timestamp"), F.concat(F.lit("dev-"), "bus_id").alias("deviceId"),
        (F.col("event_id") % 2 == 0).alias("gpsFix"),
        F.when(F.col("event_id") % 29 == 0, 120).otherwise(F.col("event_id") % 20).alias("satellites"),
        F.when(F.col("event_id") % 31 == 0, -1.5).otherwise(3.7).alias("batteryVoltage")))
    return validate.heartbeat_contract(validate.decode_heartbeat(rows.select("event_id", beat.alias("value")))).select(
        "event_id", "error_type", "error_reason")


@query("latest_heartbeat", oracle(f"""
SELECT bus_id, arg_max(t, arrival) AS last_t, greatest(0, ({BASE_MS + 500_000} - arg_max(t, arrival)) / 1000.0d) AS age_s
FROM telemetry GROUP BY bus_id""", "telemetry"))
def latest_heartbeat(spark, sf):
    return validate.latest_heartbeat(view(spark, sf, "telemetry"), F.lit(BASE_MS + 500_000))


@query("timestamp_window", oracle("""
SELECT arrival, CASE WHEN off < -30000 THEN 'FUTURE_TIMESTAMP' WHEN off > 86400000 THEN 'STALE_REPLAY' END AS error_type
FROM (SELECT arrival, CASE event_id % 5 WHEN 0 THEN -30000 WHEN 1 THEN -30001 WHEN 2 THEN 86400000 WHEN 3 THEN 86400001 ELSE 0 END AS off
  FROM telemetry)""", "telemetry"))
def timestamp_window(spark, sf):
    rows = view(spark, sf, "telemetry")
    delay = F.expr("CASE event_id % 5 WHEN 0 THEN -30000 WHEN 1 THEN -30001 WHEN 2 THEN 86400000 WHEN 3 THEN 86400001 ELSE 0 END")
    return rows.select("arrival", validate.timestamp_window(F.col("t"), F.col("t") + delay).alias("error_type"))


@query("normalise_timestamp", oracle("SELECT arrival, t - t % 1000 AS t FROM telemetry WHERE event_id % 4 <> 3 UNION ALL "
                                     "SELECT arrival, NULL FROM telemetry WHERE event_id % 4 = 3", "telemetry"))
def normalise_timestamp(spark, sf):
    rows = view(spark, sf, "telemetry")
    iso = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(iso, F.lit("Z"))).when(F.col("event_id") % 4 == 1, iso)
            .when(F.col("event_id") % 4 == 2, F.floor(F.col("t") / 1000).cast("string")).otherwise("not a time"))
    return rows.select("arrival", F.unix_millis(scalars.parse_time(text)).alias("t"))


@query("dlq_envelope", oracle("""
SELECT arrival, CASE WHEN malformed OR event_id % 3 = 0 THEN 'topic-' || bus_id ELSE bus_id END AS bus,
  CASE WHEN NOT malformed THEN payload_trip END AS trip, CASE WHEN NOT malformed THEN t END AS event_t,
  CASE WHEN malformed THEN 'JSON_PARSE' ELSE 'GEO_BOUNDS' END AS error_type
FROM telemetry WHERE malformed OR lat = 0""", "telemetry"))
def dlq_envelope(spark, sf):
    """Rejected payload bytes as DLQ envelopes; every third one names no bus in the payload."""
    rows = view(spark, sf, "telemetry").filter("malformed OR lat = 0")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("bus_id")).alias("busId"),
                              F.col("payload_trip").alias("tripId"),
                              F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")))
    rejected = rows.select(
        "arrival", F.when(F.col("malformed"), F.lit("{bad")).otherwise(body).cast("binary").alias("payload"),
        F.concat(F.lit("transport/bus/topic-"), "bus_id", F.lit("/location")).alias("source_topic"),
        F.when(F.col("malformed"), "JSON_PARSE").otherwise("GEO_BOUNDS").alias("error_type"),
        F.lit("rejected").alias("error_reason"), F.timestamp_millis("t").alias("received_at"))
    with_meta = validate.dlq_metadata(rejected)
    return with_meta.select("arrival", F.col("dlq_bus").alias("bus"), F.col("dlq_trip").alias("trip"),
                            F.unix_millis(F.to_timestamp("event_timestamp")).alias("event_t"), "error_type")


@query("device_config", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'I:' || (1000 * (event_id % 60)) || ',H:30000'
  WHEN event_id % 4 = 2 THEN 'H:30000' WHEN event_id % 4 = 1 THEN 'I:' || (1000 * (event_id % 60)) || ',B:bus' || user_id END AS config,
  CASE WHEN event_id % 4 = 0 THEN 'EMPTY_CONFIG' END AS problem FROM events""")
def device_config(spark, sf):
    rows = view(spark, sf, "ev")
    kind = F.col("event_id") % 4
    text = scalars.device_config(F.when(kind.isin(1, 3), 1000 * (F.col("event_id") % 60)),
                                 F.when(kind.isin(2, 3), F.lit(30000)),
                                 F.when(kind == 1, F.concat(F.lit("bus"), F.col("user_id").cast("string"))))
    return rows.select("event_id", text.alias("config"), F.when(text.isNull(), "EMPTY_CONFIG").alias("problem"))


_INGEST = {
    "rows_": f"SELECT *, coalesce(payload_trip, 'none') AS trip_id FROM cleaned",
    "accepted": """SELECT bus_id, arrival, t, CAST(1 AS BIGINT) AS n FROM rows_
        QUALIFY row_number() OVER (PARTITION BY bus_id ORDER BY arrival) = 1
        UNION ALL
        SELECT a.bus_id, min(r.arrival), arg_min(r.t, r.arrival), a.n + 1 FROM accepted a
        JOIN rows_ r ON r.bus_id = a.bus_id AND r.arrival > a.arrival AND r.t >= a.t + 1000 GROUP BY a.bus_id, a.n""",
}
_ingest_sql = oracle("""
SELECT r.arrival, CASE WHEN a.arrival IS NOT NULL THEN NULL WHEN o.arrival IS NOT NULL THEN 'DUPLICATE'
  WHEN r.t < l.t THEN 'SEQUENCE_ERROR' ELSE 'RATE_LIMIT_EVENT_TIME' END AS verdict
FROM rows_ r LEFT JOIN accepted a ON a.bus_id = r.bus_id AND a.arrival = r.arrival
ASOF LEFT JOIN accepted l ON l.bus_id = r.bus_id AND r.arrival > l.arrival
LEFT JOIN (SELECT a.*, x.trip_id, x.lat, x.lon FROM accepted a JOIN rows_ x ON x.bus_id = a.bus_id AND x.arrival = a.arrival) o
  ON o.bus_id = r.bus_id AND o.t = r.t AND o.trip_id = r.trip_id AND o.lat = r.lat AND o.lon = r.lon
  AND o.arrival < r.arrival AND l.n - o.n < 100""", "telemetry", extra={**S.parts(["cleaned"]), **_INGEST}).replace(
    "WITH ", "WITH RECURSIVE ", 1)


@query("stateful_ingest", _ingest_sql)
def stateful_ingest(spark, sf):
    rows = S.cleaned(spark, sf).withColumn("trip_id", F.coalesce("payload_trip", F.lit("none")))
    return validate.stateful_ingest(rows, width=chunked.ARRIVAL_CHUNK).select("arrival", "verdict")


@query("strictly_newer", oracle("SELECT bus_id, arrival, t FROM newer", "telemetry", "lifecycle", extra=S.parts(
    ["cleaned", "marks", "line", "behind", "newer"])))
def strictly_newer(spark, sf):
    return context.strictly_newer(S.cleaned(spark, sf).select("bus_id", "arrival", "t"), chunked.ARRIVAL_CHUNK)


@query("bootstrap_trips", oracle("SELECT * FROM boot", "trips", "schedules", extra=S.parts(["boot"])))
def bootstrap_trips(spark, sf):
    return S.bootstrap(spark, sf)


_STATUS = """CASE WHEN mark_event = 'TRIP_STARTED' THEN 'ACTIVE' WHEN mark_event = 'TRIP_ENDED' THEN 'INACTIVE'
  WHEN has_boot THEN 'ACTIVE' WHEN route_id IS NOT NULL THEN 'ACTIVE' ELSE 'INACTIVE' END"""


@query("trip_context", oracle(f"SELECT bus_id, arrival, t, trip_id, route_id, {_STATUS} AS trip_status FROM ctx",
                              *S.CONTEXT_VIEWS, extra=S.parts(S.CONTEXT_PARTS)))
def trip_context(spark, sf):
    return S.in_context(spark, sf).select("bus_id", "arrival", "t", "trip_id", "route_id", "trip_status")


_ACTIVE = {
    "last_start": "SELECT bus_id, max(arrival) AS arrival FROM lifecycle WHERE event = 'TRIP_STARTED' GROUP BY bus_id",
    "started": "SELECT l.* FROM lifecycle l JOIN last_start USING (bus_id, arrival)",
    "active": """SELECT * FROM started s WHERE NOT EXISTS (SELECT 1 FROM lifecycle e WHERE e.bus_id = s.bus_id
        AND e.trip_id = s.trip_id AND e.event = 'TRIP_ENDED' AND e.arrival > s.arrival)""",
}


@query("active_trips", oracle("SELECT bus_id, trip_id, route_id, t AS started_t FROM active", "lifecycle", extra=_ACTIVE))
def active_trips(spark, sf):
    return context.active_trips(view(spark, sf, "lifecycle")).select("bus_id", "trip_id", "route_id", "started_t")


@query("trip_cache_status", oracle("""SELECT (SELECT count(*) FROM active) AS active_trip_count,
  (SELECT arg_max(t, arrival) FROM lifecycle) AS last_lifecycle_t""", "lifecycle", extra=_ACTIVE))
def trip_cache_status(spark, sf):
    return context.trip_cache_status(view(spark, sf, "lifecycle"))


@query("require_active_trip", oracle("""
SELECT t.arrival, a.trip_id, CASE WHEN a.trip_id IS NULL THEN 'INACTIVE_TRIP' END AS error_type
FROM telemetry t LEFT JOIN active a ON a.bus_id = t.bus_id""", "telemetry", "lifecycle", extra=_ACTIVE))
def require_active_trip(spark, sf):
    active = context.active_trips(view(spark, sf, "lifecycle"))
    return context.require_active_trip(view(spark, sf, "telemetry"), active).select("arrival", "trip_id", "error_type")


@query("scaffold_context", oracle("""
SELECT t.arrival, coalesce(t.payload_trip, a.trip_id) AS trip_id, a.route_id,
  CASE WHEN a.trip_id IS NULL THEN 'inactive' ELSE 'active' END AS trip_status
FROM telemetry t LEFT JOIN active a ON a.bus_id = t.bus_id""", "telemetry", "lifecycle", extra=_ACTIVE))
def scaffold_context(spark, sf):
    rows = view(spark, sf, "telemetry").withColumn("payload_route", F.lit(None).cast("string"))
    return context.scaffold_context(rows, context.active_trips(view(spark, sf, "lifecycle"))).select(
        "arrival", "trip_id", "route_id", "trip_status")


@query("startup_buffer", oracle("""
SELECT arrival, CASE WHEN arrival < 12000 THEN 12000 ELSE arrival END AS evaluate_at,
  CASE WHEN arrival < 12000 AND arrival > (SELECT max(arrival) FROM (SELECT arrival FROM telemetry WHERE arrival < 12000
    ORDER BY arrival LIMIT 1000)) THEN 'TRIP_CACHE_REBUILDING' END AS error_type FROM telemetry""", "telemetry"))
def startup_buffer(spark, sf):
    return context.startup_buffer(view(spark, sf, "telemetry"), 12000).select("arrival", "evaluate_at", "error_type")


@query("route_progress", oracle("""
SELECT 'r' || c.arrival AS pk, round(n.along_m, 2) AS along_m, round(n.total - n.along_m, 2) AS remaining_m,
  round(n.along_m / n.total * 100, 4) AS progress_pct, round(n.off_m, 2) AS off_m
FROM ctx c JOIN near n ON n.pk = 'r' || c.arrival""", "telemetry", "route_points", extra=S.parts(
    ["cleaned", *S.GEO_PARTS], ctx="SELECT *, CAST(home_route AS STRING) AS route_id FROM cleaned",
    pts="SELECT 'r' || arrival AS pk, route_id, lat, lon FROM ctx", **{n: S.SQL[n] for n in S.NEAR_PARTS})))
def route_progress(spark, sf):
    """Every cleaned reading projected onto the bus's home route."""
    rows = S.cleaned(spark, sf).withColumn("route_id", (F.col("bus_id").cast("long") % 5).cast("string"))
    lines, _, cells = S.dimensions(spark, sf)
    placed = geo.route_position(geo.with_near_segments(rows.join(lines, "route_id"), cells))
    return placed.select(F.concat(F.lit("r"), F.col("arrival").cast("string")).alias("pk"),
                         F.round("pos.along_m", 2).alias("along_m"), F.round("pos.remaining_m", 2).alias("remaining_m"),
                         F.round("pos.progress_pct", 4).alias("progress_pct"), F.round("pos.off_m", 2).alias("off_m"))


_ENRICHED_COLUMNS = ["bus_id", "arrival", "t", "trip_id", "route_id", "off_route", "off_route_m", "remaining_m", "progress_pct",
                     "next_stop_m", "segment_mode"]


@query("enriched_telemetry", oracle(
    f"SELECT {', '.join(_ENRICHED_COLUMNS)}, {_STATUS} AS trip_status, CAST(next_stop_id AS BIGINT) AS next_stop_id, "
    "CAST(stops_remaining AS BIGINT) AS stops_remaining FROM enriched",
    *S.ENRICHED_VIEWS, extra=S.parts(S.ENRICHED_PARTS)))
def enriched_telemetry(spark, sf):
    """The cleaned stream: dedupe, trip context, projection, stops ahead."""
    return S.enriched(spark, sf).select(*_ENRICHED_COLUMNS, "trip_status", F.col("next_stop_id").cast("long"),
                                        F.col("stops_remaining").cast("long"))


@query("stops_ahead", oracle(
    "SELECT arrival, CAST(stop_id AS BIGINT) AS stop_id, stop_name, CAST(stop_order AS BIGINT) AS stop_order, ahead_m FROM ahead",
    *S.ENRICHED_VIEWS, extra=S.parts(S.ENRICHED_PARTS)))
def stops_ahead(spark, sf):
    return S.enriched(spark, sf).select("arrival", F.inline("stops_ahead")).select(
        "arrival", F.col("stopId").cast("long").alias("stop_id"), F.col("stopName").alias("stop_name"),
        F.col("stopOrder").cast("long").alias("stop_order"), F.col("distanceAlongRouteMeters").alias("ahead_m"))


@query("scaffold_physics", oracle("""
SELECT j.arrival, j.invalid_reason, round(d.m, 2) AS route_deviation_m, d.m <= 50 AS on_route
FROM judged j LEFT JOIN d USING (arrival)""", "telemetry", "route_points", extra={
    "judged": """SELECT *, CASE WHEN lat IS NULL THEN 'MISSING_COORDINATES' WHEN speed > 120 THEN 'UNREALISTIC_SPEED' END
        AS invalid_reason FROM telemetry WHERE NOT malformed""",
    "d": f"""SELECT j.arrival, min({S.hav('j.lat', 'j.lon', 'p.lat', 'p.lon')}) AS m FROM judged j JOIN route_points p
        ON j.event_id % 3 = 0 OR p.route_id = j.home_route WHERE invalid_reason IS NULL GROUP BY 1"""}))
def scaffold_physics(spark, sf):
    """Nearest-vertex rule; every third reading names no route and is compared with all of them."""
    rows = view(spark, sf, "telemetry").filter("NOT malformed").withColumn(
        "route_id", F.when(F.col("event_id") % 3 != 0, F.col("home_route")))
    out = spatial.scaffold_classify(rows, view(spark, sf, "route_points"), ["arrival"])
    return out.select("arrival", "invalid_reason", "route_deviation_m", "on_route")


@query("leg_bearings", oracle(f"""
SELECT route_id, seq, round(CASE WHEN b < 0 THEN b + 360 ELSE b END, 1) AS bearing, round(len / 1000, 6) AS leg_km FROM (
  SELECT *, degrees(atan2(sin(radians(lon2 - lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2))
    - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2 - lon1)))) AS b FROM measured)""",
    "route_points", extra=S.parts(["legs", "measured"])))
def leg_bearings(spark, sf):
    legs = S.shapes(spark, sf, text_key=False).select("route_id", F.inline("segments"))
    return legs.select("route_id", "seq", geo.bearing_deg(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("bearing"),
                       F.round(geo.haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")), 6).alias("leg_km"))


@query("route_lengths", oracle("SELECT route_id, round(sum(len), 2) AS total_m, count(*) AS n_legs FROM measured GROUP BY 1",
                               "route_points", extra=S.parts(["legs", "measured"])))
def route_lengths(spark, sf):
    return S.shapes(spark, sf, text_key=False).select("route_id", F.round("total_m", 2).alias("total_m"),
                                                      F.size("segments").cast("long").alias("n_legs"))


@query("latest_positions", oracle("""
SELECT bus_id, arg_max(t, t) AS t, arg_max(lat, t) AS lat, arg_max(lon, t) AS lon, arg_max(speed, t) AS speed FROM newer_full GROUP BY 1""",
    "telemetry", "lifecycle", extra=S.parts(["cleaned", "marks", "line", "behind", "newer"],
                                            newer_full="SELECT c.* FROM cleaned c JOIN newer n USING (bus_id, arrival)")))
def latest_positions(spark, sf):
    """Snapshot of the newest reading per bus (a max_by, which combines before the shuffle)."""
    rows = context.strictly_newer(S.cleaned(spark, sf).select("bus_id", "arrival", "t", "lat", "lon", "speed"), chunked.ARRIVAL_CHUNK)
    return rows.groupBy("bus_id").agg(F.max_by(F.struct("t", "lat", "lon", "speed"), "t").alias("s")).select("bus_id", "s.*")


@query("history_points", oracle("""
SELECT bus_id, arrival, 'lat' AS field, lat AS value FROM cleaned UNION ALL SELECT bus_id, arrival, 'lon', lon FROM cleaned
UNION ALL SELECT bus_id, arrival, 'speed', speed FROM cleaned UNION ALL SELECT bus_id, arrival, 'heading', heading FROM cleaned""",
    "telemetry", extra=S.parts(["cleaned"])))
def history_points(spark, sf):
    """Readings as long-format points: numeric columns become fields, the rest tags."""
    from busline.sinks.writers import to_points
    points = to_points(S.cleaned(spark, sf).select("bus_id", "arrival", "t", "lat", "lon", "speed", "heading"),
                       "gps_readings", time="t", tags=["bus_id", "arrival"])
    return points.select(F.col("tags.bus_id").alias("bus_id"), F.col("tags.arrival").cast("long").alias("arrival"), "field", "value")


@query("history_pivot", oracle(f"""
SELECT bus_id, arrival, lat, lon, speed, heading FROM cleaned WHERE t >= {AS_OF_MS} - 19700000""", "telemetry",
    extra=S.parts(["cleaned"])))
def history_pivot(spark, sf):
    """Range scan of long points, pivoted back to one row per reading."""
    from busline.sinks.writers import to_points
    from busline.sources.readers import history_scan
    points = to_points(S.cleaned(spark, sf).select("bus_id", "arrival", "t", "lat", "lon", "speed", "heading"),
                       "gps_readings", time="t", tags=["bus_id", "arrival"])
    wide = history_scan(points, AS_OF_MS, 19_700_000, "gps_readings", ["lat", "lon", "speed", "heading"])
    return wide.select(F.col("tags.bus_id").alias("bus_id"), F.col("tags.arrival").cast("long").alias("arrival"),
                       "lat", "lon", "speed", "heading")
