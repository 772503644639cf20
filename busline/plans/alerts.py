"""Queries over the cleaned stream: anomaly alerts, dwell, stop zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked, detect, dwell
from busline.plans import shared as S
from busline.plans.registry import ORACLES, query
from busline.plans.views import AS_OF_MS, oracle, view


def _sql(select: str, **extra: str) -> str:
    return oracle(select, *S.ENRICHED_VIEWS, extra=S.parts(S.ENRICHED_PARTS, **extra))


_ACTIVE = "SELECT * FROM enriched WHERE route_id IS NOT NULL"


def _alert_sql(kind: str, message: str, source: str | None = None) -> str:
    """Columns of an alert, from a row that has the reading's."""
    severity = "HIGH" if kind in C.HIGH_SEVERITY else "MEDIUM"
    origin = f"'{source}'" if source else "CAST(NULL AS VARCHAR)"
    return (f"bus_id, t, '{kind}' AS anomaly_type, '{severity}' AS severity, {message} AS message, trip_id, route_id, lat, lon, "
            f"'{detect.RULES_VERSION}' AS model_version, {origin} AS source")


def _alerts(alerts: DataFrame, *more: Column) -> DataFrame:
    return alerts.select("bus_id", "t", "anomaly_type", "severity", "message", "trip_id", "route_id", F.col("location.lat").alias("lat"),
                         F.col("location.lon").alias("lon"), "model_version", "source", *more)


def _detail(name: str, kind: str) -> Column:
    return F.get_json_object("detail", f"$.{name}").cast(kind)


@query("alert_unrealistic_speed", _sql(f"SELECT {_alert_sql('UNREALISTIC_SPEED', repr('Speed exceeded 120 km/h'))} FROM enriched WHERE speed > 120"))
def alert_unrealistic_speed(spark, sf):
    return _alerts(detect.unrealistic_speed(S.enriched(spark, sf)))


@query("alert_inactive_gps", _sql(f"SELECT {_alert_sql('INACTIVE_GPS', repr('GPS received for inactive trip'))} FROM enriched WHERE route_id IS NULL"))
def alert_inactive_gps(spark, sf):
    return _alerts(detect.inactive_gps(S.enriched(spark, sf)))


_OFF_ROUTE = "'Bus deviated by ' || CAST(round_even(off_route_m, 0) AS BIGINT) || 'm from route'"


@query("alert_off_route", _sql(f"SELECT {_alert_sql('OFF_ROUTE', _OFF_ROUTE)} FROM enriched WHERE off_route AND route_id IS NOT NULL"))
def alert_off_route(spark, sf):
    return _alerts(detect.off_route(S.enriched(spark, sf)))


_STREAK = {
    "act": _ACTIVE,
    "runs": """SELECT *, coalesce(max(CASE WHEN NOT off_route THEN t END) OVER (PARTITION BY bus_id ORDER BY t
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS run FROM act""",
    "offs": "SELECT * FROM runs WHERE off_route",
    "anchors": """SELECT bus_id, run, min(t) AS t FROM offs GROUP BY ALL
        UNION ALL
        SELECT a.bus_id, a.run, min(o.t) FROM anchors a JOIN offs o ON o.bus_id = a.bus_id AND o.run = a.run AND o.t > a.t + 5000
        GROUP BY a.bus_id, a.run, a.t""",
    "placed": """SELECT o.bus_id, o.t, o.off_route_m, row_number() OVER (PARTITION BY o.bus_id, o.run, a.t ORDER BY o.t) AS n,
        o.trip_id, o.route_id, o.lat, o.lon FROM offs o ASOF JOIN anchors a ON o.bus_id = a.bus_id AND o.run = a.run AND o.t >= a.t""",
}


@query("alert_persistent_off_route", _sql(f"""SELECT {_alert_sql('PERSISTENT_OFF_ROUTE', repr('Bus remained off-route for 3 readings within 5s'))},
  off_route_m FROM placed WHERE n = 3""", **_STREAK).replace(
    "WITH ", "WITH RECURSIVE ", 1))
def alert_persistent_off_route(spark, sf):
    out = detect.off_route_streaks(S.enriched(spark, sf), width=chunked.HOUR_MS)
    return _alerts(out, _detail("offRouteDistanceM", "double").alias("off_route_m"))


_BEHAVIOUR = {
    "act": _ACTIVE,
    "acc": """SELECT *, CASE WHEN t > lag(t) OVER w THEN (speed - lag(speed) OVER w) / ((t - lag(t) OVER w) / 1000.0d) END AS a,
        count(*) OVER (PARTITION BY bus_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS n
        FROM act WINDOW w AS (PARTITION BY bus_id ORDER BY t)""",
    "vec": """SELECT bus_id, t, n, coalesce(max(a) OVER p, 0) AS max_acceleration, coalesce(min(a) OVER p, 0) AS min_acceleration,
        var_pop(speed) OVER f AS speed_variance, var_pop(heading) OVER f AS heading_variance, avg(speed) OVER f AS average_speed,
        trip_id, route_id, lat, lon
        FROM acc WINDOW p AS (PARTITION BY bus_id ORDER BY t ROWS BETWEEN 18 PRECEDING AND CURRENT ROW),
        f AS (PARTITION BY bus_id ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
}


_VECTOR = ["max_acceleration", "min_acceleration", "speed_variance", "heading_variance", "average_speed"]


@query("behaviour_windows", _sql("SELECT bus_id, t, CAST(n AS BIGINT) AS sample_count, "
                                 + ", ".join(f"{S.steady_sql(c, 4)} AS {c}" for c in _VECTOR) + " FROM vec WHERE n >= 10", **_BEHAVIOUR))
def behaviour_windows(spark, sf):
    out = detect.behaviour_windows(S.enriched(spark, sf), width=chunked.HOUR_MS)
    return out.select("bus_id", "t", F.col("sample_count").cast("long").alias("sample_count"),
                      *[S.steady(c, 4).alias(c) for c in _VECTOR])


@query("alert_erratic_driving", _sql(f"""SELECT {_alert_sql('ERRATIC_DRIVING', repr('Behavioral anomaly detected (rule fallback)'))},
  'rules_fallback' AS method FROM vec
  WHERE n >= 10 AND ((speed_variance >= 8 AND heading_variance >= 5) OR max_acceleration >= 3)""", **_BEHAVIOUR))
def alert_erratic_driving(spark, sf):
    windows = detect.behaviour_windows(S.enriched(spark, sf), width=chunked.HOUR_MS)
    return _alerts(detect.erratic_driving(windows), _detail("detectionMethod", "string").alias("method"))


@query("summary_vectors", oracle(f"""
SELECT bus_id, {S.steady_sql('coalesce(max(a), 0)', 4)} AS max_acceleration, {S.steady_sql('coalesce(min(a), 0)', 4)} AS min_acceleration,
  {S.steady_sql('CASE WHEN count(*) > 1 THEN var_pop(speed) ELSE 0 END', 4)} AS speed_variance, CAST(count(*) AS BIGINT) AS sample_count FROM (
  SELECT *, CASE WHEN t > lag(t) OVER w THEN (speed - lag(speed) OVER w) / ((t - lag(t) OVER w) / 1000.0d) END AS a FROM newer_full
  WINDOW w AS (PARTITION BY bus_id, win ORDER BY t)) GROUP BY bus_id, win""", "telemetry", "lifecycle", extra=S.parts(
    ["cleaned", "marks", "line", "behind", "newer"],
    newer_full="SELECT c.*, floor(c.t / 60000) AS win FROM cleaned c JOIN newer n USING (bus_id, arrival)")))
def summary_vectors(spark, sf):
    """Training vectors of finished one-minute windows."""
    from busline.operators import context
    rows = context.strictly_newer(S.cleaned(spark, sf).select("bus_id", "arrival", "t", "speed", "heading"),
                                  chunked.ARRIVAL_CHUNK).withColumn("win", F.floor(F.col("t") / 60000))
    out = detect.summary_vector(rows, ["bus_id", "win"])
    return out.select("bus_id", *[S.steady(c, 4).alias(c) for c in ("max_acceleration", "min_acceleration", "speed_variance")],
                      F.col("sample_count").cast("long").alias("sample_count"))


# In these windows dense groups are tight blobs, so the largest cluster is the neighbourhood of
# its busiest core point and needs no recursion.
_STATIONARY = {
    "act": _ACTIVE,
    "sized": """SELECT bus_id, t, lat, lon, trip_id, route_id, count(*) OVER w AS n, min(t) OVER w AS since FROM act
        WINDOW w AS (PARTITION BY bus_id ORDER BY t RANGE BETWEEN 300000 PRECEDING AND CURRENT ROW)""",
    "long_": "SELECT * FROM sized WHERE n >= 10 AND t - since >= 280000",
    "hoods": """SELECT w.bus_id, w.t, p.t AS pt, count(*) AS hood FROM long_ w
        JOIN act p ON p.bus_id = w.bus_id AND p.t BETWEEN w.t - 300000 AND w.t
        JOIN act q ON q.bus_id = w.bus_id AND q.t BETWEEN w.t - 300000 AND w.t
          AND pow(p.lat - q.lat, 2) + pow(p.lon - q.lon, 2) <= 0.0005d * 0.0005d GROUP BY ALL""",
    "shares": "SELECT bus_id, t, max(CASE WHEN hood >= 10 THEN hood ELSE 0 END) AS top FROM hoods GROUP BY ALL",
    "flags": """SELECT s.bus_id, s.t, s.n, coalesce(h.top, 0) / CAST(s.n AS DOUBLE) AS share, coalesce(h.top, 0) >= s.n * 0.8d AS dense,
        s.trip_id, s.route_id, s.lat, s.lon FROM sized s LEFT JOIN shares h USING (bus_id, t)""",
}


@query("stationary_windows", _sql("""SELECT bus_id, t, CAST(n AS BIGINT) AS window_points, round(share, 6) AS share, dense FROM flags""",
                                  **_STATIONARY))
def stationary_windows(spark, sf):
    out = detect.stationary_windows(S.enriched(spark, sf), width=chunked.HOUR_MS)
    return out.select("bus_id", "t", "window_points", F.round("share", 6).alias("share"), "dense")


@query("alert_stationary", _sql(f"""SELECT {_alert_sql('STATIONARY', repr('Bus stationary (DBSCAN cluster detected) for over 5 minutes'))} FROM (SELECT *, lag(dense) OVER (PARTITION BY bus_id ORDER BY t) AS before
  FROM flags) WHERE dense AND NOT coalesce(before, false)""", **_STATIONARY))
def alert_stationary(spark, sf):
    return _alerts(detect.stationary(S.enriched(spark, sf), width=chunked.HOUR_MS))


@query("alert_stationary_by_speed", _sql(f"""SELECT {_alert_sql('STATIONARY', repr('Bus stationary for over 5 minutes'))} FROM (
  SELECT *, min(t) OVER (PARTITION BY bus_id, spell ORDER BY t) AS since FROM (
    SELECT *, sum(CASE WHEN speed < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY bus_id ORDER BY t) AS spell FROM act)
  WHERE speed < 2) WHERE t - since > 300000""", act=_ACTIVE))
def alert_stationary_by_speed(spark, sf):
    return _alerts(detect.stationary_by_speed(S.enriched(spark, sf), width=chunked.HOUR_MS))


@query("alert_communication_loss", _sql(f"""SELECT {_alert_sql('COMMUNICATION_LOSS', repr('No telemetry for over 3 minutes'))} FROM (SELECT *, coalesce(lead(t) OVER
  (PARTITION BY bus_id ORDER BY t), {AS_OF_MS}) - t AS gap FROM act) WHERE gap > 180000""", act=_ACTIVE))
def alert_communication_loss(spark, sf):
    return _alerts(detect.communication_loss(S.enriched(spark, sf), AS_OF_MS, width=chunked.HOUR_MS))


_DLQ = {
    "active_buses": "SELECT DISTINCT bus_id FROM lifecycle",
    "dlq": "SELECT t.* FROM telemetry t LEFT JOIN active_buses a USING (bus_id) WHERE a.bus_id IS NULL AND NOT malformed",
    "instants": "SELECT bus_id, t, count(*) AS here FROM dlq GROUP BY ALL",
    "seen": """SELECT *, sum(here) OVER (PARTITION BY bus_id ORDER BY t RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW) AS n
        FROM instants""",
    "full_": "SELECT * FROM seen WHERE n >= 3",
    "fired": """SELECT bus_id, min(t) AS t FROM full_ GROUP BY ALL UNION ALL
        SELECT f.bus_id, min(x.t) FROM fired f JOIN full_ x ON x.bus_id = f.bus_id AND x.t >= f.t + 300000 GROUP BY f.bus_id, f.t""",
}


@query("alert_trip_not_started", oracle(f"""SELECT {_alert_sql('TRIP_NOT_STARTED_DEVICE_ACTIVE', repr('Device is sending GPS but no active trip exists'), detect.REFUSED_SOURCE)},
  CAST(greatest(3, n - here + 1) AS BIGINT) AS dlq_count FROM (SELECT f.bus_id, f.t, n, here, CAST(NULL AS VARCHAR) AS trip_id, CAST(NULL AS VARCHAR) AS route_id, d.lat, d.lon
    FROM fired f JOIN seen USING (bus_id, t) JOIN (SELECT *, row_number() OVER (PARTITION BY bus_id, t ORDER BY arrival) AS nth FROM dlq) d
      ON d.bus_id = f.bus_id AND d.t = f.t AND d.nth = greatest(3, n - here + 1) - (n - here))""", "telemetry", "lifecycle", extra=_DLQ).replace("WITH ", "WITH RECURSIVE ", 1))
def alert_trip_not_started(spark, sf):
    """DLQ envelopes of buses that never start a trip."""
    rows = view(spark, sf, "telemetry").filter("NOT malformed").join(
        view(spark, sf, "lifecycle").select("bus_id").distinct(), "bus_id", "left_anti")
    envelopes = rows.select(
        "arrival", "t", F.lit("").alias("busId"), F.lit("INACTIVE_TRIP").alias("error_type"),
        F.lit("No active trip found").alias("error_reason"),
        F.to_json(F.struct(F.col("bus_id").alias("busId"), "lat", "lon")).alias("original_payload"))
    out = detect.trip_not_started(detect.dlq_fields(envelopes), width=chunked.HOUR_MS)
    return _alerts(out, _detail("dlqCount", "long").alias("dlq_count"))


def _totals_sql() -> str:
    """The statements of the single detectors, counted and joined with severities and channels."""
    kinds = ["UNREALISTIC_SPEED", "INACTIVE_GPS", "OFF_ROUTE", "PERSISTENT_OFF_ROUTE", "STATIONARY", "COMMUNICATION_LOSS", "ERRATIC_DRIVING"]
    counts = " UNION ALL ".join(f"SELECT '{k}' AS anomaly_type, count(*) AS n FROM ({ORACLES['alert_' + k.lower()]})" for k in kinds)
    channels = [(C.ADMIN_CHANNEL, C.ADMIN_ALERTS), (C.DRIVER_CHANNEL, C.DRIVER_ALERTS), (C.PASSENGER_CHANNEL, C.PASSENGER_ALERTS)]
    routed = ", ".join(f"('{k}', '{'HIGH' if k in C.HIGH_SEVERITY else 'MEDIUM'}', '{c}')" for c, listed in channels for k in kinds if k in listed)
    return f"""SELECT channel, anomaly_type, severity, n FROM ({counts}) JOIN (VALUES {routed}) r(anomaly_type, severity, channel)
      USING (anomaly_type) WHERE n > 0"""


@query("alert_totals", _totals_sql())
def alert_totals(spark, sf):
    """All detectors over one enriched stream, routed to their audiences and counted."""
    rows = S.materialised(S.enriched(spark, sf))
    alerts = detect.route_to_audiences(detect.detect_all(rows, AS_OF_MS, width=chunked.HOUR_MS))
    return alerts.groupBy("channel", "anomaly_type", "severity").agg(F.count("*").alias("n"))


@query("audience_routing", _sql("""SELECT bus_id, t, anomaly_type, unnest(CASE WHEN anomaly_type = 'UNREALISTIC_SPEED'
  OR anomaly_type = 'OFF_ROUTE' THEN ['anomaly:admin', 'anomaly:driver'] ELSE ['anomaly:admin'] END) AS channel FROM (
  SELECT bus_id, t, 'UNREALISTIC_SPEED' AS anomaly_type FROM enriched WHERE speed > 120
  UNION ALL SELECT bus_id, t, 'INACTIVE_GPS' FROM enriched WHERE route_id IS NULL
  UNION ALL SELECT bus_id, t, 'OFF_ROUTE' FROM enriched WHERE route_id IS NOT NULL AND off_route)"""))
def audience_routing(spark, sf):
    alerts = detect.row_alerts(S.enriched(spark, sf))
    return detect.route_to_audiences(alerts).select("bus_id", "t", "anomaly_type", "channel")


@query("off_route_status", oracle("""
SELECT event_id, off, distance_m FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_type = 'error' WHEN 1 THEN event_type <> 'error'
   WHEN 2 THEN event_type <> 'view' WHEN 3 THEN value > 50 ELSE false END AS off,
   CASE WHEN event_id % 5 < 3 THEN CASE WHEN event_id % 2 = 0 THEN value ELSE CAST(user_id AS DOUBLE) END
        WHEN event_id % 5 = 3 THEN value ELSE 0 END AS distance_m FROM ev)""", "ev"))
def off_route_status(spark, sf):
    rows = view(spark, sf, "ev")
    kind = F.col("event_id") % 5
    status = detect.off_route_status(
        F.when(kind == 0, F.col("event_type") == "error"), F.when(kind.isin(0, 1), F.col("event_type") == "error"),
        F.when(kind.isin(0, 2), F.col("event_type") == "view"),
        [F.when(F.col("event_id") % 2 == 0, F.col("value").cast("string")).otherwise("n/a"), F.col("user_id").cast("string")],
        F.when(kind == 3, F.col("value")))
    return rows.select("event_id", status.alias("s")).select("event_id", "s.off", F.col("s.distance_m").alias("distance_m"))


_ZONES = {
    "zones": "SELECT stop_id, stop_id AS zone_pos, lat, lon, CASE WHEN stop_id % 2 = 0 THEN 50.0d ELSE 400.0d END AS radius_m FROM stops",
    "hits": """SELECT c.arrival, arg_min(z.stop_id, z.zone_pos) AS stop_id FROM cleaned c JOIN zones z
        ON sqrt(pow(abs(c.lat - z.lat) * 111000, 2) + pow(abs(c.lon - z.lon) * 111000 * 0.7d, 2)) <= z.radius_m GROUP BY 1""",
}


@query("stop_resolution", oracle("SELECT c.arrival, h.stop_id FROM cleaned c LEFT JOIN hits h USING (arrival)", "telemetry", "stops",
                                 extra=S.parts(["cleaned"], **_ZONES)))
def stop_resolution(spark, sf):
    zones = view(spark, sf, "stops").withColumns({
        "zone_pos": F.col("stop_id"), "radius_m": F.when(F.col("stop_id") % 2 == 0, 50.0).otherwise(400.0)})
    return dwell.resolve_stop(S.cleaned(spark, sf), zones, ["arrival"]).select("arrival", "stop_id")


# visits: which of three stops a bus is at follows from its clock
_VISITS = {
    "visits": "SELECT c.bus_id, 'T' || c.bus_id AS trip_id, c.t, 'S' || (CAST(floor(c.t / 40000.0d) AS BIGINT) % 3) AS stop_id, c.speed FROM cleaned c JOIN newer n USING (bus_id, arrival)",
    "v1": """SELECT *, lag(t) OVER w AS pt, lag(stop_id) OVER w AS ps FROM visits WINDOW w AS (PARTITION BY bus_id, trip_id ORDER BY t)""",
    "v2": "SELECT *, pt IS NULL OR t - pt > 3600000 AS fresh FROM v1",
    "v3": """SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER w AS era,
        sum(CASE WHEN fresh OR stop_id <> ps THEN 1 ELSE 0 END) OVER w AS stay FROM v2 WINDOW w AS (PARTITION BY bus_id, trip_id ORDER BY t)""",
    "stays": "SELECT bus_id, trip_id, era, stay, min(t) AS a, max(t) AS b FROM v3 GROUP BY ALL",
    "stays2": """SELECT *, lag(CAST(floor((b - a) / 1000) AS BIGINT)) OVER (PARTITION BY bus_id, trip_id, era ORDER BY stay) AS prev FROM stays""",
    "dwells": """SELECT v.bus_id, v.t, v.stop_id, v.speed, CAST(floor((v.t - s.a) / 1000) AS BIGINT) AS dwell_current_s, s.prev AS dwell_prev_s
        FROM v3 v JOIN stays2 s USING (bus_id, trip_id, era, stay)""",
}


def _visits(spark, sf):
    from busline.operators import context
    rows = context.strictly_newer(S.cleaned(spark, sf).select("bus_id", "arrival", "t", "speed"), chunked.ARRIVAL_CHUNK)
    stop = F.concat(F.lit("S"), (F.floor(F.col("t") / 40000.0) % 3).cast("string"))
    return rows.select("bus_id", F.concat(F.lit("T"), "bus_id").alias("trip_id"), "t", stop.alias("stop_id"), "speed")


@query("dwell", oracle("SELECT bus_id, t, stop_id, dwell_current_s, dwell_prev_s FROM dwells", "telemetry", "lifecycle",
                       extra=S.parts(["cleaned", "marks", "line", "behind", "newer"], **_VISITS)))
def dwell_times(spark, sf):
    return dwell.dwell(_visits(spark, sf), width=3 * chunked.HOUR_MS).select(
        "bus_id", "t", "stop_id", "dwell_current_s", "dwell_prev_s")


@query("dwell_quality", oracle("""
SELECT d.bus_id, d.t, d.speed / 3.6d < 1 AND d.dwell_current_s > 10 AS is_dwell, d.dwell_current_s > 300 AS is_layover,
  d.dwell_prev_s IS NULL AS was_missing, coalesce(CAST(d.dwell_prev_s AS DOUBLE), median(d.dwell_prev_s) OVER (
    PARTITION BY d.stop_id, floor(d.t / 3600000) % 24)) AS filled_s FROM dwells d""", "telemetry", "lifecycle",
    extra=S.parts(["cleaned", "marks", "line", "behind", "newer"], **_VISITS)))
def dwell_quality(spark, sf):
    stays = dwell.dwell(_visits(spark, sf), width=3 * chunked.HOUR_MS).withColumns({
        "hour": F.hour(F.timestamp_millis("t")), "speed_ms": F.col("speed") / 3.6})
    return dwell.dwell_quality(stays).select("bus_id", "t", "is_dwell", "is_layover",
                                             F.col("dwell_prev_s").isNull().alias("was_missing"), F.col("dwell_prev_filled_s").alias("filled_s"))


@query("crowd_by_stop_hour", oracle("""SELECT stop_id, CAST(floor(t / 3600000) % 24 AS BIGINT) AS hour, round(avg(score), 8) AS avg_score,
  CAST(count(*) AS BIGINT) AS n FROM crowd_reports GROUP BY ALL""", "crowd_reports"))
def crowd_by_stop_hour(spark, sf):
    reports = view(spark, sf, "crowd_reports").withColumn("hour", F.hour(F.timestamp_millis("t")).cast("long"))
    return dwell.dwell_statistics(reports).withColumn("avg_score", F.round("avg_score", 8))


@query("occupancy_labels", oracle("""SELECT arrival, CASE WHEN score < 40 THEN 'NOT_FULL' WHEN score < 75 THEN 'SEMI_FULL' ELSE 'FULL' END AS label,
  CASE WHEN score < 40 THEN 20 WHEN score < 75 THEN 55 ELSE 90 END AS label_score FROM crowd_reports""", "crowd_reports"))
def occupancy_labels(spark, sf):
    rows = view(spark, sf, "crowd_reports").withColumn("label", scalars.occupancy_label(F.col("score")))
    return rows.select("arrival", "label", scalars.label_score(F.col("label")).alias("label_score"))
