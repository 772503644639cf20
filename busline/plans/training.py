"""Queries that prepare, train and judge models."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked, detect, forest, hotspots, seasonal, train
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import oracle, view
from busline.sources import readers

HISTORY_END = 1_775_001_600_000 + 240 * 3_600_000

_HOURLY = {
    "onroute": "SELECT * FROM eta_records WHERE NOT off_route",
    "hourly": "SELECT route_id, stop_id, t - t % 3600000 AS hour_ms, avg(eta_seconds) AS eta_seconds FROM onroute GROUP BY ALL",
}


@query("newest_records", oracle("SELECT trip_id, t, line FROM eta_records ORDER BY t DESC, record_seq DESC, line DESC LIMIT 500", "eta_records"))
def newest_records(spark, sf):
    rows = view(spark, sf, "eta_records")
    return readers.eta_record_scan(rows, 500, ["t", "record_seq", "line"]).select("trip_id", "t", "line")


@query("hourly_means", oracle(f"SELECT route_id, stop_id, hour_ms, {S.steady_sql('eta_seconds', 6)} AS eta_seconds FROM hourly", "eta_records",
                              extra=_HOURLY))
def hourly_means(spark, sf):
    return train.hourly_means(readers.seasonal_scan(view(spark, sf, "eta_records"))).withColumn("eta_seconds", S.steady("eta_seconds", 6))


@query("hold_out", oracle("""SELECT route_id, stop_id, hour_ms, row_number() OVER (PARTITION BY route_id, stop_id ORDER BY hour_ms DESC)
  <= least(24, count(*) OVER (PARTITION BY route_id, stop_id) // 4) AS held_out FROM hourly""", "eta_records", extra=_HOURLY))
def hold_out(spark, sf):
    return train.hold_out(train.hourly_means(readers.seasonal_scan(view(spark, sf, "eta_records")))).select(
        "route_id", "stop_id", "hour_ms", "held_out")


def _models(spark, sf):
    # the hourly table is a small fraction of the records and is read by several steps
    return seasonal.fit(S.materialised(train.hourly_means(readers.seasonal_scan(view(spark, sf, "eta_records")))))


@query("seasonal_models")
def seasonal_models(spark, sf):
    """Seasonal model table with hold-out error (no solver in SQL to compare with)."""
    return _models(spark, sf)


@query("seasonal_forecasts")
def seasonal_forecasts(spark, sf):
    asked = view(spark, sf, "ev").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 6).alias("route_id"),
                                         (F.col("event_id") % 6).alias("stop_id"))
    return seasonal.lookup(asked, _models(spark, sf)).select("request_id", "seasonal_eta")


@query("training_sufficiency", oracle(f"""
SELECT round(greatest(0, ({HISTORY_END} - min(t)) / 86400000.0d), 6) AS history_days, count(*) AS record_count,
 (SELECT count(*) FROM (SELECT 1 FROM eta_records WHERE t >= {HISTORY_END} - 48 * 3600000 GROUP BY route_id, stop_id HAVING count(*) >= 10)) AS ready_stops,
 '' AS reasons, true AS sufficient FROM eta_records""", "eta_records"))
def training_sufficiency(spark, sf):
    rows = view(spark, sf, "eta_records")
    return train.sufficiency(rows, rows, HISTORY_END).withColumn("history_days", F.round("history_days", 6))


@query("error_metrics", oracle(f"""SELECT route_id, CAST(floor(t / 3600000) % 24 AS BIGINT) AS hour, {S.steady_sql('sqrt(avg(pow(eta_seconds - distance_m / 100, 2)))', 6)} AS rmse,
  {S.steady_sql('avg(abs(eta_seconds - distance_m / 100))', 6)} AS mae, count(*) AS n FROM eta_records GROUP BY ALL""", "eta_records"))
def error_metrics(spark, sf):
    """Errors of a naive estimate per route and hour."""
    rows = view(spark, sf, "eta_records").withColumns({"naive": F.col("distance_m") / 100, "hour": F.hour(F.timestamp_millis("t")).cast("long")})
    out = train.error_metrics(rows, "eta_seconds", "naive", ["route_id", "hour"])
    return out.withColumns({"rmse": S.steady("rmse", 6), "mae": S.steady("mae", 6)})


@query("promotable_models", oracle("""SELECT route_id, stop_id FROM (SELECT route_id, stop_id, sqrt(avg(pow(eta_seconds - 500, 2))) AS rmse FROM eta_records
  GROUP BY ALL) WHERE rmse < 288""", "eta_records"))
def promotable_models(spark, sf):
    rows = view(spark, sf, "eta_records").withColumn("flat", F.lit(500.0))
    limits = C.Thresholds(promote_rmse=288.0)
    return train.promotable(train.error_metrics(rows, "eta_seconds", "flat", ["route_id", "stop_id"]), limits).select("route_id", "stop_id")


@query("eta_features", oracle("""SELECT trip_id, line, greatest(distance_m, 0) AS distance_m, greatest(speed_ms, 1.4d) AS speed_ms,
  CAST(floor(t / 3600000) % 24 AS DOUBLE) AS hour_of_day, CAST((floor(t / 86400000) + 3) % 7 AS DOUBLE) AS day_of_week,
  CAST((floor(t / 86400000) + 3) % 7 >= 5 AS DOUBLE) AS is_weekend, CAST(stops_remaining AS DOUBLE) AS stops_remaining,
  round(greatest(distance_m, 0) / greatest(speed_ms, 1.4d), 6) AS physics_eta FROM eta_records""", "eta_records"))
def eta_features(spark, sf):
    rows = train.eta_features(view(spark, sf, "eta_records"))
    return rows.select("trip_id", "line", *C.ETA_FEATURES[:-1], F.round("physics_eta", 6).alias("physics_eta"))


@query("eta_model_metrics")
def eta_model_metrics(spark, sf):
    """Boosted trees on the records: held-out error per route, with the physics clamp applied."""
    from busline.operators import eta
    rows = S.materialised(train.eta_features(view(spark, sf, "eta_records")).select("route_id", "record_seq", "line", "eta_seconds", *C.ETA_FEATURES))
    fit_on, test_on = train.split_by_hash(rows, ["record_seq", "line"])
    model = train.train_eta_model(fit_on)
    scored = train.score_eta(model, test_on).withColumn("_t", eta.tree_outcome(F.col("distance_m"), F.col("speed_ms"), F.col("tree_eta")))
    return train.error_metrics(scored.withColumn("predicted", F.col("_t.eta_seconds")), "eta_seconds", "predicted", ["route_id"])


@query("forest_verdicts")
def forest_verdicts(spark, sf):
    """Isolation forest over behaviour windows: score and verdict of every window, and the method that raised an alert."""
    windows = S.materialised(detect.behaviour_windows(S.enriched(spark, sf)))
    trees = forest.grow_forest(windows, C.BEHAVIOURAL_FEATURES, ["bus_id", "t"], trees=200)
    judged = S.materialised(forest.verdict(forest.score(windows, trees, C.BEHAVIOURAL_FEATURES)))
    alerts = detect.erratic_driving(judged, F.col("forest_anomaly")).select("bus_id", "t", F.get_json_object("detail", "$.detectionMethod").alias("method"))
    return judged.join(alerts, ["bus_id", "t"], "left").select("bus_id", "t", "forest_score", "forest_anomaly", "method")


@query("spatial_features", oracle(f"""SELECT bus_id, t, off_route_m AS route_deviation_meters, speed AS speed_kmh,
  CASE WHEN speed < 2 THEN (t - min(t) OVER (PARTITION BY bus_id, spell, speed < 2)) / 1000.0d ELSE 0 END AS stationary_duration_sec,
  next_stop_m AS distance_to_next_stop_m, progress_pct AS route_progress_pct FROM (
    SELECT *, sum(CASE WHEN speed < 2 THEN 0 ELSE 1 END) OVER (PARTITION BY bus_id ORDER BY t) AS spell FROM enriched WHERE route_id IS NOT NULL)""",
    *S.ENRICHED_VIEWS, extra=S.parts(S.ENRICHED_PARTS)))
def spatial_features(spark, sf):
    """Inputs of the spatial forest, with the running stationary duration."""
    return detect.spatial_features(S.enriched(spark, sf))


@query("spatial_verdicts")
def spatial_verdicts(spark, sf):
    """Isolation forest over the spatial features: score and verdict of every reading."""
    rows = S.materialised(detect.spatial_features(S.enriched(spark, sf)))
    trees = forest.grow_forest(rows, C.SPATIAL_FEATURES, ["bus_id", "t"], trees=200)
    return forest.verdict(forest.score(rows, trees, C.SPATIAL_FEATURES)).select("bus_id", "t", "forest_score", "forest_anomaly")


_CELLS = {
    "zeros": "SELECT floor(lat / 0.0005d) AS cy, floor(lon / 0.0005d) AS cx FROM cleaned WHERE speed < 5",
    "cells": "SELECT CAST(cy AS BIGINT) AS cy, CAST(cx AS BIGINT) AS cx, count(*) AS n FROM zeros GROUP BY ALL",
    "dense": """SELECT a.cy, a.cx, a.n FROM cells a JOIN cells b ON abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 GROUP BY ALL HAVING sum(b.n) >= 10""",
    "reach": """SELECT cy, cx, cy AS ly, cx AS lx FROM dense UNION
        SELECT d.cy, d.cx, r.ly, r.lx FROM reach r JOIN dense d ON abs(d.cy - r.cy) <= 1 AND abs(d.cx - r.cx) <= 1""",
    "labels_": "SELECT cy, cx, min((ly, lx)) AS label FROM reach GROUP BY ALL",
}


@query("stationary_hotspots", oracle("""SELECT CAST(sum(d.n) AS BIGINT) AS points, count(*) AS cells FROM labels_ l JOIN dense d USING (cy, cx) GROUP BY label""",
                                     "telemetry", extra=S.parts(["cleaned"], **_CELLS)).replace("WITH ", "WITH RECURSIVE ", 1))
def stationary_hotspots(spark, sf):
    """Clusters of near-zero-speed readings over the whole history."""
    still = S.cleaned(spark, sf).filter("speed < 5").withColumn("speed", F.lit(0.0))
    return hotspots.clusters(hotspots.dense_cells(still)).select("points", "cells")


@query("calendar_fields", oracle("""SELECT arrival, CAST(extract(hour FROM ts) BETWEEN 7 AND 9 OR extract(hour FROM ts) BETWEEN 17 AND 19 AS BOOLEAN) AS rush,
  CAST(dayofweek(ts) AS BIGINT) AS sun0, strftime(ts, '%Y_%m') AS month FROM (SELECT arrival, make_timestamp((t + arrival * 3600000) * 1000) AS ts FROM telemetry)""", "telemetry"))
def calendar_fields(spark, sf):
    at = F.timestamp_millis(F.col("t") + F.col("arrival") * 3600000)
    return view(spark, sf, "telemetry").select(
        "arrival", scalars.is_rush_hour(at).alias("rush"), scalars.weekday_sun0(at).cast("long").alias("sun0"),
        scalars.month_partition(at, "").alias("month"))


@query("identity_hashes", oracle("SELECT arrival, sha256(concat_ws('_', bus_id, payload_trip, t::VARCHAR, lat::VARCHAR, lon::VARCHAR)) AS identity FROM telemetry", "telemetry"))
def identity_hashes(spark, sf):
    return view(spark, sf, "telemetry").select("arrival", scalars.identity_hash(*[F.col(c) for c in ("bus_id", "payload_trip", "t", "lat", "lon")]).alias("identity"))


@query("ready_stops", oracle(f"SELECT count(*) AS ready_stops FROM (SELECT 1 FROM eta_records WHERE t >= {HISTORY_END} - 172800000 GROUP BY route_id, stop_id HAVING count(*) >= 10)", "eta_records"))
def ready_stops(spark, sf):
    return train.ready_stops(view(spark, sf, "eta_records"), HISTORY_END)


