"""Arrival estimates: feature gate, speed smoothing, model cascade, snapshots."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked
from busline.operators.chunked import CHUNK
from busline.operators.trees import Flat

MODELS = ("physics", "sarima", "xgboost", "default")


def missing_fields(names: list[str] | None = None) -> Column:
    """Comma-separated required fields that are absent, NULL when complete."""
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in names or C.ETA_REQUIRED_FIELDS]))
    return F.when(F.size(absent) > 0, F.concat(F.lit("Missing ETA feature fields: "), F.array_join(absent, ", ")))


def skip_reason(event: Column, off_route: Column, next_stop: Column, trip: Column) -> Column:
    """Why a reading gets no estimate; NULL if it gets one."""
    return (F.when(event == "TRIP_ENDED", "trip_ended")
            .when(F.coalesce(off_route, F.lit(False)), "off_route")
            .when(next_stop.isNull(), "NO_NEXT_STOP")
            .when(trip.isNull(), "NO_TRIP"))


def speed_ms(speed: Column, unit: str = "as-is") -> Column:
    """The stored field is taken as it is; ``kmh`` converts."""
    return speed / 3.6 if unit == "kmh" else speed


def smooth_speed(features: DataFrame, trip_ends: DataFrame | None = None, limits: C.Thresholds = C.DEFAULTS,
                 width: int = chunked.HOUR_MS) -> DataFrame:
    """Mean speed per trip over the last rows that are also recent; a trip end starts afresh.

    Needs (trip_id, t, speed_ms) with ``t`` unique per trip. Only rows and ends inside the recency window count, so each chunk
    sees copies of those before it, and one window over short lists gives the mean. An end counts before a reading of the same instant.
    Speeds are added newest first: whether a mean near the least speed counts as slow hangs on the last bit of that sum.
    """
    line = features.withColumn("_end", F.lit(None).cast("long"))
    if trip_ends is not None:
        line = line.unionByName(trip_ends.select("trip_id", "t", F.col("t").alias("_end")).distinct(), allowMissingColumns=True)
    halo = chunked.range_halo(line, "t", limits.smoothing_ms, width)
    by_time = Window.partitionBy("trip_id", CHUNK).orderBy("t", F.col("_end").isNull())
    ended = halo.withColumn("_since", F.max("_end").over(by_time.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("_end").isNull())
    last = by_time.rowsBetween(-(limits.smoothing_rows - 1), 0)
    recent = F.filter(F.collect_list(F.struct("t", "speed_ms")).over(last), lambda p: (
        (p["t"] >= F.col("t") - limits.smoothing_ms) & (F.col("_since").isNull() | (p["t"] >= F.col("_since")))))
    total = F.aggregate(F.reverse("_recent"), F.lit(0.0), lambda acc, p: acc + p["speed_ms"])
    return (ended.withColumn("_recent", recent).filter(~F.col("_halo"))
            .select(*features.columns, (total / F.size("_recent")).alias("smoothed_ms"), F.size("_recent").alias("smoothing_rows")))


def tree_outcome(distance: Column, speed: Column, predicted: Column, limits: C.Thresholds = C.DEFAULTS) -> Column:
    """Tree score with its sanity clamp: struct(eta_seconds, speed_ms, clamped, usable).

    A missing score is not usable and leaves the choice to the next model. A slow bus counts as
    clamped even when the score itself is fine.
    """
    d, v = F.greatest(distance, F.lit(0.0)), F.greatest(speed, F.lit(C.MIN_SPEED_MS))
    physics, slow = d / v, speed < C.MIN_SPEED_MS
    wild = F.abs(predicted - physics) / physics > limits.tree_deviation
    eta = F.when(d == 0, 0.0).when(wild, physics).otherwise(F.greatest(F.lit(0.0), predicted))
    clamped = F.when(d == 0, slow).when(wild, True).otherwise(slow)
    usable = (d == 0) | predicted.isNotNull()
    return F.struct(eta.alias("eta_seconds"), v.alias("speed_ms"), clamped.alias("clamped"), usable.alias("usable"))


def cascade(df: DataFrame, model: Column | str = "xgboost", distance: str = "distance_m", speed: str = "speed_ms",
            tree: str | None = "tree_eta", seasonal: str = "seasonal_eta", segment: str = "segment_mode",
            weather: float = 1.0,
            physics: Callable[[Column, Column], Column] = scalars.physics_eta) -> DataFrame:
    """Choose tree score, seasonal forecast or physics; rows that ask for an unknown model are dropped.

    ``tree`` and ``seasonal`` are score columns joined beforehand, NULL where no model exists. A bus at its stop needs no
    score, so it counts as scored by the trees; without any trees (``tree`` is None) it does not.
    ``physics`` can be replaced by any function of two columns with the same struct shape.
    """
    asked = F.lower(F.trim(model if isinstance(model, Column) else F.lit(model)))
    mode = F.lower(F.trim(F.coalesce(F.col(segment), F.lit("urban"))))
    d, v = F.col(distance), F.col(speed)
    base = physics(d, v)
    fast = scalars.expressway_eta(d, v, weather)
    simple = F.when(mode == "expressway", fast).otherwise(base)
    t = tree_outcome(d, v, F.lit(None).cast("double") if tree is None else F.col(tree))
    usable = F.lit(False) if tree is None else t["usable"]
    tree_full = F.struct(t["eta_seconds"].alias("eta_seconds"), F.greatest(d, F.lit(0.0)).alias("distance_m"),
                         t["speed_ms"].alias("speed_ms"), t["clamped"].alias("clamped"))
    forecast = F.struct(F.greatest(F.lit(0.0), F.col(seasonal)).alias("eta_seconds"), d.alias("distance_m"),
                        F.greatest(v, F.lit(C.MIN_SPEED_MS)).alias("speed_ms"), F.lit(False).alias("clamped"))

    def outcome(result: Column, used: Column, fallback: Column) -> Column:
        return F.struct(result.alias("r"), used.alias("used"), fallback.alias("fallback"))

    no = F.lit(False)
    has_forecast = F.col(seasonal).isNotNull()
    tree_kept = usable & ~t["clamped"]
    picked = (
        F.when(asked == "physics", outcome(simple, F.lit("physics"), no))
        .when((asked == "sarima") & has_forecast, outcome(forecast, F.lit("sarima"), no))
        .when((asked == "sarima") & usable,
              outcome(tree_full, F.when(t["clamped"], "physics").otherwise("xgboost"), t["clamped"]))
        .when(asked == "sarima", outcome(base, F.lit("physics"), F.lit(True)))
        .when(tree_kept, outcome(tree_full, F.lit("xgboost"), no))
        .when(has_forecast, outcome(forecast, F.lit("sarima"), no))
        .otherwise(outcome(simple, F.lit("physics"), F.lit(True))))
    return (df.filter(asked.isin(list(MODELS))).withColumn("_o", picked)
            .withColumns({"eta_seconds": F.col("_o.r.eta_seconds"), "effective_speed_ms": F.col("_o.r.speed_ms"),
                          "clamped": F.col("_o.r.clamped"), "model_used": F.col("_o.used"),
                          "fallback": F.col("_o.fallback"), "segment_mode": mode}).drop("_o"))


def feature_columns(distance: Column, speed: Column, stops_remaining: Column, at: Column) -> dict[str, Column]:
    """The tree model's inputs by name."""
    d, v = F.greatest(distance, F.lit(0.0)), F.greatest(speed, F.lit(C.MIN_SPEED_MS))
    return {"distance_m": d, "speed_ms": v, "hour_of_day": F.hour(at).cast("double"),
            "day_of_week": F.weekday(at).cast("double"), "is_weekend": scalars.is_weekend(at).cast("double"),
            "stops_remaining": F.greatest(F.lit(1), stops_remaining).cast("double"), "physics_eta": d / v}


def estimated(rows: DataFrame, trees: Flat | None = None, seasonal: DataFrame | None = None, model: str = "xgboost") -> DataFrame:
    """Arrival estimates of readings (distance_m, speed_ms, stops_remaining, route_id, next_stop_id, t, segment_mode).

    ``trees`` scores every reading, ``seasonal`` has the forecasts (route_id, stop_id, seasonal_eta); where one is missing
    the cascade goes on to the next model.
    """
    none = F.lit(None).cast("double")
    tree = None if trees is None else "tree_eta"
    if trees is None:
        scored = rows.withColumn("tree_eta", none)
    else:
        inputs = feature_columns(F.col("distance_m"), F.col("speed_ms"), F.col("stops_remaining"), F.timestamp_millis("t"))
        scored = rows.withColumn("tree_eta", trees.column(*[inputs[c] for c in C.ETA_FEATURES]))
    if seasonal is None:
        return cascade(scored.withColumn("seasonal_eta", none), model, tree=tree)
    told = seasonal.select(F.col("route_id").cast("string").alias("_route"), F.col("stop_id").cast("long").alias("_stop"), "seasonal_eta")
    met = scored.join(told, (F.col("route_id") == F.col("_route")) & (F.col("next_stop_id") == F.col("_stop")), "left")
    return cascade(met.drop("_route", "_stop"), model, tree=tree)


def stop_name(stops: Column, stop_id: Column) -> Column:
    return F.get(F.filter(stops, lambda s: s["stopId"] == stop_id), F.lit(0))["stopName"]


def snapshot(estimates: DataFrame, version: str | None = None) -> DataFrame:
    """The per-trip snapshot fields."""
    return estimates.select(
        F.col("trip_id").alias("tripId"), F.col("bus_id").alias("busId"), F.col("route_id").alias("routeId"),
        F.col("speed_ms").alias("speed"), F.col("next_stop_id").alias("nextStopId"),
        F.col("distance_m").alias("distanceToNextStop"), F.col("stops_remaining").alias("stopsRemaining"),
        F.col("stops_ahead").alias("stopsAhead"), F.col("progress_pct").alias("routeProgressPct"),
        F.col("t").alias("timestampMs"), F.col("eta_seconds").alias("etaSeconds"),
        F.col("effective_speed_ms").alias("effectiveSpeedMs"), F.col("clamped").alias("speedClamped"),
        F.col("model_used").alias("modelUsed"), F.col("segment_mode").alias("segmentMode"),
        F.lit(version).cast("string").alias("modelVersion"), F.lit(None).cast("string").alias("runId"))


def live_event(estimates: DataFrame, version: str | None = None) -> DataFrame:
    """Compact JSON per estimate; the struct's column order is the sorted key order."""
    fields = {
        "busId": F.col("bus_id"), "distanceToNextStop": F.col("distance_m"), "eta_seconds": F.col("eta_seconds"),
        "event": F.lit("eta_update"), "model_used": F.col("model_used"),
        "model_version": F.lit(version).cast("string"), "routeId": F.col("route_id"),
        "routeProgressPct": F.col("progress_pct"), "stopId": F.col("next_stop_id"),
        "stopName": stop_name(F.col("stops_ahead"), F.col("next_stop_id")),
        "timestamp": F.col("t"), "tripId": F.col("trip_id")}
    body = F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})
    return estimates.select("trip_id", "t", body.alias("value"))


def latest_snapshots(snapshots: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Newest snapshot per trip with its expiry; readers keep rows whose expiry is after their clock."""
    newest = snapshots.groupBy("tripId").agg(F.max_by(F.struct(*[c for c in snapshots.columns if c != "tripId"]),
                                                      "timestampMs").alias("_s"))
    return newest.select("tripId", "_s.*").withColumn("expires_ms", F.col("timestampMs") + limits.snapshot_ttl_ms)


def answer_requests(requests: DataFrame, snapshots: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """ETA requests (request_id, trip_id, stop_id, model, as_of_ms) against live snapshots.

    ``reason`` says why a request has no answer. ``scores`` may add (trip_id, stop_id, tree_eta,
    seasonal_eta).
    """
    live = snapshots.select(F.col("tripId").alias("trip_id"), "busId", "routeId", "speed", "distanceToNextStop",
                            "stopsRemaining", "stopsAhead", "segmentMode", "timestampMs", "expires_ms")
    joined = requests.join(live, "trip_id", "left")
    alive = F.col("expires_ms").isNotNull() & (F.col("expires_ms") > F.col("as_of_ms"))
    stop = F.get(F.filter("stopsAhead", lambda s: s["stopId"] == F.col("stop_id")), F.lit(0))
    known = F.lower(F.trim(F.coalesce("model", F.lit("xgboost")))).isin(list(MODELS))
    rows = joined.withColumns({
        "_stop": F.when(alive, stop), "model": F.coalesce("model", F.lit("xgboost"))}).withColumn(
        "reason", F.when(~known, "UNSUPPORTED_MODEL").when(~alive, "NO_SNAPSHOT")
        .when(F.col("_stop").isNull(), "STOP_NOT_FOUND"))
    rows = rows.withColumns({
        "distance_m": F.coalesce(F.col("_stop.distanceAlongRouteMeters"), "distanceToNextStop"),
        "speed_ms": F.coalesce("speed", F.lit(0.0)), "segment_mode": F.coalesce("segmentMode", F.lit("urban"))})
    if scores is None:
        rows = rows.withColumns({"tree_eta": F.lit(None).cast("double"), "seasonal_eta": F.lit(None).cast("double")})
    else:
        rows = rows.join(scores, ["trip_id", "stop_id"], "left")
    answered = cascade(rows.filter(F.col("reason").isNull()), F.col("model"), tree=None if scores is None else "tree_eta")
    columns = ["request_id", "trip_id", "stop_id", "reason", "eta_seconds", "distance_m", "speed_ms", "model_used",
               "clamped", "fallback"]
    refused = rows.filter(F.col("reason").isNotNull()).select(
        *columns[:4], *[F.lit(None).cast(t).alias(n) for n, t in [
            ("eta_seconds", "double"), ("distance_m", "double"), ("speed_ms", "double"), ("model_used", "string"),
            ("clamped", "boolean"), ("fallback", "boolean")]])
    return answered.select(*columns).unionByName(refused)


def eta_records(estimates: DataFrame, recorded_ms: Column, version: str | None = None) -> DataFrame:
    """Rows of the append-only record table (superset layout)."""
    return estimates.select(
        "trip_id", "bus_id", "route_id", F.col("next_stop_id").cast("int").alias("stop_id"), "eta_seconds",
        "distance_m", "speed_ms", "effective_speed_ms", "model_used",
        F.lit(version).cast("string").alias("model_version"), "segment_mode", "clamped",
        F.lit(False).alias("off_route"), F.timestamp_millis("t").alias("timestamp"),
        F.timestamp_millis(recorded_ms).alias("recorded_at"))
