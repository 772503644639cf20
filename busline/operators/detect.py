"""Anomaly detectors. Every detector returns rows of one alert shape.

Input readings are cleaned ones: per bus their times ``t`` (ms) are strictly increasing, so a time
chunk holds a bounded number of rows and windows over (bus, chunk) never see a whole history.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import geo, scalars
from busline.operators import chunked
from busline.operators.chunked import CHUNK, Carry
from busline.operators.validate import once

ALERT_COLUMNS = ["bus_id", "anomaly_type", "severity", "message", "trip_id", "route_id", "location", "t", "model_version",
                 "source", "detail"]
#: Version that alerts name when no trained model takes part (fixed value).
RULES_VERSION = "rules-v1"
#: Source that alerts raised by refused messages name (fixed value).
REFUSED_SOURCE = "transport-telemetry-dlq"


def alert(df: DataFrame, kind: str | Column, message: Column, detail: Column | None = None, source: str | None = None,
          version: str = RULES_VERSION) -> DataFrame:
    """Project rows to the alert shape; ``detail`` is a JSON text of the type-specific fields."""
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(
        "bus_id", kind_col.alias("anomaly_type"), scalars.severity(kind_col).alias("severity"),
        message.alias("message"), "trip_id", "route_id", F.struct("lat", "lon").alias("location"), "t",
        F.lit(version).alias("model_version"), F.lit(source).cast("string").alias("source"),
        (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))


def alert_message(alerts: DataFrame) -> Column:
    """The alert as other services read it: one JSON object, its type-specific fields beside the common ones."""
    common = F.struct(F.col("bus_id").alias("busId"), F.col("anomaly_type").alias("anomalyType"), "severity", "message",
                      F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId"), "location",
                      scalars.iso_utc(F.timestamp_millis("t")).alias("timestamp"), F.col("model_version").alias("modelVersion"))
    fields = F.to_variant_object(common).cast("map<string,variant>")
    origin = F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source").cast("variant")))
    extra = F.try_parse_json("detail").try_cast("map<string,variant>")
    none = F.create_map().cast("map<string,variant>")
    return F.to_json(F.map_concat(fields, F.coalesce(origin, none), F.coalesce(extra, none)))


def _active(readings: DataFrame) -> DataFrame:
    """Only rows on a route feed the stateful detectors."""
    return readings.filter(F.coalesce(F.col("route_id"), F.lit("")) != "")


def unrealistic_speed(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    return alert(readings.filter(F.col("speed") > limits.alert_speed_kmh), "UNREALISTIC_SPEED",
                 F.lit("Speed exceeded 120 km/h"))


def inactive_gps(readings: DataFrame) -> DataFrame:
    return alert(readings.filter(F.coalesce(F.col("route_id"), F.lit("")) == ""), "INACTIVE_GPS",
                 F.lit("GPS received for inactive trip"))


def off_route_status(off_route: Column, on_route_snake: Column, on_route_camel: Column, deviations: list[Column],
                     geometry_m: Column, limits: C.Thresholds = C.DEFAULTS) -> Column:
    """struct(off, distance_m): stored flags win in order, the geometry distance is the last resort."""
    stored = F.coalesce(off_route, ~on_route_snake, ~on_route_camel)
    carried = F.coalesce(*[d.try_cast("double") for d in deviations], F.lit(0.0))
    distance = F.when(stored.isNotNull(), carried).otherwise(F.coalesce(geometry_m, F.lit(0.0)))
    off = F.coalesce(stored, F.coalesce(geometry_m, F.lit(0.0)) > limits.off_route_m)
    return F.struct(off.alias("off"), distance.alias("distance_m"))


def off_route(readings: DataFrame) -> DataFrame:
    rows = _active(readings).filter("off_route")
    return alert(rows, "OFF_ROUTE", F.format_string("Bus deviated by %dm from route",
                                                    F.bround("off_route_m", 0).cast("long")))


def off_route_streaks(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Third off-route reading inside a window anchored at the first one.

    The anchor restarts when the window is exceeded or an on-route reading intervenes: anchors are a greedy selection of
    off-route times that on-route readings reset.
    """
    rows = _active(readings).select("bus_id", "t", (~F.col("off_route")).alias("on"), "trip_id", "route_id", "lat", "lon", "off_route_m")
    third = chunked.paced(rows, ["bus_id"], "t", limits.streak_window_ms, True, width, reset="on").filter(
        ~F.col("on") & (F.col("nth") == limits.streak_count))
    seconds = limits.streak_window_ms // 1000
    return alert(third, "PERSISTENT_OFF_ROUTE",
                 F.lit(f"Bus remained off-route for {limits.streak_count} readings within {seconds}s"),
                 F.to_json(F.struct(F.lit(limits.streak_count).alias("streakCount"), F.lit(seconds).alias("windowSeconds"),
                                    F.col("off_route_m").alias("offRouteDistanceM"))))


def behaviour_windows(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS,
                      width: int = chunked.HOUR_MS) -> DataFrame:
    """Summary vector over the last rows of each bus, from the minimum row count on.

    Variances and mean use the whole row window; accelerations use the pairs inside it, one fewer.
    """
    rows = _active(readings).select("bus_id", "t", "speed", "heading", "trip_id", "route_id", "lat", "lon")
    back = limits.behaviour_rows - 1
    halo = chunked.row_halo(rows, ["bus_id"], "t", back + 1, width)
    part = Window.partitionBy("bus_id", CHUNK).orderBy("t")
    full, pairs = part.rowsBetween(-back, 0), part.rowsBetween(-(back - 1), 0)
    seconds = (F.col("t") - F.lag("t").over(part)) / 1000.0
    accelerated = halo.withColumn("_a", F.when(seconds > 0, (F.col("speed") - F.lag("speed").over(part)) / seconds))
    # a bus's first readings have no predecessor; the window minimum of the row count guards them
    return (accelerated.withColumns({
        "sample_count": F.count("*").over(full).cast("double"),
        "max_acceleration": F.coalesce(F.max("_a").over(pairs), F.lit(0.0)),
        "min_acceleration": F.coalesce(F.min("_a").over(pairs), F.lit(0.0)),
        "speed_variance": F.var_pop("speed").over(full),
        "heading_variance": F.var_pop("heading").over(full),
        "average_speed": F.avg("speed").over(full)})
        .filter(~F.col("_halo") & (F.col("sample_count") >= limits.behaviour_min_rows))
        .drop("_halo", "_a", CHUNK))


def summary_vector(df: DataFrame, key: list[str]) -> DataFrame:
    """Summary vector of a finished window per key (training form); one row gives zeros."""
    order = Window.partitionBy(*key).orderBy("t")
    seconds = (F.col("t") - F.lag("t").over(order)) / 1000.0
    paired = df.withColumn("_a", F.when(seconds > 0, (F.col("speed") - F.lag("speed").over(order)) / seconds))
    many = F.count("*") > 1
    zero = F.lit(0.0)
    return paired.groupBy(*key).agg(
        F.coalesce(F.max("_a"), zero).alias("max_acceleration"),
        F.coalesce(F.min("_a"), zero).alias("min_acceleration"),
        F.when(many, F.var_pop("speed")).otherwise(zero).alias("speed_variance"),
        F.when(many, F.var_pop("heading")).otherwise(zero).alias("heading_variance"),
        F.when(many, F.avg("speed")).otherwise(zero).alias("average_speed"),
        F.count("*").cast("double").alias("sample_count"))


def erratic_driving(windows: DataFrame, forest_anomaly: Column | None = None,
                    limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Forest verdict first, thresholds as the fallback; the alert carries features and method."""
    rules = (((F.col("speed_variance") >= limits.behaviour_speed_var)
              & (F.col("heading_variance") >= limits.behaviour_heading_var))
             | (F.col("max_acceleration") >= limits.behaviour_acceleration))
    forest = F.lit(False) if forest_anomaly is None else F.coalesce(forest_anomaly, F.lit(False))
    method = F.when(forest, "isolation_forest").when(rules, "rules_fallback")
    flagged = windows.withColumn("_method", method).filter(F.col("_method").isNotNull())
    detail = F.to_json(F.struct(F.struct(*[F.col(c) for c in C.BEHAVIOURAL_FEATURES]).alias("features"),
                                F.col("_method").alias("detectionMethod")))
    return alert(flagged, "ERRATIC_DRIVING",
                 F.when(F.col("_method") == "isolation_forest", "Behavioral anomaly detected (Isolation Forest)")
                 .otherwise("Behavioral anomaly detected (rule fallback)"), detail)


def largest_cluster(points: np.ndarray, eps: float, min_points: int) -> int:
    """Size of the largest density cluster among the points of one short window."""
    delta = points[:, None, :] - points[None, :, :]
    near = (delta ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= min_points
    label = np.full(len(points), -1)
    best = 0
    for seed in np.flatnonzero(core):
        if label[seed] >= 0:
            continue
        members = np.zeros(len(points), dtype=bool)
        members[seed] = True
        while True:
            reached = near[members & core].any(axis=0)
            grown = members | (reached & (label < 0))
            if (grown == members).all():
                break
            members = grown
        label[members] = seed
        best = max(best, int(members.sum()))
    return best


def cluster_share(eps: float, min_points: int):
    """Pandas UDF: share of the window's points in its largest density cluster, 0 for a NULL window."""
    @F.pandas_udf("double")
    def share(window: pd.Series) -> pd.Series:
        def one(points) -> float:
            if points is None:
                return 0.0
            grid = np.array([(p["lat"], p["lon"]) for p in points], dtype=float)
            return largest_cluster(grid, eps, min_points) / len(grid)
        return window.map(one).astype(float)
    return share


def stationary_windows(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS,
                       width: int = chunked.HOUR_MS) -> DataFrame:
    """Readings with the flag whether their trailing window forms one dense cluster.

    Only windows that are long enough are handed to the clustering; the flag of every other row is
    false. A window's rows are bounded by its length, as times are unique per bus.
    """
    return _dense_windows(readings, limits, width, limits.stationary_ms).filter(~F.col("_halo")).drop("_halo", CHUNK)


def _dense_windows(readings: DataFrame, limits: C.Thresholds, width: int, lookback: int) -> DataFrame:
    """The windows by chunk, with copies (``_halo``) of the readings of ``lookback`` before a chunk."""
    rows = _active(readings).select("bus_id", "t", "lat", "lon", "trip_id", "route_id")
    halo = chunked.range_halo(rows, "t", lookback, width)
    back = Window.partitionBy("bus_id", CHUNK).orderBy("t").rangeBetween(-limits.stationary_ms, 0)
    sized = halo.withColumns({"_n": F.count("*").over(back), "_from": F.min("t").over(back)})
    long_enough = ((F.col("_n") >= limits.stationary_min_points)
                   & (F.col("t") - F.col("_from") >= limits.stationary_span_ms))
    points = sized.withColumn("_points", F.collect_list(F.struct("lat", "lon")).over(back))
    share = cluster_share(limits.stationary_eps_deg, limits.stationary_min_points)
    return (points.withColumn("share", share(F.when(long_enough, F.col("_points")))).withColumn("dense", F.col("share") >= limits.stationary_share)
            .withColumnRenamed("_n", "window_points").drop("_points", "_from"))


def stationary(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Alert on the rising edge of the dense-window flag.

    The reading before a dense one lies in its window, so two windows of readings before a chunk decide its edges.
    """
    flagged = _dense_windows(readings, limits, width, 2 * limits.stationary_ms)
    before = F.lag("dense").over(Window.partitionBy("bus_id", CHUNK).orderBy("t"))
    edges = flagged.withColumn("_before", before).filter(~F.col("_halo"))
    return alert(edges.filter(F.col("dense") & ~F.coalesce(F.col("_before"), F.lit(False))), "STATIONARY",
                 F.lit("Bus stationary (DBSCAN cluster detected) for over 5 minutes"))


def stationary_by_speed(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Fallback rule: slow for longer than the window since the slow spell began; alerts on every row.

    A slow reading that follows a slow one holds the spell; the spell is long enough when it held on all readings of the window.
    """
    rows = _active(readings).select("bus_id", "t", "speed", "trip_id", "route_id", "lat", "lon")
    slow = F.coalesce(F.col("speed") < limits.slow_speed_kmh, F.lit(False))
    marked = chunked.carry(rows.withColumn("_slow", slow), ["bus_id"], "t", {"_was_slow": Carry("last", F.col("_slow"))}, width)
    holds = marked.withColumn("_holds", F.col("_slow") & F.coalesce("_was_slow", F.lit(False)))
    back = Window.partitionBy("bus_id", CHUNK).orderBy("t").rangeBetween(-limits.stationary_ms, 0)
    held = chunked.range_halo(holds, "t", limits.stationary_ms, width).withColumn("_long", F.min("_holds").over(back))
    return alert(held.filter(F.col("_long") & ~F.col("_halo")), "STATIONARY", F.lit("Bus stationary for over 5 minutes"))


def spatial_features(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Inputs of the spatial forest for every reading on a route.

    The stationary duration runs from the first reading of a slow spell: the one that a selection without end takes after each reset.
    """
    moving = ~F.coalesce(F.col("speed") < limits.slow_speed_kmh, F.lit(False))
    rows = _active(readings).select("bus_id", "t", "speed", "off_route_m", "next_stop_m", "progress_pct", moving.alias("moving"))
    spells = chunked.paced(rows, ["bus_id"], "t", 1 << 60, width=width, reset="moving")
    still = F.when(F.col("moving"), 0.0).otherwise((F.col("t") - F.coalesce("last", "t")) / 1000.0)
    values = {"route_deviation_meters": F.col("off_route_m"), "speed_kmh": F.col("speed"), "stationary_duration_sec": still,
              "distance_to_next_stop_m": F.col("next_stop_m"), "route_progress_pct": F.col("progress_pct")}
    return spells.select("bus_id", "t", *[F.coalesce(values[f], F.lit(0.0)).alias(f) for f in C.SPATIAL_FEATURES])


def communication_loss(readings: DataFrame, as_of_ms: int, limits: C.Thresholds = C.DEFAULTS,
                       width: int = chunked.HOUR_MS) -> DataFrame:
    """One alert per silence: the next reading, or the as-of time, is too far away."""
    rows = _active(readings).select("bus_id", "t", "trip_id", "route_id", "lat", "lon")
    followed = chunked.next_value(rows, ["bus_id"], "t", "t", "_next", width)
    silent = F.coalesce(F.col("_next"), F.lit(as_of_ms)) - F.col("t") > limits.silence_ms
    return alert(followed.filter(silent), "COMMUNICATION_LOSS", F.lit("No telemetry for over 3 minutes"))


def is_inactive_trip(error_type: Column, error_reason: Column) -> Column:
    return ((F.upper(F.coalesce(error_type, F.lit(""))) == "INACTIVE_TRIP")
            | F.upper(F.coalesce(error_reason, F.lit(""))).contains("INACTIVE_TRIP"))


def dlq_fields(df: DataFrame) -> DataFrame:
    """Bus, trip, route and position of a DLQ envelope; its payload text is the fallback for the bus."""
    parsed = once(df, F.try_parse_json("original_payload").alias("_v"))
    pick = lambda name, kind="string": F.try_variant_get("_v", f"$.{name}", kind)
    return once(parsed, F.coalesce(F.nullif(F.col("busId"), F.lit("")), pick("busId"), pick("bus_id")).alias("bus_id"),
                pick("tripId").alias("trip_id"), pick("routeId").alias("route_id"),
                pick("lat", "double").alias("lat"), pick("lon", "double").alias("lon")).drop("_v")


def trip_not_started(dlq: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Bursts of inactive-trip rejections per bus, with a cooldown after each alert.

    Needs (bus_id, t, arrival, error_type, error_reason, trip_id, route_id, lat, lon). A device may
    be refused any number of times per instant, so rows are first counted per (bus, t): the
    windows and the cooldown selection see instants, and only the rows of alerting instants are
    looked at again to find the reading that reached the threshold.
    """
    rows = dlq.filter(is_inactive_trip(F.col("error_type"), F.col("error_reason")) & F.col("bus_id").isNotNull())
    instants = rows.groupBy("bus_id", "t").agg(F.count("*").alias("_here"))
    halo = chunked.range_halo(instants, "t", limits.dlq_window_ms, width)
    back = Window.partitionBy("bus_id", CHUNK).orderBy("t").rangeBetween(-limits.dlq_window_ms, 0)
    counted = (halo.withColumn("_seen", F.sum("_here").over(back)).filter(~F.col("_halo"))
               .filter(F.col("_seen") >= limits.dlq_count).drop("_halo", CHUNK))
    # alerting instants only
    hits = chunked.paced(counted, ["bus_id"], "t", limits.dlq_cooldown_ms, False, width).filter("chosen").withColumn(
        "dlq_count", F.greatest(F.lit(limits.dlq_count), F.col("_seen") - F.col("_here") + 1)).drop("chosen", "last", "nth")
    nth = F.row_number().over(Window.partitionBy("bus_id", "t").orderBy("arrival"))
    reading = (rows.join(hits, ["bus_id", "t"]).withColumn("_nth", nth).filter(F.col("_nth") <= limits.dlq_count)
               .filter(F.col("_nth") == F.col("dlq_count") - (F.col("_seen") - F.col("_here"))))
    return alert(reading, "TRIP_NOT_STARTED_DEVICE_ACTIVE", F.lit("Device is sending GPS but no active trip exists"),
                 F.to_json(F.struct(F.lit("INACTIVE_TRIP").alias("sourceReason"), F.col("dlq_count").alias("dlqCount"),
                                    F.lit(limits.dlq_window_ms // 1000).alias("windowSeconds"))), REFUSED_SOURCE)


def row_alerts(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Alerts that need one reading only (speed, inactive GPS, off route), in a single pass."""
    active = F.coalesce(F.col("route_id"), F.lit("")) != ""

    def raised(when: Column, kind: str, message: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), message.alias("message")))

    fired = F.array_compact(F.array(
        raised(F.col("speed") > limits.alert_speed_kmh, "UNREALISTIC_SPEED", F.lit("Speed exceeded 120 km/h")),
        raised(~active, "INACTIVE_GPS", F.lit("GPS received for inactive trip")),
        raised(active & F.col("off_route"), "OFF_ROUTE", F.format_string(
            "Bus deviated by %dm from route", F.bround("off_route_m", 0).cast("long")))))
    return alert(readings.withColumn("_a", F.explode(fired)), F.col("_a.kind"), F.col("_a.message"))


def detect_all(readings: DataFrame, as_of_ms: int, limits: C.Thresholds = C.DEFAULTS,
               forest_anomaly: Column | None = None, width: int = chunked.HOUR_MS, version: str = RULES_VERSION) -> DataFrame:
    """All detectors that read the cleaned stream, as one alert table; ``version`` names the models behind it."""
    parts = [row_alerts(readings, limits), off_route_streaks(readings, limits, width), stationary(readings, limits, width),
             communication_loss(readings, as_of_ms, limits, width),
             erratic_driving(behaviour_windows(readings, limits, width), forest_anomaly, limits)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("model_version", F.lit(version))


def route_to_audiences(alerts: DataFrame) -> DataFrame:
    """One row per alert and audience channel."""
    return alerts.withColumn("channel", F.explode(scalars.audiences(F.col("anomaly_type"))))
