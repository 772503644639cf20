"""Route projection and stops-ahead enrichment of context-bearing readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import geo


def stops_along(links: DataFrame, stops: DataFrame, shapes: DataFrame) -> DataFrame:
    """route_id → stops ordered by ``stop_order`` with their distance along the route.

    Stops are projected once per route, not once per reading. A route's stop list is as long as
    its timetable.
    """
    located = (links.join(stops.select("stop_id", "stop_name", "lat", "lon"), "stop_id")
               .filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
               .join(shapes, "route_id"))
    placed = geo.route_position(located).select(
        "route_id", F.struct("stop_order", "stop_id", "stop_name", F.col("pos.along_m").alias("along_m")).alias("_s"))
    return placed.groupBy("route_id").agg(F.array_sort(F.collect_list("_s")).alias("route_stops"))


def stops_ahead(route_stops: Column, along_m: Column) -> Column:
    """Stops at or past the bus as the outgoing array, in stop order."""
    return F.transform(
        F.filter(route_stops, lambda s: s["along_m"] >= along_m),
        lambda s: F.struct(s["stop_id"].alias("stopId"), s["stop_name"].alias("stopName"),
                           s["stop_order"].alias("stopOrder"),
                           F.round(s["along_m"] - along_m, 2).alias("distanceAlongRouteMeters")))


def enrich(readings: DataFrame, shapes: DataFrame, route_stops: DataFrame, cells: DataFrame | None = None,
           limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Add route position, off-route flag, stops ahead and segment mode.

    ``cells`` (see :func:`busline.functions.geo.route_cells`) shortens the segment search of
    readings near their route.

    The geometry and stop tables are joined without a hint. Read from files, their size is known when the join is
    planned: they are broadcast below the session's threshold, and the telemetry is not moved for them. A network beyond
    it has so many routes that moving by route spreads well, and AQE splits what is skewed.
    """
    joined = readings.join(shapes, "route_id", "left").join(route_stops, "route_id", "left")
    if cells is not None:
        joined = geo.with_near_segments(joined, cells)
    placed = geo.route_position(joined)
    none = F.array().cast("array<struct<stopId:int,stopName:string,stopOrder:int,distanceAlongRouteMeters:double>>")
    ahead = F.when(F.col("route_stops").isNotNull(), stops_ahead(F.col("route_stops"), F.col("pos.along_m")))
    first = F.get(F.col("stops_ahead"), F.lit(0))
    return (placed.withColumn("stops_ahead", F.coalesce(ahead, none))
            .withColumns({
                "off_route_m": F.round("pos.off_m", 2),
                "off_route": F.col("pos.off_m") > limits.off_route_m,
                "remaining_m": F.round("pos.remaining_m", 2),
                "progress_pct": F.round("pos.progress_pct", 2),
                "next_stop_id": first["stopId"],
                "next_stop_m": F.coalesce(first["distanceAlongRouteMeters"], F.lit(0.0)),
                "stops_remaining": F.size("stops_ahead"),
                "segment_mode": geo.segment_mode(F.col("lat"), F.col("lon"))})
            .drop("pos", "segments", "total_m", "n_points", "first_lat", "first_lon", "route_stops"))


def cleaned_message(df: DataFrame) -> DataFrame:
    """Outgoing shape: every derived field under both spellings."""
    on_route = ~F.col("off_route")
    return df.select(
        F.col("bus_id").alias("busId"), F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId"),
        "lat", "lon", "speed", "heading", F.col("t").alias("timestampMs"),
        F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"),
        F.col("trip_status"), F.col("trip_status").alias("tripStatus"),
        on_route.alias("on_route"), on_route.alias("onRoute"), F.col("off_route").alias("offRoute"),
        F.col("off_route_m").alias("offRouteDistanceM"), F.col("off_route_m").alias("routeDeviationMeters"),
        F.col("remaining_m").alias("remainingDistanceToNextStops"), F.col("progress_pct").alias("routeProgressPct"),
        F.col("next_stop_id").alias("nextStopId"), F.col("next_stop_m").alias("distanceToNextStop"),
        F.col("stops_remaining").alias("stopsRemaining"), F.col("stops_ahead").alias("stopsAhead"),
        F.transform("stops_ahead", lambda s: F.struct(
            s["stopId"].alias("stop_id"), s["distanceAlongRouteMeters"].alias("remaining_distance_m"))).alias("next_stops"),
        F.col("segment_mode").alias("segmentMode"))
