"""Parsers of the engine's own topics: message text to the columns that operators read.

A message is parsed once; a field of the wrong kind, or an absent one, is NULL. Both spellings of a field are accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators.validate import once

_AHEAD = "array<struct<stopId:int,stopName:string,stopOrder:int,distanceAlongRouteMeters:double>>"


def _reader(df: DataFrame, value: str):
    parsed = once(df, F.try_parse_json(F.col(value)).alias("_v"))
    return parsed, lambda kind, *names: F.coalesce(*[F.try_variant_get("_v", f"$.{n}", kind) for n in names])


def _millis(text: Column) -> Column:
    return F.unix_millis(scalars.parse_time(text))


def parse_cleaned(messages: DataFrame, value: str = "value") -> DataFrame:
    """Cleaned telemetry, which is also the feature stream of arrival estimates."""
    df, get = _reader(messages, value)
    return once(
        df, get("string", "busId", "bus_id").alias("bus_id"), get("string", "tripId", "trip_id").alias("trip_id"),
        get("string", "routeId", "route_id").alias("route_id"), *[get("double", c).alias(c) for c in ("lat", "lon", "speed", "heading")],
        F.coalesce(get("long", "timestampMs"), _millis(get("string", "timestamp"))).alias("t"),
        F.coalesce(get("boolean", "offRoute", "off_route"), ~get("boolean", "on_route", "onRoute")).alias("off_route"),
        get("double", "offRouteDistanceM", "routeDeviationMeters").alias("off_route_m"),
        get("double", "remainingDistanceToNextStops").alias("remaining_m"), get("double", "routeProgressPct").alias("progress_pct"),
        get("int", "nextStopId").alias("next_stop_id"), get("double", "distanceToNextStop").alias("next_stop_m"),
        get("int", "stopsRemaining").alias("stops_remaining"), get(_AHEAD, "stopsAhead").alias("stops_ahead"),
        get("string", "segmentMode").alias("segment_mode"), get("string", "tripStatus", "trip_status").alias("trip_status")).drop("_v")


def feature_error(value: Column) -> Column:
    """Why a parsed message (a variant) is no feature message: fields that it lacks, or stops that are no list; else NULL."""
    fields = F.map_keys(value.try_cast("map<string,variant>"))
    absent = F.filter(F.array(*[F.lit(n) for n in C.ETA_REQUIRED_FIELDS]), lambda n: ~F.coalesce(F.array_contains(fields, n), F.lit(False)))
    is_list = F.schema_of_variant(F.variant_get(value, "$.stopsAhead", "variant")).startswith("ARRAY")
    return (F.when(F.size(absent) > 0, F.concat(F.lit("Missing ETA feature fields: "), F.array_join(absent, ", ")))
            .when(~F.coalesce(is_list, F.lit(False)), "stopsAhead must be a list"))


def parse_features(messages: DataFrame, value: str = "value") -> DataFrame:
    """Messages of the feature topic: cleaned readings, and the trip ends among them (``event``)."""
    df, get = _reader(parse_cleaned(messages, value), value)
    return once(df, F.coalesce(get("string", "event"), get("string", "eventType")).alias("event"),
                feature_error(F.col("_v")).alias("feature_error")).drop("_v")


def parse_dlq(messages: DataFrame, value: str = "value") -> DataFrame:
    """Rejection envelopes, with the fields that the burst detector reads.

    ``t`` is the event's or else the receive time; ``refused_t`` is the receive time first, the clock of burst windows.
    """
    df, get = _reader(messages, value)
    return once(
        df, get("string", "original_payload").alias("original_payload"), get("string", "busId").alias("busId"),
        get("string", "tripId").alias("tripId"), get("string", "error_type", "errorType").alias("error_type"),
        get("string", "error_reason", "reason").alias("error_reason"), get("string", "source_topic").alias("source_topic"),
        F.coalesce(_millis(get("string", "event_timestamp")), _millis(get("string", "received_at"))).alias("t"),
        F.coalesce(*[_millis(get("string", c)) for c in ("received_at", "event_timestamp", "timestamp")]).alias("refused_t")).drop("_v")


def parse_crowd_reports(messages: DataFrame, value: str = "value") -> DataFrame:
    """Passenger reports, as the crowd contract checks them."""
    df, get = _reader(messages, value)
    return once(
        df, get("string", "trip_id").alias("trip_id"), *[get("int", c).alias(c) for c in ("route_id", "direction_id", "stop_id", "stop_sequence")],
        get("int", "occupancy_score").alias("occupancy_score"), get("string", "passenger_id").alias("passenger_id"),
        _millis(get("string", "timestamp")).alias("t")).drop("_v")


def parse_device_config(messages: DataFrame, value: str = "value") -> DataFrame:
    """Device settings and the short command they become; a message without any setting has no command."""
    df, get = _reader(messages, value)
    read = once(df, get("string", "bus_id").alias("bus_id"), get("int", "location_interval").alias("location_interval"),
                get("int", "heartbeat_interval").alias("heartbeat_interval"), get("string", "new_bus_id").alias("new_bus_id")).drop("_v")
    return read.withColumn("command", scalars.device_config(F.col("location_interval"), F.col("heartbeat_interval"), F.col("new_bus_id")))
