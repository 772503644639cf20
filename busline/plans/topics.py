"""Queries that send each kind of message and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import enrich, validate
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import oracle, view
from busline.sinks import writers
from busline.sources import messages

_STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


@query("parsed_cleaned", oracle("""SELECT bus_id, t, trip_id, route_id, lat, lon, speed, heading, off_route, off_route_m, remaining_m, progress_pct,
  next_stop_id, next_stop_m, stops_remaining, segment_mode, coalesce(a.n, 0) AS listed FROM enriched e
  LEFT JOIN (SELECT arrival, count(*) AS n FROM ahead GROUP BY 1) a USING (arrival)""", *S.ENRICHED_VIEWS, extra=S.parts(S.ENRICHED_PARTS)))
def parsed_cleaned(spark, sf):
    """The cleaned stream as messages, parsed back to the columns that detectors and estimates read."""
    sent = writers.keyed_json(enrich.cleaned_message(S.enriched(spark, sf)), F.col("busId"))
    return messages.parse_cleaned(sent).select(
        "bus_id", "t", "trip_id", "route_id", "lat", "lon", "speed", "heading", "off_route", "off_route_m", "remaining_m", "progress_pct",
        "next_stop_id", "next_stop_m", "stops_remaining", "segment_mode", F.size("stops_ahead").cast("long").alias("listed"))


@query("parsed_dlq", oracle("""SELECT CASE WHEN malformed OR event_id % 3 = 0 THEN 'topic-' || bus_id ELSE bus_id END AS bus,
  CASE WHEN NOT malformed THEN payload_trip END AS trip, t, CASE WHEN malformed THEN 'JSON_PARSE' ELSE 'GEO_BOUNDS' END AS error_type,
  'rejected' AS error_reason FROM telemetry WHERE malformed OR lat = 0""", "telemetry"))
def parsed_dlq(spark, sf):
    rows = view(spark, sf, "telemetry").filter("malformed OR lat = 0")
    body = F.to_json(F.struct(F.when(F.col("event_id") % 3 != 0, F.col("bus_id")).alias("busId"), F.col("payload_trip").alias("tripId"),
                              F.date_format(F.timestamp_millis("t"), _STAMP).alias("timestamp")))
    rejected = rows.select(
        F.when(F.col("malformed"), F.lit("{bad")).otherwise(body).cast("binary").alias("payload"),
        F.concat(F.lit("transport/bus/topic-"), "bus_id", F.lit("/location")).alias("source_topic"),
        F.when(F.col("malformed"), "JSON_PARSE").otherwise("GEO_BOUNDS").alias("error_type"), F.lit("rejected").alias("error_reason"),
        F.timestamp_millis("t").alias("received_at"))
    sent = writers.keyed_json(validate.dlq_envelope(rejected), F.col("busId"))
    return messages.parse_dlq(sent).select(F.col("busId").alias("bus"), F.col("tripId").alias("trip"), "t", "error_type", "error_reason")


@query("parsed_crowd_reports", oracle("SELECT arrival, route_id, stop_id, score, passenger_id, t FROM crowd_reports", "crowd_reports"))
def parsed_crowd_reports(spark, sf):
    rows = view(spark, sf, "crowd_reports")
    body = F.to_json(F.struct("route_id", "stop_id", F.col("score").alias("occupancy_score"), "passenger_id",
                              F.date_format(F.timestamp_millis("t"), _STAMP).alias("timestamp")))
    return messages.parse_crowd_reports(rows.select("arrival", body.alias("value"))).select(
        "arrival", "route_id", "stop_id", F.col("occupancy_score").alias("score"), "passenger_id", "t")


@query("parsed_device_config", """
SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN 'bus' || user_id END AS bus_id, CASE WHEN event_id % 4 = 3 THEN 'I:' || (1000 * (event_id % 60)) || ',H:30000'
  WHEN event_id % 4 = 2 THEN 'H:30000' WHEN event_id % 4 = 1 THEN 'I:' || (1000 * (event_id % 60)) || ',B:new' || user_id END AS command FROM events""")
def parsed_device_config(spark, sf):
    kind, user = F.col("event_id") % 4, F.col("user_id").cast("string")
    body = F.to_json(F.struct(
        F.concat(F.lit("bus"), user).alias("bus_id"), F.when(kind.isin(1, 3), 1000 * (F.col("event_id") % 60)).alias("location_interval"),
        F.when(kind.isin(2, 3), 30000).alias("heartbeat_interval"), F.when(kind == 1, F.concat(F.lit("new"), user)).alias("new_bus_id")))
    sent = view(spark, sf, "ev").select("event_id", F.when(kind == 0, F.lit("{broken")).otherwise(body).alias("value"))
    return messages.parse_device_config(sent).select("event_id", "bus_id", "command")
