"""Streaming jobs: sources, stateful steps and sinks wired together.

State lives in RocksDB under the query's checkpoint. Dimension tables are static sides of stream
joins; :class:`Refreshed` re-reads them between micro batches.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from busline import contracts as C
from busline.operators import context, crowd, detect, enrich, eta, validate
from busline.operators.forest import Packed
from busline.operators.trees import Flat
from busline.sinks import writers
from busline.sources import messages
from busline.streaming import processors as P

WATERMARK = "5 seconds"
TRAILING = "_body"


def keyed(df: DataFrame, key: list[str], processor: StatefulProcessor, time_mode: str = "None",
          event_time: str = "") -> DataFrame:
    """Run a state processor per key in append mode."""
    return df.groupBy(*key).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.SCHEMA, outputMode="Append", timeMode=time_mode,
        eventTimeColumnName=event_time)


def classified(messages: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Raw message stream with ``invalid_reason``; the watermark only bounds state, the newer-than
    rule decides what is dropped."""
    rows = validate.classify(validate.decode_gps(validate.drop_blank(messages)), limits)
    return rows.withColumn("event_time", F.coalesce("event_time", F.col("received_at"))).withWatermark("event_time", WATERMARK)


def in_context(cleaned: DataFrame, lifecycle: DataFrame, bootstrap: DataFrame | None = None) -> DataFrame:
    """Telemetry and lifecycle streams united, keyed by bus and stepped through the trip state."""
    body = F.to_json(F.struct("t", "lat", "lon", "speed", "heading"))
    none = F.lit(None).cast("string")
    readings = cleaned.select(context.telemetry_key().alias("bus_id"), "arrival", none.alias("event"),
                              F.col("payload_trip").alias("trip"), F.col("payload_route").alias("route"), "t", body.alias("body"))
    if bootstrap is None:
        readings = readings.withColumns({"boot_trip": none, "boot_route": none})
    else:
        readings = readings.join(bootstrap, "bus_id", "left")
    events = lifecycle.select("bus_id", "arrival", "event", F.col("trip_id").alias("trip"), F.col("route_id").alias("route"),
                              "t", none.alias("body"), none.alias("boot_trip"), none.alias("boot_route"))
    out = keyed(readings.unionByName(events), ["bus_id"], P.TripContext())
    fields = F.from_json("body", "t long, lat double, lon double, speed double, heading double")
    return out.withColumn("_b", fields).select("bus_id", "arrival", "trip_id", "route_id", "trip_status", "_b.*")


def enriched(cleaned: DataFrame, lifecycle: DataFrame, shapes: DataFrame, route_stops: DataFrame,
             bootstrap: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    return enrich.enrich(in_context(cleaned, lifecycle, bootstrap), shapes, route_stops, cells)


def ingest_verdicts(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    identity = F.concat_ws("_", "bus_id", "trip_id", F.col("t").cast("string"), F.col("lat").cast("string"),
                           F.col("lon").cast("string"))
    return keyed(readings.select("bus_id", "arrival", "t", identity.alias("identity")), ["bus_id"], P.IngestRules(limits))


def smoothed(features: DataFrame, trip_ends: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    none = F.lit(None).cast("string").alias("body")
    rows = features.select("trip_id", "t", "speed_ms", F.lit(True).alias("is_reading"), none)
    ends = trip_ends.select("trip_id", "t", F.lit(None).cast("double").alias("speed_ms"), F.lit(False).alias("is_reading"), none)
    return keyed(rows.unionByName(ends), ["trip_id"], P.SpeedSmoothing(limits))


#: What an estimate needs of a reading besides its speed, as it travels through the state of its trip.
_READING = ("bus_id string, route_id string, next_stop_id int, next_stop_m double, stops_remaining int, progress_pct double, segment_mode string, "
            "stops_ahead array<struct<stopId:int,stopName:string,stopOrder:int,distanceAlongRouteMeters:double>>")


def estimates(features: DataFrame, trees: Flat | None = None, seasonal: DataFrame | None = None, model: str = "xgboost",
              limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Estimate stream of the feature topic: its readings with a stop ahead, smoothed by trip, scored where they pass.

    Trip ends of the same topic clear a trip's speeds; one without a time counts from its receipt. Messages that lack a
    field, and readings that get no estimate, are left out.
    """
    parsed = messages.parse_features(features).withColumn("ended", F.coalesce(F.col("event") == "TRIP_ENDED", F.lit(False)))
    skipped = eta.skip_reason(F.col("event"), F.col("off_route"), F.col("next_stop_id"), F.col("trip_id"))
    used = F.col("ended") | (F.col("feature_error").isNull() & skipped.isNull() & F.col("speed").isNotNull())
    at = F.coalesce("t", F.when(F.col("ended"), F.unix_millis("received_at")))
    body = F.to_json(F.struct(*[f.split()[0] for f in _READING.split(", ")]))
    rows = parsed.filter(used).select("trip_id", at.alias("t"), F.when(~F.col("ended"), eta.speed_ms(F.col("speed"))).alias("speed_ms"),
                                      (~F.col("ended")).alias("is_reading"), body.alias("body")).filter("trip_id IS NOT NULL AND t IS NOT NULL")
    smooth = keyed(rows, ["trip_id"], P.SpeedSmoothing(limits)).withColumn("_b", F.from_json("body", _READING))
    ready = smooth.select("trip_id", "t", F.col("smoothed_ms").alias("speed_ms"), "smoothing_rows", "_b.*").withColumn("distance_m", F.col("next_stop_m"))
    return eta.estimated(ready, trees, seasonal, model)


def eta_sinks(out: str, version: str | None = None, clock: Callable[[], float] = time.time) -> Callable[[DataFrame, int], None]:
    """Write a batch of estimates to the record table, the snapshots per trip and the live channel; a repeated batch replaces itself."""
    snapshots, live = writers.snapshot_sink(f"{out}/snapshots", "tripId", "timestampMs"), writers.append_sink(f"{out}/live")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            writers.write_eta_records(eta.eta_records(rows, F.lit(int(clock() * 1000)), version), f"{out}/records", batch_id)
            snapshots(eta.latest_snapshots(eta.snapshot(rows, version)), batch_id)
            live(eta.live_event(rows, version), batch_id)
        finally:
            rows.unpersist()
    return write


def eta_job(features: DataFrame, out: str, checkpoint: str, trees: Flat | None = None, seasonal: DataFrame | None = None,
            model: str = "xgboost", version: str | None = None, limits: C.Thresholds = C.DEFAULTS):
    """Messages of the feature topic to arrival records, snapshots and live events."""
    return (estimates(features, trees, seasonal, model, limits).writeStream.foreachBatch(eta_sinks(out, version))
            .option("checkpointLocation", checkpoint).trigger(processingTime=writers.CHECKPOINT_EVERY))


def silence(readings: DataFrame, limits: C.Thresholds = C.DEFAULTS, time_mode: str = "EventTime") -> DataFrame:
    """Silence alerts by event-time timers; ``readings`` must carry a watermarked ``event_time``."""
    return keyed(readings.select("bus_id", "t", "event_time"), ["bus_id"], P.SilenceTimer(limits), time_mode)


class Refreshed:
    """A dimension re-read when it is older than ``seconds``; for use inside ``foreachBatch``."""

    def __init__(self, load: Callable[[], DataFrame], seconds: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self._load, self._seconds, self._clock = load, seconds, clock
        self._at: float | None = None
        self._table: DataFrame | None = None

    def get(self) -> DataFrame:
        now = self._clock()
        if self._at is None or now - self._at >= self._seconds:
            self._table, self._at = self._load(), now
        return self._table


def cleaned_job(context_rows: DataFrame, shapes: Refreshed, route_stops: Refreshed, out: str, checkpoint: str,
                channel: str = "telemetry:live"):
    """Enrich each micro batch with fresh dimensions and write it to every sink of the cleaned stream."""
    snapshot = writers.snapshot_sink(f"{out}/positions", "bus_id", "t")
    history = writers.append_sink(f"{out}/history", "date")
    cleaned = writers.append_sink(f"{out}/cleaned")
    features = writers.append_sink(f"{out}/eta-features")
    feed = writers.append_sink(f"{out}/live", "channel")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = enrich.enrich(batch, shapes.get(), route_stops.get()).persist()
        try:
            message = writers.keyed_json(enrich.cleaned_message(rows), F.col("busId"))
            cleaned(message, batch_id)
            features(message, batch_id)
            snapshot(rows.drop("stops_ahead"), batch_id)
            history(writers.history_rows(rows), batch_id)
            feed(writers.live_feed(rows, channel), batch_id)
        finally:
            rows.unpersist()

    return (context_rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(processingTime=writers.CHECKPOINT_EVERY))


def detections(cleaned: DataFrame, dlq: DataFrame, limits: C.Thresholds = C.DEFAULTS, version: str = detect.RULES_VERSION,
               forest: tuple[Packed, float] | None = None) -> DataFrame:
    """Alert stream of the cleaned topic and the refusals: both keyed by bus, shuffled once, judged by one processor.

    The watermark is set on their union, so that silences are seen while nothing is refused. Messages without a bus
    or a time are judged by no rule.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("speed", "double"), ("heading", "double"), ("off_route_m", "double"), ("off_route", "boolean"))}
    columns = ["bus_id", "arrival", "t", "lat", "lon", "trip_id", "route_id", *none]
    readings = messages.parse_cleaned(cleaned).withColumns({
        "speed": F.coalesce("speed", F.lit(0.0)), "heading": F.coalesce("heading", F.lit(0.0)),
        "off_route": F.coalesce("off_route", F.lit(False)), "off_route_m": F.coalesce("off_route_m", F.lit(0.0))})
    refused = detect.dlq_fields(messages.parse_dlq(dlq)).withColumn("t", F.col("refused_t")).filter(detect.is_inactive_trip(F.col("error_type"), F.col("error_reason")))
    both = readings.select(*columns, F.lit(False).alias("refused")).unionByName(
        refused.withColumns(none).select(*columns, F.lit(True).alias("refused")))
    timed = both.filter("bus_id IS NOT NULL AND t IS NOT NULL").withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", WATERMARK)
    alerts = keyed(timed, ["bus_id"], P.Detectors(limits, version, forest), "EventTime")
    return alerts.withColumn("location", F.struct("lat", "lon")).select(*detect.ALERT_COLUMNS)


def alert_sinks(out: str) -> Callable[[DataFrame, int], None]:
    """Write a batch of alerts to the history, the message topic and the audiences' folders; a repeated batch replaces itself."""
    history, topic, audiences = writers.append_sink(f"{out}/history", "date"), writers.append_sink(f"{out}/anomalies"), f"{out}/audiences"

    def write(batch: DataFrame, batch_id: int) -> None:
        alerts = batch.persist()
        try:
            history(writers.alert_rows(alerts), batch_id)
            topic(alerts.select(F.col("bus_id").alias("key"), detect.alert_message(alerts).alias("value")), batch_id)
            writers.write_audiences(alerts, audiences, batch_id)
        finally:
            alerts.unpersist()
    return write


def detector_job(cleaned: DataFrame, dlq: DataFrame, out: str, checkpoint: str, limits: C.Thresholds = C.DEFAULTS,
                 version: str = detect.RULES_VERSION, forest: tuple[Packed, float] | None = None):
    """Messages of the cleaned and the refusal topic to alert history, alert topic and audiences."""
    return (detections(cleaned, dlq, limits, version, forest).writeStream.foreachBatch(alert_sinks(out))
            .option("checkpointLocation", checkpoint).trigger(processingTime=writers.CHECKPOINT_EVERY))


def crowd_jobs(messages_in: DataFrame, routes: DataFrame, links: DataFrame, out: str, checkpoint: str,
               limits: C.Thresholds = C.DEFAULTS) -> list:
    """Passenger reports to two sinks: accepted reports (appended) and passenger profiles (newest per passenger).

    A report counts when it meets the contract and its stop lies on its route. Each named report is compared with the
    others at its stop, and the outcome moves its passenger's trust.
    """
    checked = validate.crowd_contract(messages.parse_crowd_reports(messages_in)).filter("error_reason IS NULL").drop("error_reason")
    accepted = crowd.check_stop(checked, routes, links).filter("error_reason IS NULL").select(
        "route_id", "stop_id", "passenger_id", "arrival", "t", F.col("occupancy_score").cast("double").alias("score"))
    judged = keyed(accepted.filter("passenger_id IS NOT NULL"), crowd.PLACE, P.StopConsensus(limits))
    trust = keyed(judged, ["passenger_id"], P.TrustState(limits))

    def writer(rows: DataFrame, sink: Callable[[DataFrame, int], None], name: str):
        return (rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{checkpoint}/{name}")
                .trigger(processingTime=writers.CHECKPOINT_EVERY))

    return [writer(accepted, writers.append_sink(f"{out}/reports"), "reports"),
            writer(trust, writers.snapshot_sink(f"{out}/profiles", "passenger_id", "arrival"), "profiles")]
