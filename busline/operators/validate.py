"""Decoding, validation and classification of raw messages: one projection, no exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import geo, scalars
from busline.operators import chunked


def _text(name: str) -> Column:
    return F.try_variant_get(F.col("_v"), f"$.{name}", "string")


def _present(name: str) -> Column:
    """The key exists, even when its value is JSON null."""
    return F.try_variant_get(F.col("_v"), f"$.{name}", "variant").isNotNull()


def once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add computed columns through a one-row generator.

    Filters on columns derived from these are not pushed below a generator, so the parsing they
    depend on is evaluated once per row instead of once per mention.
    """
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def decode_gps(df: DataFrame, value: str = "value") -> DataFrame:
    """Parse the message once and expose its fields as text next to the parse outcome."""
    raw = F.col(value)
    if dict(df.dtypes)[value] == "binary":
        raw = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    parsed = once(df, F.try_parse_json(raw).alias("_v"))
    fields = once(
        parsed,
        F.when(F.col("_v").isNull(), "JSON_PARSE")
         .when(~F.schema_of_variant("_v").startswith("OBJECT"), "SCHEMA_VALIDATION").alias("decode_error"),
        F.coalesce(F.nullif(_text("busId"), F.lit("")), _text("bus_id")).alias("bus_id"),
        F.coalesce(F.nullif(_text("tripId"), F.lit("")), _text("trip_id")).alias("payload_trip"),
        F.coalesce(F.nullif(_text("routeId"), F.lit("")), _text("route_id")).alias("payload_route"),
        *[_text(n).alias(f"{n}_text") for n in ("lat", "lon", "speed", "heading")],
        _text("timestamp").alias("timestamp_text"),
        *[_present(n).alias(f"has_{n}") for n in ("lat", "lon", "speed", "heading", "timestamp")])
    return fields.drop("_v")


def _number(name: str) -> Column:
    return F.col(f"{name}_text").try_cast("double")


def with_numbers(df: DataFrame) -> DataFrame:
    """Typed fields of a decoded message; ``t`` is the event time in milliseconds."""
    event_time = scalars.parse_time(F.col("timestamp_text"))
    return df.withColumns({
        "lat": _number("lat"), "lon": _number("lon"), "speed": F.coalesce(_number("speed"), F.lit(0.0)),
        "heading": F.coalesce(_number("heading"), F.lit(0.0)), "event_time": event_time,
        "t": F.unix_millis(event_time)})


def schema_only(df: DataFrame) -> DataFrame:
    """First failing shape rule of a decoded GPS message as (error_type, error_reason)."""
    rules: list[tuple[Column, str, str]] = [
        (F.col("decode_error") == "JSON_PARSE", "JSON_PARSE", "Failed to parse JSON"),
        (F.col("decode_error").isNotNull(), "SCHEMA_VALIDATION", "payload must be a JSON object"),
        (~F.col("has_timestamp"), "MISSING_TIMESTAMP", "Missing required event timestamp"),
        (F.coalesce(F.trim("bus_id"), F.lit("")) == "", "SCHEMA_VALIDATION", "busId is required"),
    ]
    for name in ("lat", "lon", "speed"):
        rules.append((~F.col(f"has_{name}"), "SCHEMA_VALIDATION", f"{name} is required"))
        rules.append((_number(name).isNull(), "SCHEMA_VALIDATION", f"{name} must be numeric"))
    rules.append((F.col("has_heading") & _number("heading").isNull(), "SCHEMA_VALIDATION",
                  "heading must be numeric"))
    rules.append((scalars.parse_time(F.col("timestamp_text")).isNull(), "SCHEMA_VALIDATION",
                  "timestamp must be ISO 8601"))
    return once(df, *[c.alias(n) for n, c in _first_failure(rules).items()])


def _first_failure(rules: list[tuple[Column, str, str]]) -> dict[str, Column]:
    kind, reason = F.when(*_lit(rules[0], 1)), F.when(*_lit(rules[0], 2))
    for rule in rules[1:]:
        kind, reason = kind.when(*_lit(rule, 1)), reason.when(*_lit(rule, 2))
    return {"error_type": kind, "error_reason": reason}


def _lit(rule: tuple[Column, str, str], at: int):
    return rule[0], F.lit(rule[at])


def _length_ok(value: Column, most: int, least: int = 1) -> Column:
    return F.length(value).between(least, most)


def location_contract(df: DataFrame, require_trip: bool = False) -> DataFrame:
    """Full GPS contract: every failing field is reported, then the service-area box is checked."""
    lat, lon, speed = _number("lat"), _number("lon"), _number("speed")
    heading = _number("heading")
    checks = [
        F.when(~F.coalesce(_length_ok(F.col("bus_id"), 50), F.lit(False)), "busId: length must be 1..50"),
        F.when(~F.coalesce(lat.between(-90, 90), F.lit(False)), "lat: must be between -90 and 90"),
        F.when(~F.coalesce(lon.between(-180, 180), F.lit(False)), "lon: must be between -180 and 180"),
        F.when(~F.coalesce(speed.between(0, 200), F.lit(False)), "speed: must be between 0 and 200"),
        F.when(F.col("has_heading") & ~F.coalesce(heading.between(0, 360), F.lit(False)),
               "heading: must be between 0 and 360"),
        F.when(scalars.parse_time(F.col("timestamp_text")).isNull(), "timestamp: must be ISO 8601"),
    ]
    if require_trip:
        checks.append(F.when(~F.coalesce(_length_ok(F.col("payload_trip"), 50), F.lit(False)),
                             "tripId: length must be 1..50"))
    return _contract(df, checks, ~geo.in_bounds(lat, lon))


def _contract(df: DataFrame, checks: list[Column], out_of_box: Column | None = None) -> DataFrame:
    failed = once(df, F.array_compact(F.array(*checks)).alias("_failed"))
    kind = (F.when(F.col("decode_error").isNotNull(), F.col("decode_error"))
            .when(~F.col("has_timestamp"), "MISSING_TIMESTAMP")
            .when(F.size("_failed") > 0, "SCHEMA_VALIDATION"))
    reason = (F.when(F.col("decode_error").isNotNull(), F.lower("decode_error"))
              .when(~F.col("has_timestamp"), "Missing required event timestamp")
              .when(F.size("_failed") > 0, F.array_join("_failed", "; ")))
    if out_of_box is not None:
        kind = kind.when(out_of_box, "GEO_BOUNDS")
        reason = reason.when(out_of_box, "Coordinates out of bounds")
    return failed.withColumns({"error_type": kind, "error_reason": reason}).drop("_failed")


def decode_heartbeat(df: DataFrame, value: str = "value") -> DataFrame:
    parsed = once(df, F.try_parse_json(value).alias("_v"))
    optional = ["deviceId", "gpsFix", "satellites", "signalQuality", "batteryVoltage", "firmwareVersion"]
    return once(
        parsed,
        F.when(F.col("_v").isNull(), "JSON_PARSE")
         .when(~F.schema_of_variant("_v").startswith("OBJECT"), "SCHEMA_VALIDATION").alias("decode_error"),
        F.coalesce(_text("busId"), _text("bus_id")).alias("bus_id"),
        _text("timestamp").alias("timestamp_text"), _present("timestamp").alias("has_timestamp"),
        *[_text(n).alias(n) for n in optional]).drop("_v")


def heartbeat_contract(df: DataFrame) -> DataFrame:
    def optional(ok: Column, name: str, message: str) -> Column:
        return F.when(F.col(name).isNotNull() & ~F.coalesce(ok, F.lit(False)), f"{name}: {message}")

    checks = [
        F.when(~F.coalesce(_length_ok(F.col("bus_id"), 50), F.lit(False)), "busId: length must be 1..50"),
        F.when(scalars.parse_time(F.col("timestamp_text")).isNull(), "timestamp: must be ISO 8601"),
        optional(_length_ok(F.col("deviceId"), 80, 0), "deviceId", "length must be at most 80"),
        optional(F.col("gpsFix").try_cast("boolean").isNotNull(), "gpsFix", "must be boolean"),
        optional(F.col("satellites").try_cast("int").between(0, 100), "satellites", "must be between 0 and 100"),
        optional(F.col("signalQuality").try_cast("double") >= 0, "signalQuality", "must be at least 0"),
        optional(F.col("batteryVoltage").try_cast("double") >= 0, "batteryVoltage", "must be at least 0"),
        optional(_length_ok(F.col("firmwareVersion"), 80, 0), "firmwareVersion", "length must be at most 80"),
    ]
    return _contract(df, checks)


def timestamp_window(event_ms: Column, received_ms: Column, limits: C.Thresholds = C.DEFAULTS) -> Column:
    """FUTURE_TIMESTAMP, STALE_REPLAY or NULL, measured against the receive time."""
    return (F.when(event_ms - received_ms > limits.future_skew_s * 1000, "FUTURE_TIMESTAMP")
            .when(received_ms - event_ms > limits.stale_age_s * 1000, "STALE_REPLAY"))


def physics_reason(malformed: Column, lat: Column, lon: Column, speed: Column, bad_speed: Column | None = None,
                   limits: C.Thresholds = C.DEFAULTS) -> Column:
    """First failing physics rule; NULL means the row is a cleaned candidate."""
    chain = (F.when(malformed, "MALFORMED_JSON")
             .when(lat.isNull() | lon.isNull(), "MISSING_OR_INVALID_COORDINATES")
             .when(~geo.in_bounds(lat, lon), "OUT_OF_SRI_LANKA_BOUNDS"))
    if bad_speed is not None:
        chain = chain.when(bad_speed, "INVALID_SPEED")
    return chain.when((speed < 0) | (speed > limits.max_speed_kmh), "UNREALISTIC_SPEED")


def classify(df: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Add ``invalid_reason`` to decoded messages. Split with ``isNull`` / ``isNotNull``."""
    typed = with_numbers(df)
    bad_speed = F.col("has_speed") & _number("speed").isNull()
    return once(typed, physics_reason(
        F.col("decode_error").isNotNull(), F.col("lat"), F.col("lon"), F.col("speed"), bad_speed,
        limits).alias("invalid_reason"))


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaned, invalid) as two filters over one plan."""
    return df.filter(F.col("invalid_reason").isNull()), df.filter(F.col("invalid_reason").isNotNull())


def drop_blank(df: DataFrame, value: str = "value") -> DataFrame:
    return df.filter(F.trim(F.col(value)) != "")


def stateful_ingest(df: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.BROKER_CHUNK) -> DataFrame:
    """Verdict of the per-bus ingest rules in arrival order: ``verdict`` is NULL when accepted.

    Needs (bus_id, arrival, t, trip_id, lat, lon). Only accepted rows move the bus forward, and an
    accepted time is at least the minimum gap after the previous accepted one. So acceptance is a
    greedy selection in arrival order; everything else follows from the last accepted time and from
    the accepted row with the same identity. Rows are shuffled by bus and chunk, and once by identity.
    """
    placed = chunked.paced(df, ["bus_id"], "arrival", limits.min_event_gap_ms, width=width, value="t", ordinal=True)
    identity = ["bus_id", "t", "trip_id", "lat", "lon"]
    # accepted times of a bus differ, so an identity is accepted once at most; no NULL equals another
    same = Window.partitionBy(*identity)
    known = F.lit(True)
    for c in identity:
        known &= F.col(c).isNotNull()
    first = F.when(F.col("chosen"), F.struct("ordinal", "arrival"))
    seen = placed.withColumn("_first", F.when(known, F.max(first).over(same)))
    recent = ((F.col("_first.arrival") < F.col("arrival"))
              & (F.col("ordinal") - F.col("_first.ordinal") <= limits.duplicate_cache))
    verdict = (F.when(F.col("chosen"), F.lit(None).cast("string")).when(recent, "DUPLICATE")
               .when(F.col("t") < F.col("last"), "SEQUENCE_ERROR").otherwise("RATE_LIMIT_EVENT_TIME"))
    return seen.select(*df.columns, F.col("last").alias("last_t"), verdict.alias("verdict"))


def dlq_metadata(df: DataFrame, value: str = "payload", topic: str = "source_topic") -> DataFrame:
    """bus, trip and event time of a rejected payload; the topic path is the fallback for the bus."""
    parts = F.split(F.col(topic), "/")
    from_topic = F.when((F.size(parts) >= 3) & (parts[0] == "transport") & (parts[1] == "bus"),
                        F.nullif(parts[2], F.lit("")))
    text = F.make_valid_utf8(F.col(value).cast("string"))
    parsed = df.withColumn("_v", F.when(F.is_valid_utf8(F.col(value).cast("string")), F.try_parse_json(text)))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    pick = lambda *names: F.when(is_object, F.coalesce(*[F.nullif(_text(n), F.lit("")) for n in names]))
    return parsed.withColumns({
        "original_payload": text,
        "dlq_bus": F.coalesce(pick("busId", "bus_id"), from_topic),
        "dlq_trip": pick("tripId", "trip_id"),
        "event_timestamp": F.when(is_object, scalars.iso_utc(scalars.parse_time(_text("timestamp")))),
    }).drop("_v")


def dlq_envelope(df: DataFrame, value: str = "payload", topic: str = "source_topic") -> DataFrame:
    """Rows with (payload, source_topic, error_type, error_reason, received_at) as DLQ envelopes."""
    return dlq_metadata(df, value, topic).select(
        "original_payload", F.col("dlq_bus").alias("busId"), F.col("dlq_trip").alias("tripId"),
        "event_timestamp", "error_reason", "error_type", F.lit("mqtt").alias("source"),
        F.col(topic).alias("source_topic"), scalars.iso_utc(F.col("received_at")).alias("received_at"))


def crowd_contract(df: DataFrame, header: str | None = None) -> DataFrame:
    """Crowd report field rules; ``error_reason`` is NULL when the report is valid.

    ``header`` names the column of the passenger that the gateway verified: where there is one, it replaces the report's own.
    """
    checks = [
        F.when(~F.coalesce(_length_ok(F.col("trip_id"), 64), F.lit(False)), "trip_id: length must be 1..64"),
        F.when(F.col("route_id").isNull(), "route_id: required"),
        F.when(F.col("stop_id").isNull(), "stop_id: required"),
        F.when(~F.coalesce(F.col("occupancy_score").between(0, 100), F.lit(False)),
               "occupancy_score: must be between 0 and 100"),
        F.when(F.length("passenger_id") > 128, "passenger_id: length must be at most 128"),
    ]
    reason = F.array_compact(F.array(*checks))
    checked = df.withColumn("error_reason", F.when(F.size(reason) > 0, F.array_join(reason, "; ")))
    if header is None:
        return checked
    return checked.withColumn("passenger_id", F.coalesce(F.nullif(F.col(header), F.lit("")), F.col("passenger_id")))


def ingest_counters(df: DataFrame, reason: str = "error_type") -> DataFrame:
    """RECEIVED, VALIDATED and every rejection reason (zero-filled) as (reason, n): one pass, one row
    of counters per task before the merge."""
    kind = F.col(reason)
    counters = {"RECEIVED": F.count("*"), "VALIDATED": F.count_if(kind.isNull()),
                **{r: F.count_if(kind == r) for r in C.REJECTION_REASONS}}
    totals = df.agg(*[c.alias(n) for n, c in counters.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("reason"), F.col(n).alias("n")) for n in counters])
    return totals.select(F.inline(pairs))


def latest_heartbeat(df: DataFrame, as_of_ms: Column) -> DataFrame:
    """Last heartbeat by arrival per bus with its age in seconds, never negative."""
    return (df.groupBy("bus_id").agg(F.max_by("t", "arrival").alias("last_t"))
            .withColumn("age_s", F.greatest(F.lit(0.0), (as_of_ms - F.col("last_t")) / 1000.0)))
