"""Scalar rules used across operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busline import contracts as C


def parse_time(value: Column, fallback: Column | None = None) -> Column:
    """Event time: ISO-8601 (``Z`` or offset, naive = UTC) or epoch seconds; else ``fallback``."""
    numeric = F.when(value.rlike(r"^[+-]?\d+(\.\d+)?$"), F.timestamp_seconds(value.try_cast("double")))
    iso = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(value))
    parsed = F.coalesce(numeric, iso)
    return parsed if fallback is None else F.coalesce(parsed, fallback)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")


def weekday_sun0(day: Column) -> Column:
    return F.dayofweek(day) - 1


def is_weekend(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def is_rush_hour(ts: Column) -> Column:
    return F.hour(ts).between(7, 9) | F.hour(ts).between(17, 19)


def month_start(ts: Column) -> Column:
    return F.date_trunc("month", ts)


def month_partition(ts: Column, prefix: str = "eta_records_") -> Column:
    return F.concat(F.lit(prefix), F.date_format(ts, "yyyy_MM"))


def occupancy_label(score: Column) -> Column:
    return F.when(score < 40, "NOT_FULL").when(score < 75, "SEMI_FULL").otherwise("FULL")


def label_score(label: Column) -> Column:
    return F.when(label == "NOT_FULL", 20).when(label == "SEMI_FULL", 55).when(label == "FULL", 90).otherwise(50)


def class_score(klass: Column) -> Column:
    return F.when(klass == 0, 20).when(klass == 1, 55).when(klass == 2, 90).otherwise(55)


def occupancy_class(score: Column) -> Column:
    return F.when(score < 40, 0).when(score < 75, 1).otherwise(2)


def cold_start_score(ts: Column) -> Column:
    return F.when(is_rush_hour(ts), 55).otherwise(20)


def route_label(number: Column, name: Column) -> Column:
    return F.coalesce(F.nullif(number, F.lit("")), name)


def identity_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("_", *[p.cast("string") for p in parts]), 256)


def trip_code(schedule_id: Column, day: Column) -> Column:
    """Deterministic trip id of one schedule on one day, so that re-runs give the same id."""
    digest = F.sha2(F.concat_ws("_", schedule_id.cast("string"), day.cast("string")), 256)
    return F.concat(F.lit("TRIP-"), F.upper(F.substring(digest, 1, 8)))


def fleet_code(route: Column, index: Column) -> Column:
    return F.format_string("BUS-%03d-%02d", route.cast("int"), index)


def plate_number(route: Column, index: Column) -> Column:
    return F.format_string("NA-%02d%02d", route.cast("int"), index)


def feature_row(names: list[str]) -> Column:
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


def severity(kind: Column) -> Column:
    return F.when(kind.isin(C.HIGH_SEVERITY), "HIGH").otherwise("MEDIUM")


def audiences(kind: Column) -> Column:
    """Channels that must see an alert; a kind nobody lists goes to the administrators."""
    listed = F.array_compact(F.array(
        F.when(kind.isin(C.ADMIN_ALERTS), C.ADMIN_CHANNEL),
        F.when(kind.isin(C.DRIVER_ALERTS), C.DRIVER_CHANNEL),
        F.when(kind.isin(C.PASSENGER_ALERTS), C.PASSENGER_CHANNEL)))
    return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(C.ADMIN_CHANNEL)))


def physics_eta(distance_m: Column, speed_ms: Column) -> Column:
    """struct(eta_seconds, distance_m, speed_ms, clamped)."""
    distance = F.greatest(distance_m, F.lit(0.0))
    effective = F.greatest(speed_ms, F.lit(C.MIN_SPEED_MS))
    return F.struct((distance / effective).alias("eta_seconds"), distance.alias("distance_m"),
                    effective.alias("speed_ms"), (speed_ms < C.MIN_SPEED_MS).alias("clamped"))


def expressway_eta(distance_m: Column, speed_ms: Column, weather: Column | float = 1.0) -> Column:
    base = physics_eta(distance_m, speed_ms)
    coefficient = F.greatest(F.lit(weather) if not isinstance(weather, Column) else weather, F.lit(0.5))
    return F.struct((base["eta_seconds"] * coefficient).alias("eta_seconds"), base["distance_m"].alias("distance_m"),
                    base["speed_ms"].alias("speed_ms"), base["clamped"].alias("clamped"))


def device_config(location_interval: Column, heartbeat_interval: Column, new_bus_id: Column) -> Column:
    """``I:..,H:..,B:..`` from the fields that are set; NULL when none is."""
    text = F.concat_ws(",", F.concat(F.lit("I:"), location_interval.cast("string")),
                       F.concat(F.lit("H:"), heartbeat_interval.cast("string")),
                       F.concat(F.lit("B:"), new_bus_id))
    return F.nullif(text, F.lit(""))
