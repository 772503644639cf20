"""Service payloads of several shapes, read through one path of coalesced alternatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _entries(value: Column, *list_names: str) -> Column:
    """The payload's entries as an array of JSON texts: a named list, a bare list, or the object itself."""
    parsed = F.try_parse_json(value)
    as_list = lambda path: F.try_variant_get(parsed, path, "array<variant>")
    is_list = F.schema_of_variant(parsed).startswith("ARRAY")
    named = F.coalesce(*[as_list(f"$.{n}") for n in list_names])
    return F.when(is_list, as_list("$")).otherwise(F.coalesce(named, F.array(parsed)))


def _text(item: str, *names: str) -> Column:
    return F.coalesce(*[F.try_variant_get(F.col(item), f"$.{n}", "string") for n in names])


def read_routes(df: DataFrame, value: str = "value") -> DataFrame:
    """(route_id, points): lists under items/routes or bare; polyline, geometry or points of either shape.

    A point is {lat, lon}, {latitude, longitude} or [lat, lon]; points that are none of these are
    skipped, and so is a route without an id or without points.
    """
    items = df.select(F.explode(_entries(F.col(value), "items", "routes")).alias("_e"))
    parts = [F.try_variant_get("_e", f"$.{n}", "array<variant>") for n in ("polyline", "geometry", "points")]
    chosen = F.coalesce(*[F.when(F.size(p) > 0, p) for p in parts])

    def number(v: Column, *paths: str) -> Column:
        return F.coalesce(*[F.try_variant_get(v, p, "double") for p in paths])

    def point(v: Column) -> Column:
        lat, lon = number(v, "$.lat", "$.latitude", "$[0]"), number(v, "$.lon", "$.longitude", "$[1]")
        return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))

    routes = items.select(_text("_e", "routeId", "route_id", "id").alias("route_id"),
                          F.array_compact(F.transform(chosen, point)).alias("points"))
    return routes.filter(F.col("route_id").isNotNull() & (F.size("points") > 0))


def read_active_trips(df: DataFrame, value: str = "value") -> DataFrame:
    """(bus_id, trip_id, route_id, status, timestamp) with either key spelling."""
    items = df.select(F.explode(_entries(F.col(value), "items", "activeTrips")).alias("_e"))
    rows = items.select(_text("_e", "busId", "bus_id").alias("bus_id"), _text("_e", "tripId", "trip_id").alias("trip_id"),
                        _text("_e", "routeId", "route_id").alias("route_id"), F.lit("active").alias("status"),
                        _text("_e", "timestamp").alias("timestamp"))
    return rows.filter(F.col("bus_id").isNotNull() & F.col("trip_id").isNotNull())
