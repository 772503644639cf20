"""Trip context: which trip and route a bus is on when a reading arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked
from busline.operators.chunked import Carry

STARTED = ["TRIP_STARTED", "TRIP_ACTIVATED", "STARTED"]
ENDED = ["TRIP_ENDED", "TRIP_COMPLETED", "ENDED"]


def bootstrap_trips(trips: DataFrame, schedules: DataFrame) -> DataFrame:
    """bus → active trip and route from the timetable; the last listed trip of a bus wins."""
    active = trips.filter(F.col("status").isin(C.ACTIVE_TRIP_STATUSES) & F.col("bus_id").isNotNull())
    listed = active.join(schedules.select("schedule_id", "route_id"), "schedule_id")
    return (listed.groupBy("bus_id")
            .agg(F.max_by(F.struct("trip_id", "route_id"), F.struct("status", "trip_seq")).alias("_b"))
            .select(F.col("bus_id").cast("string").alias("bus_id"), F.col("_b.trip_id").alias("boot_trip"),
                    F.col("_b.route_id").cast("string").alias("boot_route")))


def attach_trips(telemetry: DataFrame, lifecycle: DataFrame, bootstrap: DataFrame | None = None,
                 newer_only: bool = True, width: int = chunked.BROKER_CHUNK) -> DataFrame:
    """As-of join of readings with trip events by bus in arrival order.

    Telemetry: (bus_id, arrival, t, payload_trip, payload_route, ...). Lifecycle: (bus_id, arrival,
    event, trip_id, route_id). A started trip is remembered as a whole struct and an ended one
    writes a cleared struct, so "cleared" is not confused with "never seen". ``newer_only`` keeps
    only readings strictly newer than every earlier reading of the bus. Adds trip_id, route_id,
    trip_status; lifecycle rows are not returned.
    """
    payload = [c for c in telemetry.columns if c not in ("bus_id", "arrival")]
    marker = (F.when(F.col("event").isin(STARTED) & F.col("route_id").isNotNull(),
                     F.struct(F.col("trip_id").alias("trip"), F.col("route_id").alias("route"),
                              F.lit("ACTIVE").alias("status")))
              .when(F.col("event").isin(ENDED),
                    F.struct(F.lit(None).cast("string").alias("trip"), F.lit(None).cast("string").alias("route"),
                             F.lit("INACTIVE").alias("status"))))
    events = (lifecycle.withColumn("_marker", marker).filter(F.col("_marker").isNotNull())
              .select("bus_id", "arrival", "_marker", F.col("trip_id").alias("_map_trip"),
                      F.col("_marker.route").alias("_map_route")))
    readings = telemetry.select("bus_id", "arrival", F.struct(*payload).alias("_row"))
    both = readings.unionByName(events, allowMissingColumns=True)
    state = chunked.carry(both, ["bus_id"], "arrival", {
        "_state": Carry("last", F.col("_marker")),
        "_newest": Carry("max", F.col("_row.t"))}, width)
    rows = state.filter(F.col("_row").isNotNull())
    if newer_only:
        rows = rows.filter(F.col("_newest").isNull() | (F.col("_row.t") > F.col("_newest")))
    rows = rows.select("bus_id", "arrival", "_row.*", "_state")

    # a trip named in the payload may be known from an earlier start although it is not active now
    named = telemetry.filter(F.col("payload_trip").isNotNull() & F.col("payload_route").isNull())
    asked = named.select("bus_id", "arrival", F.col("payload_trip").alias("_map_trip"), F.lit(1).alias("_ask"))
    known = events.select("bus_id", "arrival", "_map_trip",
                          F.struct(F.col("_map_route").alias("route")).alias("_entry"))
    found = (chunked.carry(asked.unionByName(known, allowMissingColumns=True), ["bus_id", "_map_trip"], "arrival",
                           {"_known": Carry("last", F.col("_entry"))}, width)
             .filter("_ask = 1").select("bus_id", "arrival", F.col("_known.route").alias("_known_route")))
    rows = rows.join(found, ["bus_id", "arrival"], "left")
    if bootstrap is None:
        rows = rows.withColumns({"boot_trip": F.lit(None).cast("string"), "boot_route": F.lit(None).cast("string")})
    else:
        rows = rows.join(bootstrap, "bus_id", "left")
    never_seen = F.col("_state").isNull()
    boot_trip, boot_route = F.when(never_seen, F.col("boot_trip")), F.when(never_seen, F.col("boot_route"))
    trip = F.coalesce("payload_trip", "_state.trip", boot_trip)
    route = F.coalesce(F.col("payload_route"), F.col("_state.route"), boot_route, F.col("_known_route"))
    status = F.coalesce(F.col("_state.status"), F.when(boot_trip.isNotNull(), "ACTIVE"),
                        F.when(route.isNotNull(), "ACTIVE").otherwise("INACTIVE"))
    return (rows.withColumns({"trip_id": trip, "route_id": route, "trip_status": status})
            .drop("_state", "_known_route", "boot_trip", "boot_route"))


def strictly_newer(df: DataFrame, width: int = chunked.BROKER_CHUNK) -> DataFrame:
    """Readings newer than every reading of the bus that arrived before (late and repeated ones go)."""
    seen = chunked.carry(df, ["bus_id"], "arrival", {"_newest": Carry("max", F.col("t"))}, width)
    return seen.filter(F.col("_newest").isNull() | (F.col("t") > F.col("_newest"))).drop("_newest")


def active_trips(lifecycle: DataFrame, require_matching_trip: bool = True) -> DataFrame:
    """Active trip per bus after replaying all events.

    The last start of a bus stays active unless an end follows it; with ``require_matching_trip``
    only an end of that same trip counts.
    """
    starts = lifecycle.filter(F.col("event").isin(STARTED)).groupBy("bus_id").agg(
        F.max_by(F.struct("trip_id", "route_id", "t", "arrival"), "arrival").alias("s"))
    ends = lifecycle.filter(F.col("event").isin(ENDED))
    keys = ["bus_id", "trip_id"] if require_matching_trip else ["bus_id"]
    last_end = ends.groupBy(*keys).agg(F.max("arrival").alias("_end"))
    active = starts.select("bus_id", "s.trip_id", "s.route_id", F.col("s.t").alias("started_t"), "s.arrival")
    return (active.join(last_end, keys, "left")
            .filter(F.col("_end").isNull() | (F.col("_end") < F.col("arrival"))).drop("_end", "arrival"))


def trip_cache_status(lifecycle: DataFrame) -> DataFrame:
    """One row: number of active trips and time of the last lifecycle event by arrival."""
    active = active_trips(lifecycle).agg(F.count("*").alias("active_trip_count"))
    return active.withColumn("last_lifecycle_t", lifecycle.agg(F.max_by("t", "arrival")).scalar())


def require_active_trip(readings: DataFrame, active: DataFrame, required: bool = True) -> DataFrame:
    """Attach the active trip; ``error_type`` INACTIVE_TRIP where a required one is missing."""
    joined = readings.join(active.select("bus_id", F.col("trip_id").alias("active_trip")), "bus_id", "left")
    if not required:
        return joined.withColumns({"trip_id": F.coalesce("active_trip", F.lit("UNSCOPED_TRIP")),
                                   "error_type": F.lit(None).cast("string")}).drop("active_trip")
    return joined.withColumns({
        "trip_id": F.col("active_trip"),
        "error_type": F.when(F.col("active_trip").isNull(), "INACTIVE_TRIP")}).drop("active_trip")


def scaffold_context(readings: DataFrame, active: DataFrame) -> DataFrame:
    """Older rule: equi join with the active-trip table, fields already on the message win."""
    joined = readings.join(active.select("bus_id", F.col("trip_id").alias("_trip"), F.col("route_id").alias("_route")),
                           "bus_id", "left")
    status = (F.when(F.col("bus_id").isNull(), "unknown").when(F.col("_trip").isNotNull(), "active")
              .otherwise("inactive"))
    return joined.withColumns({
        "trip_id": F.coalesce("payload_trip", "_trip"), "route_id": F.coalesce("payload_route", "_route"),
        "trip_status": status}).drop("_trip", "_route")


def startup_buffer(readings: DataFrame, ready_arrival: int, size: int = C.DEFAULTS.startup_buffer) -> DataFrame:
    """Readings that arrive while the trip table rebuilds: the first ``size`` wait, the rest are refused.

    Adds ``evaluate_at`` (the arrival at which the row is looked up) and ``error_type``. The cut
    is the ``size``-th arrival, found with a distributed top-k instead of numbering all rows.
    """
    early = readings.filter(F.col("arrival") < ready_arrival).select("arrival").orderBy("arrival").limit(size)
    cut = early.agg(F.max("arrival")).scalar()
    waiting = F.col("arrival") < ready_arrival
    return readings.withColumns({
        "evaluate_at": F.when(waiting, F.lit(ready_arrival)).otherwise(F.col("arrival")).cast("long"),
        "error_type": F.when(waiting & (F.col("arrival") > cut), "TRIP_CACHE_REBUILDING")})


def telemetry_key(bus: str = "bus_id"):
    return F.coalesce(F.col(bus), F.lit("unknown"))


def parse_lifecycle(df: DataFrame, value: str = "value") -> DataFrame:
    """Lifecycle JSON with either key spelling and either name of the event field."""
    parsed = df.withColumn("_v", F.try_parse_json(value))
    text = lambda name: F.try_variant_get("_v", f"$.{name}", "string")
    return parsed.select(
        *df.columns, F.upper(F.coalesce(text("event"), text("type"))).alias("event"),
        F.coalesce(text("busId"), text("bus_id")).alias("bus_id"),
        F.coalesce(text("tripId"), text("trip_id")).alias("trip_id"),
        F.coalesce(text("routeId"), text("route_id")).alias("route_id"),
        F.unix_millis(scalars.parse_time(text("timestamp"))).alias("t"))
