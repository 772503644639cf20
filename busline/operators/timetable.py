"""Schedules, trips, fleet and driver records.

Requests and change logs are replayed with running values (see ``chunked``), because one trip or
bus may have any number of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked
from busline.operators.chunked import Carry


def generate_trips(schedules: DataFrame, existing: DataFrame, day: str) -> DataFrame:
    """Trips of one day from the schedules of its weekday that have none yet; safe to repeat."""
    date = F.to_date(F.lit(day))
    due = schedules.filter(F.col("day_of_week") == scalars.weekday_sun0(date))
    have = existing.filter(F.col("date") == date).select("schedule_id")
    return due.join(have, "schedule_id", "left_anti").select(
        scalars.trip_code(F.col("schedule_id"), date).alias("trip_id"), "schedule_id", date.alias("date"),
        F.lit("WAITING_AT_DEPOT").alias("status"))


def start_guard(status, bus, driver):
    """Reason why a trip cannot start, NULL when it can."""
    return (F.when(status.isNull(), "TRIP_NOT_FOUND")
            .when(status != "WAITING_AT_DEPOT", "WRONG_STATUS")
            .when(bus.isNull() | driver.isNull(), "RESOURCES_MISSING"))


def end_guard(status):
    return F.when(status.isNull(), "TRIP_NOT_FOUND").when(~status.isin(C.ACTIVE_TRIP_STATUSES), "WRONG_STATUS")


def assign(assignments: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Last assignment per key wins as a whole row; NULL values are un-assignments."""
    return (assignments.groupBy(key).agg(F.max_by(F.struct(*columns), "arrival").alias("_a"))
            .select(key, *[F.col(f"_a.{c}").alias(c) for c in columns]))


def assign_resources(trips: DataFrame, assignments: DataFrame) -> DataFrame:
    """Trips with the bus and driver of their latest assignment, where there is one."""
    last = assign(assignments, "trip_id", ["bus_id", "driver_id"]).select(
        "trip_id", F.col("bus_id").alias("_bus"), F.col("driver_id").alias("_driver"), F.lit(True).alias("_set"))
    joined = trips.join(last, "trip_id", "left")
    return joined.withColumns({
        "bus_id": F.when(F.col("_set"), F.col("_bus")).otherwise(F.col("bus_id")),
        "driver_id": F.when(F.col("_set"), F.col("_driver")).otherwise(F.col("driver_id"))}).drop("_bus", "_driver", "_set")


def assign_routes(buses: DataFrame, assignments: DataFrame, routes: DataFrame) -> DataFrame:
    """Buses with their latest valid route assignment; an assignment to an unknown route is ignored."""
    valid = (assignments.filter(F.col("route_id").isNotNull()).join(routes.select("route_id"), "route_id", "left_semi")
             .unionByName(assignments.filter(F.col("route_id").isNull())))
    last = assign(valid, "bus_id", ["route_id"]).select(
        "bus_id", F.col("route_id").alias("_route"), F.lit(True).alias("_set"))
    return buses.join(last, "bus_id", "left").withColumn(
        "route_id", F.when(F.col("_set"), F.col("_route")).otherwise(F.col("route_id"))).drop("_route", "_set")


def replay_requests(trips: DataFrame, requests: DataFrame, width: int = chunked.BROKER_CHUNK) -> DataFrame:
    """Every request with its verdict: ``reason`` is NULL when it took effect.

    Trips: (trip_id, status, bus_id, driver_id). Requests: (trip_id, arrival, kind, t, ...), kind
    in start, end, delay, incident. The status before a request follows from running values: no
    request returns a trip to the depot, so a start works once at most and never after an incident;
    an end works when a start or incident happened since the last end.
    """
    known = trips.select("trip_id", F.col("status").alias("_status"), F.col("bus_id").alias("_bus"),
                         F.col("driver_id").alias("_driver"))
    rows = requests.join(known, "trip_id", "left")
    kind = F.col("kind")
    can_start = start_guard(F.col("_status"), F.col("_bus"), F.col("_driver")).isNull()
    first = chunked.carry(rows, ["trip_id"], "arrival", {
        "_starts": Carry("sum", F.when((kind == "start") & can_start, 1).otherwise(0)),
        "_incidents": Carry("sum", F.when(kind == "incident", 1).otherwise(0))}, width)
    started = first.withColumn("_start_ok", (kind == "start") & can_start & (F.col("_starts") == 0)
                               & (F.col("_incidents") == 0))
    moves = chunked.carry(started, ["trip_id"], "arrival", {
        "_running_since": Carry("last", F.when(F.col("_start_ok") | (kind == "incident"), F.col("arrival"))),
        "_ended_at": Carry("last", F.when(kind == "end", F.col("arrival")))}, width)
    since = F.coalesce(F.col("_running_since"),
                       F.when(F.col("_status").isin(C.ACTIVE_TRIP_STATUSES), F.lit(-1)))
    running = since.isNotNull() & (F.col("_ended_at").isNull() | (F.col("_ended_at") < since))
    missing = F.col("_status").isNull()
    no_resources = (F.col("_starts") == 0) & (F.col("_incidents") == 0) & (F.col("_status") == "WAITING_AT_DEPOT")
    reason = (F.when(missing, "TRIP_NOT_FOUND")
              .when((kind == "start") & ~F.col("_start_ok"),
                    F.when(no_resources, "RESOURCES_MISSING").otherwise("WRONG_STATUS"))
              .when((kind == "end") & ~running, "WRONG_STATUS"))
    return moves.withColumn("reason", reason).drop("_starts", "_incidents", "_start_ok", "_running_since", "_ended_at",
                                                   "_status", "_bus", "_driver")


def trip_states(trips: DataFrame, replayed: DataFrame) -> DataFrame:
    """Trip rows after all accepted requests."""
    ok = replayed.filter(F.col("reason").isNull())
    kind = F.col("kind")
    when = lambda k, value: F.when(kind == k, value)
    status = when("start", "EN_ROUTE").when(kind == "end", "ARRIVED_DESTINATION").when(kind == "incident", "INCIDENT_REPORTED")
    last = lambda k, value: F.max_by(value, F.when(kind == k, F.col("arrival")))
    after = ok.groupBy("trip_id").agg(
        F.max_by(status, F.when(kind != "delay", F.col("arrival"))).alias("_status"),
        F.min(when("start", F.col("t"))).alias("start_t"), last("end", F.col("t")).alias("end_t"),
        last("delay", F.col("delay_minutes")).alias("delay_minutes"),
        last("incident", F.col("incident_type")).alias("last_incident_type"))
    return trips.join(after, "trip_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def lifecycle_events(trips: DataFrame, schedules: DataFrame, replayed: DataFrame) -> DataFrame:
    """Events that accepted start, end and incident requests publish."""
    names = F.when(F.col("kind") == "start", "TRIP_STARTED").when(F.col("kind") == "end", "TRIP_ENDED").when(
        F.col("kind") == "incident", "INCIDENT_REPORTED")
    ok = replayed.filter(F.col("reason").isNull()).withColumn("event", names).filter(F.col("event").isNotNull())
    routed = trips.join(schedules.select("schedule_id", "route_id"), "schedule_id", "left").select(
        "trip_id", F.col("bus_id").alias("_bus"), F.col("route_id").alias("_route"))
    unknown = F.lit("UNKNOWN")
    return ok.join(routed, "trip_id").select(
        "event", F.coalesce(F.col("_bus").cast("string"), unknown).alias("bus_id"), "trip_id",
        F.coalesce(F.col("_route").cast("string"), unknown).alias("route_id"), "t", "arrival")


def incident_history(replayed: DataFrame, trips: DataFrame) -> DataFrame:
    hits = replayed.filter((F.col("kind") == "incident") & F.col("reason").isNull())
    return hits.select("trip_id", "incident_type", "t", "arrival").join(
        trips.select("trip_id", "schedule_id", "bus_id"), "trip_id")


def replay_changes(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial updates: per column the last value that a change sets, else the stored one."""
    folded = changes.groupBy(key).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(f"_{c}") for c in columns])
    joined = base.join(folded, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def register(requests: DataFrame, existing: DataFrame, unique: list[str], checks: dict[str, object] | None = None) -> DataFrame:
    """Registration verdicts: field checks, then every unique column against stored and earlier rows.

    The first request by arrival owns a value among those that pass the field checks. Owners are a
    min per value, which combines before the shuffle, and come back by an equi join.
    """
    reasons = [F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in (checks or {}).items()]
    rows = requests.withColumn("_bad", F.get(F.array_compact(F.array(*reasons)), F.lit(0)) if reasons
                               else F.lit(None).cast("string"))
    verdict = F.col("_bad")
    for column in unique:
        owners = (rows.filter(F.col("_bad").isNull() & F.col(column).isNotNull())
                  .groupBy(column).agg(F.min("arrival").alias(f"_own_{column}")))
        taken = existing.select(column).distinct().withColumn(f"_has_{column}", F.lit(True))
        rows = rows.join(owners, column, "left").join(taken, column, "left")
        clash = F.coalesce(F.col(f"_has_{column}"), F.lit(False)) | (F.col(f"_own_{column}") < F.col("arrival"))
        verdict = F.coalesce(verdict, F.when(clash, F.lit(f"duplicate {column}")))
    return rows.withColumn("reason", verdict).select(*requests.columns, "reason")


def planned_trips(trips: DataFrame, date: str | None = None, driver_id=None, status: str | None = None) -> DataFrame:
    out = trips
    if date is not None:
        out = out.filter(F.col("date") == F.to_date(F.lit(date)))
    if driver_id is not None:
        out = out.filter(F.col("driver_id") == F.lit(driver_id))
    if status is not None:
        out = out.filter(F.col("status") == status)
    return out


def seed_buses(routes: DataFrame, per_route: int = 3) -> DataFrame:
    """Buses with formatted fleet code and plate for every route."""
    return routes.select("route_id", F.explode(F.sequence(F.lit(1), F.lit(per_route))).alias("i")).select(
        scalars.fleet_code(F.col("route_id"), F.col("i")).alias("fleet_code"),
        scalars.plate_number(F.col("route_id"), F.col("i")).alias("plate_number"),
        F.lit(50).alias("capacity"), "route_id")
