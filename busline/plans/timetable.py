"""Queries over schedules, trips, fleet and drivers."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.operators import chunked, timetable
from busline.plans.registry import query
from busline.plans.views import oracle, table, view

DAY = "1998-10-03"


@query("generate_trips", oracle(f"""
SELECT 'TRIP-' || upper(substr(sha256(schedule_id || '_' || '{DAY}'), 1, 8)) AS trip_id, schedule_id, 'WAITING_AT_DEPOT' AS status
FROM schedules WHERE day_of_week = dayofweek(DATE '{DAY}')
  AND schedule_id NOT IN (SELECT schedule_id FROM trips WHERE date = DATE '{DAY}')""", "schedules", "trips"))
def generate_trips(spark, sf):
    return timetable.generate_trips(view(spark, sf, "schedules"), view(spark, sf, "trips"), DAY).select("trip_id", "schedule_id", "status")


_ASSIGN = """SELECT 'TRIP-' || (event_id % 500) AS trip_id, event_id AS arrival, CASE WHEN event_id % 7 = 0 THEN NULL ELSE user_id END AS bus_id,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 10 END AS driver_id FROM ev"""


@query("assign_resources", oracle("""SELECT t.trip_id, CASE WHEN l.arrival IS NOT NULL THEN a.bus_id ELSE t.bus_id END AS bus_id,
  CASE WHEN l.arrival IS NOT NULL THEN a.driver_id ELSE t.driver_id END AS driver_id
  FROM trips t LEFT JOIN (SELECT trip_id, max(arrival) AS arrival FROM assign GROUP BY 1) l USING (trip_id)
  LEFT JOIN assign a ON a.arrival = l.arrival""", "trips", "ev", extra={"assign": _ASSIGN}))
def assign_resources(spark, sf):
    events = view(spark, sf, "ev").select(
        F.concat(F.lit("TRIP-"), (F.col("event_id") % 500).cast("string")).alias("trip_id"), F.col("event_id").alias("arrival"),
        F.when(F.col("event_id") % 7 != 0, F.col("user_id")).alias("bus_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 10).alias("driver_id"))
    return timetable.assign_resources(view(spark, sf, "trips"), events).select("trip_id", "bus_id", "driver_id")


@query("assign_routes", oracle("""
SELECT b.bus_id, CASE WHEN l.arrival IS NOT NULL THEN e.route_id ELSE b.route_id END AS route_id FROM buses b
LEFT JOIN (SELECT bus_id, max(arrival) AS arrival FROM a WHERE route_id IS NULL OR route_id < 5 GROUP BY 1) l USING (bus_id)
LEFT JOIN a e ON e.arrival = l.arrival""", "buses", "ev", extra={
    "a": "SELECT user_id AS bus_id, event_id AS arrival, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 8 END AS route_id FROM ev"}))
def assign_routes(spark, sf):
    events = view(spark, sf, "ev").select(F.col("user_id").alias("bus_id"), F.col("event_id").alias("arrival"),
                                          F.when(F.col("event_id") % 9 != 0, F.col("event_id") % 8).alias("route_id"))
    return timetable.assign_routes(view(spark, sf, "buses"), events, view(spark, sf, "routes")).select("bus_id", "route_id")


# the status machine, request by request, as a recursion over each trip's numbered requests
_FOLD = {
    "numbered": """SELECT r.*, t.status AS first_status, t.bus_id, t.driver_id, row_number() OVER (PARTITION BY r.trip_id ORDER BY arrival) AS n
        FROM requests r LEFT JOIN trips t USING (trip_id)""",
    "steps": """SELECT trip_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS arrival, any_value(first_status) AS status, CAST(NULL AS STRING) AS reason
        FROM numbered GROUP BY trip_id
        UNION ALL
        SELECT s.trip_id, q.n, q.arrival,
          CASE WHEN s.status IS NULL THEN NULL WHEN q.kind = 'start' AND s.status = 'WAITING_AT_DEPOT' AND q.bus_id IS NOT NULL AND q.driver_id IS NOT NULL
            THEN 'EN_ROUTE' WHEN q.kind = 'end' AND s.status IN ('EN_ROUTE', 'INCIDENT_REPORTED') THEN 'ARRIVED_DESTINATION'
            WHEN q.kind = 'incident' THEN 'INCIDENT_REPORTED' ELSE s.status END,
          CASE WHEN s.status IS NULL THEN 'TRIP_NOT_FOUND' WHEN q.kind = 'start' AND s.status <> 'WAITING_AT_DEPOT' THEN 'WRONG_STATUS'
            WHEN q.kind = 'start' AND (q.bus_id IS NULL OR q.driver_id IS NULL) THEN 'RESOURCES_MISSING'
            WHEN q.kind = 'end' AND s.status NOT IN ('EN_ROUTE', 'INCIDENT_REPORTED') THEN 'WRONG_STATUS' END
        FROM steps s JOIN numbered q ON q.trip_id = s.trip_id AND q.n = s.n + 1""",
}


def _fold_sql(select: str, *views: str) -> str:
    return oracle(select, "requests", "trips", *views, extra=_FOLD).replace("WITH ", "WITH RECURSIVE ", 1)


def _replayed(spark, sf):
    requests = view(spark, sf, "requests")
    return timetable.replay_requests(view(spark, sf, "trips"), requests, chunked.ARRIVAL_CHUNK)


@query("trip_requests", _fold_sql("SELECT trip_id, arrival, reason FROM steps WHERE n > 0"))
def trip_requests(spark, sf):
    return _replayed(spark, sf).select("trip_id", "arrival", "reason")


@query("trip_states", _fold_sql("""
SELECT t.trip_id, coalesce(f.status, t.status) AS status, a.start_t, a.end_t, a.delay_minutes, a.last_incident_type FROM trips t
LEFT JOIN (SELECT trip_id, arg_max(status, n) AS status FROM steps GROUP BY 1) f USING (trip_id)
LEFT JOIN (SELECT q.trip_id, min(CASE WHEN kind = 'start' THEN t END) AS start_t, arg_max(t, q.arrival) FILTER (kind = 'end') AS end_t,
   arg_max(delay_minutes, q.arrival) FILTER (kind = 'delay') AS delay_minutes,
   arg_max(incident_type, q.arrival) FILTER (kind = 'incident') AS last_incident_type
   FROM numbered q JOIN steps s ON s.trip_id = q.trip_id AND s.n = q.n WHERE s.reason IS NULL GROUP BY 1) a USING (trip_id)"""))
def trip_states(spark, sf):
    return timetable.trip_states(view(spark, sf, "trips"), _replayed(spark, sf)).select(
        "trip_id", "status", "start_t", "end_t", "delay_minutes", "last_incident_type")


@query("trip_events", _fold_sql("""
SELECT CASE kind WHEN 'start' THEN 'TRIP_STARTED' WHEN 'end' THEN 'TRIP_ENDED' ELSE 'INCIDENT_REPORTED' END AS event,
  coalesce(CAST(q.bus_id AS STRING), 'UNKNOWN') AS bus_id, q.trip_id, coalesce(CAST(c.route_id AS STRING), 'UNKNOWN') AS route_id, q.arrival
FROM numbered q JOIN steps s ON s.trip_id = q.trip_id AND s.n = q.n JOIN trips t ON t.trip_id = q.trip_id
LEFT JOIN schedules c ON c.schedule_id = t.schedule_id WHERE s.reason IS NULL AND kind <> 'delay'""", "schedules"))
def trip_events(spark, sf):
    return timetable.lifecycle_events(view(spark, sf, "trips"), view(spark, sf, "schedules"), _replayed(spark, sf)).select(
        "event", "bus_id", "trip_id", "route_id", "arrival")


@query("incident_history", oracle("""SELECT r.trip_id, r.incident_type, r.arrival, t.schedule_id FROM requests r JOIN trips t USING (trip_id)
  WHERE kind = 'incident'""", "requests", "trips"))
def incident_history(spark, sf):
    return timetable.incident_history(_replayed(spark, sf), view(spark, sf, "trips")).select(
        "trip_id", "incident_type", "arrival", "schedule_id")


@query("driver_updates", oracle("""
SELECT d.driver_id, coalesce(c.driver_name, d.driver_name) AS driver_name, coalesce(c.active, true) AS active FROM (SELECT * FROM drivers) d
LEFT JOIN (SELECT driver_id, arg_max(driver_name, arrival) FILTER (driver_name IS NOT NULL) AS driver_name,
  arg_max(active, arrival) FILTER (active IS NOT NULL) AS active FROM changes GROUP BY 1) c USING (driver_id)""", "drivers", "ev", extra={
    "changes": """SELECT user_id * 2 AS driver_id, event_id AS arrival, CASE WHEN event_type = 'click' THEN 'name-' || event_id END AS driver_name,
        CASE WHEN event_type = 'purchase' THEN event_id % 2 = 0 END AS active FROM ev"""}))
def driver_updates(spark, sf):
    changes = view(spark, sf, "ev").select(
        (F.col("user_id") * 2).alias("driver_id"), F.col("event_id").alias("arrival"),
        F.when(F.col("event_type") == "click", F.concat(F.lit("name-"), F.col("event_id").cast("string"))).alias("driver_name"),
        F.when(F.col("event_type") == "purchase", F.col("event_id") % 2 == 0).alias("active"))
    base = view(spark, sf, "drivers").withColumn("active", F.lit(True))
    return timetable.replay_changes(base, changes, "driver_id", ["driver_name", "active"]).select("driver_id", "driver_name", "active")


@query("register_buses", oracle("""
SELECT a.arrival, CASE WHEN a.capacity <= 0 THEN 'capacity' WHEN b.bus_id IS NOT NULL OR fo < arrival THEN 'duplicate fleet_code'
  WHEN p.bus_id IS NOT NULL OR po < arrival THEN 'duplicate plate_number' END AS reason
FROM (SELECT *, min(CASE WHEN capacity > 0 THEN arrival END) OVER (PARTITION BY fleet_code) AS fo,
   min(CASE WHEN capacity > 0 THEN arrival END) OVER (PARTITION BY plate_number) AS po FROM asks) a
LEFT JOIN buses b ON b.fleet_code = a.fleet_code LEFT JOIN buses p ON p.plate_number = a.plate_number""",
    "buses", "ev", extra={
    "asks": """SELECT event_id AS arrival, 'BUS-' || (event_id * 7) AS fleet_code, 'NA-' || (event_id % 900 + 100000) AS plate_number,
        CASE WHEN event_id % 13 = 0 THEN 0 ELSE 50 END AS capacity FROM ev"""}))
def register_buses(spark, sf):
    asks = view(spark, sf, "ev").select(
        F.col("event_id").alias("arrival"), F.concat(F.lit("BUS-"), (F.col("event_id") * 7).cast("string")).alias("fleet_code"),
        F.concat(F.lit("NA-"), (F.col("event_id") % 900 + 100000).cast("string")).alias("plate_number"),
        F.when(F.col("event_id") % 13 == 0, 0).otherwise(50).alias("capacity"))
    out = timetable.register(asks, view(spark, sf, "buses"), ["fleet_code", "plate_number"], {"capacity": F.col("capacity") > 0})
    return out.select("arrival", "reason")


@query("planned_trips", oracle("SELECT trip_id, date, driver_id FROM trips WHERE status = 'EN_ROUTE' AND driver_id = 13", "trips"))
def planned_trips(spark, sf):
    return timetable.planned_trips(view(spark, sf, "trips"), driver_id=13, status="EN_ROUTE").select("trip_id", "date", "driver_id")


@query("start_guards", oracle("""SELECT trip_id, CASE WHEN status <> 'WAITING_AT_DEPOT' THEN 'WRONG_STATUS' WHEN bus_id IS NULL OR driver_id IS NULL
  THEN 'RESOURCES_MISSING' END AS start_reason, CASE WHEN status NOT IN ('EN_ROUTE', 'INCIDENT_REPORTED') THEN 'WRONG_STATUS' END AS end_reason FROM trips""", "trips"))
def start_guards(spark, sf):
    trips = view(spark, sf, "trips")
    return trips.select("trip_id", timetable.start_guard(F.col("status"), F.col("bus_id"), F.col("driver_id")).alias("start_reason"),
                        timetable.end_guard(F.col("status")).alias("end_reason"))


@query("seed_buses", """SELECT printf('BUS-%03d-%02d', p_partkey, i) AS fleet_code, printf('NA-%02d%02d', p_partkey, i) AS plate_number, 50 AS capacity
  FROM part, unnest([1, 2, 3]) AS u(i)""")
def seed_buses(spark, sf):
    routes = table(spark, sf, "part").select(F.col("p_partkey").alias("route_id"))
    return timetable.seed_buses(routes).select("fleet_code", "plate_number", "capacity")
