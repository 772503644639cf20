"""Operators on literal inputs and against brute force."""

import math
import os
import random
import tempfile

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline import contracts as C
from busline.functions import geo, scalars
from busline.operators import (context, crowd, detect, dwell, enrich, eta, forest, hotspots, network, seasonal,
                               spatial, timetable, train, validate)
from busline.sinks import writers
from busline.sources import kml, payloads, readers


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def hav(a, b, c, d):
    p, q = math.radians(c - a) / 2, math.radians(d - b) / 2
    h = math.sin(p) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(q) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def line(spark, points, route="R"):
    return spark.createDataFrame([(route, i, float(a), float(b)) for i, (a, b) in enumerate(points)],
                                 "route_id string, seq int, lat double, lon double")


def at(spark, *points):
    return spark.createDataFrame([(i, "R", float(a), float(b)) for i, (a, b) in enumerate(points)],
                                 "id int, route_id string, lat double, lon double")


# --- geometry ----------------------------------------------------------------------------------

def test_progress_and_off_route(spark):
    shapes = geo.route_segments(line(spark, [(6, 80), (7, 80)]))
    out = geo.route_position(at(spark, (6.5, 80), (6.5, 80.001), (5.9, 80), (7.1, 80)).join(shapes, "route_id")).orderBy("id").collect()
    assert abs(out[0].pos.progress_pct - 50) < 0.01 and out[0].pos.off_m < 1
    assert out[1].pos.off_m > 50
    assert out[2].pos.progress_pct == 0 and out[3].pos.progress_pct == 100 and out[3].pos.remaining_m == 0


def test_degenerate_routes(spark):
    for points, off in [([(6, 80)], hav(6.5, 80, 6, 80)), ([(6, 80), (6, 80)], hav(6.5, 80, 6, 80))]:
        shapes = geo.route_segments(line(spark, points))
        pos = geo.route_position(at(spark, (6.5, 80)).join(shapes, "route_id", "left")).first().pos
        assert abs(pos.off_m - off) < 1e-6 and pos.progress_pct == 0 and pos.remaining_m == 0
    none = geo.route_position(at(spark, (6.5, 80)).join(geo.route_segments(line(spark, [(1, 1)], "X")), "route_id", "left")).first().pos
    assert none.off_m == 0 and none.progress_pct == 0


def test_short_lists_give_the_full_answer(spark):
    rng = random.Random(5)
    points, lat, lon = [], 6.5, 80.0
    for _ in range(120):
        lat, lon = lat + rng.uniform(-0.001, 0.003), lon + rng.uniform(-0.002, 0.002)
        points.append((lat, lon))
    shapes = geo.route_segments(line(spark, points)).persist()
    cells = geo.route_cells(shapes)
    spots = [(a + rng.uniform(-0.004, 0.004), b + rng.uniform(-0.004, 0.004)) for a, b in points for _ in range(4)]
    asked = at(spark, *spots).join(shapes, "route_id")
    full = geo.route_position(asked).select("id", F.round("pos.off_m", 6), F.round("pos.along_m", 6))
    short = geo.route_position(geo.with_near_segments(asked, cells)).select("id", F.round("pos.off_m", 6), F.round("pos.along_m", 6))
    assert rows_of(full) == rows_of(short)
    lengths = cells.agg(F.avg(F.size("near_segments"))).first()[0]
    assert lengths < 30
    planar = lambda d, legs: rows_of(d.select("id", geo.planar_locate(F.col("lat"), F.col("lon"), legs)["along_m"]))
    near = geo.with_near_segments(asked, cells)
    assert planar(near, F.col("segments")) == planar(near, F.coalesce("near_segments", "segments"))


def test_nearest_vertex_is_exact_far_and_near(spark):
    rng = random.Random(6)
    vertices = [(rng.uniform(6, 9), rng.uniform(79.5, 81.5)) for _ in range(300)]
    spots = [(rng.uniform(5, 10), rng.uniform(79, 82)) for _ in range(100)] + [(20.0, 60.0)]
    out = spatial.nearest_vertex(at(spark, *spots), line(spark, vertices), ["id"])
    got = {r.id: r.nearest_m for r in out.collect()}
    for i, (a, b) in enumerate(spots):
        assert abs(got[i] - min(hav(a, b, c, d) for c, d in vertices)) < 1e-6


def test_near_join_equals_brute_force(spark):
    rng = random.Random(7)
    left = [(i, rng.uniform(6, 6.2), rng.uniform(80, 80.2), rng.choice([200.0, 900.0])) for i in range(80)]
    right = [(i, rng.uniform(6, 6.2), rng.uniform(80, 80.2)) for i in range(150)]
    a = spark.createDataFrame(left, "id int, lat double, lon double, radius_m double")
    b = spark.createDataFrame(right, "sid int, lat double, lon double")
    got = {(r.id, r.r_sid) for r in spatial.near(a, b).collect()}
    assert got == {(i, j) for i, x, y, r in left for j, p, q in right if hav(x, y, p, q) <= r}


def test_near_join_has_no_radius_cap(spark):
    rng = random.Random(11)
    for south, west in ((-3, 79), (58, 10), (84, 170), (-20, 178)):
        left = [(i, rng.uniform(south, south + 2), rng.uniform(west, west + 3), rng.choice([3.0, 40_000.0, 250_000.0, 9_000_000.0])) for i in range(30)]
        left = [(i, x, y - 360 if y > 180 else y, r) for i, x, y, r in left]
        right = [(i, rng.uniform(south - 1, south + 3), rng.uniform(west - 2, west + 5)) for i in range(60)] + [(99, left[0][1], left[0][2])]
        right = [(i, x, y - 360 if y > 180 else y) for i, x, y in right]
        a = spark.createDataFrame(left, "id int, lat double, lon double, radius_m double")
        b = spark.createDataFrame(right, "sid int, lat double, lon double")
        got = sorted((r.id, r.r_sid) for r in spatial.near(a, b).collect())
        assert got == sorted((i, j) for i, x, y, r in left for j, p, q in right if hav(x, y, p, q) <= r)


def test_zones_of_any_size(spark):
    zones = spark.createDataFrame([("small", 1, 6.9, 80.0, 30.0), ("wide", 2, 6.9, 80.0, 700.0), ("region", 3, 7.5, 80.0, 90_000.0)],
                                  "stop_id string, zone_pos int, lat double, lon double, radius_m double")
    points = at(spark, (6.9, 80.0001), (6.903, 80.0), (6.905, 80.003), (7.4, 80.4), (9.5, 80.0))
    got = {r.id: r.stop_id for r in dwell.resolve_stop(points, zones, ["id"]).collect()}
    assert got == {0: "small", 1: "wide", 2: "wide", 3: "region", 4: None}


def test_stop_zones(spark):
    zones = spark.createDataFrame([("B", 1, 6.9, 80.0, 50.0), ("A", 0, 6.9, 80.0003, 50.0)],
                                  "stop_id string, zone_pos int, lat double, lon double, radius_m double")
    points = at(spark, (6.9, 80.0001), (6.9, 80.0), (6.95, 80.0))
    got = {r.id: r.stop_id for r in dwell.resolve_stop(points, zones, ["id"]).collect()}
    assert got == {0: "A", 1: "A", 2: None}


# --- literal rules -----------------------------------------------------------------------------

def test_dwell_literal(spark):
    visits = spark.createDataFrame([("b", "t", s * 1000, p) for s, p in [(0, "A"), (60, "A"), (90, "B"), (100, "B")]],
                                   "bus_id string, trip_id string, t long, stop_id string")
    got = [(r.dwell_current_s, r.dwell_prev_s) for r in dwell.dwell(visits, width=1 << 60).orderBy("t").collect()]
    assert got == [(0, None), (60, None), (0, 60), (10, 60)]


def cleaned(spark, rows):
    return spark.createDataFrame([("b", int(t * 1000), off, "T", "R", 6.9, 80.0, 60.0) for t, off in rows],
                                 "bus_id string, t long, off_route boolean, trip_id string, route_id string, lat double, "
                                 "lon double, off_route_m double")


def test_streaks(spark):
    rows = cleaned(spark, [(t, True) for t in (0, 1, 2, 3, 9, 10, 11)])
    assert [r.t for r in detect.off_route_streaks(rows, width=1 << 60).orderBy("t").collect()] == [2000, 11000]
    reset = cleaned(spark, [(0, True), (1, True), (2, False), (3, True), (4, True)])
    assert detect.off_route_streaks(reset, width=1 << 60).count() == 0


def test_summary_vector(spark):
    df = spark.createDataFrame([("k", t * 1000, float(v), 0.0) for t, v in [(0, 12), (10, 30), (20, 18)]] + [("one", 0, 5.0, 1.0)],
                               "k string, t long, speed double, heading double")
    got = {r.k: r for r in detect.summary_vector(df, ["k"]).collect()}
    assert abs(got["k"].max_acceleration - 1.8) < 1e-9 and abs(got["k"].min_acceleration + 1.2) < 1e-9
    assert got["k"].average_speed == 20 and got["k"].sample_count == 3
    assert got["one"].speed_variance == 0 and got["one"].average_speed == 0


def test_dlq_window(spark):
    df = spark.createDataFrame([("b", t * 1000, t, "INACTIVE_TRIP", None, "T", "R", 6.9, 80.0) for t in (0, 20, 40, 50, 350)],
                               "bus_id string, t long, arrival long, error_type string, error_reason string, trip_id string, "
                               "route_id string, lat double, lon double")
    assert [r.t for r in detect.trip_not_started(df, width=1 << 60).collect()] == [40000]


def test_ingest_fold(spark):
    rows = [(0, 0), (1, 500), (2, 1000), (3, 1000), (4, 200)]
    df = spark.createDataFrame([("b", a, t, "T", 6.9, 80.0) for a, t in rows],
                               "bus_id string, arrival long, t long, trip_id string, lat double, lon double")
    got = [r.verdict for r in validate.stateful_ingest(df, width=1 << 60).orderBy("arrival").collect()]
    assert got == [None, "RATE_LIMIT_EVENT_TIME", None, "DUPLICATE", "SEQUENCE_ERROR"]


def test_physics_eta(spark):
    df = spark.createDataFrame([(100.0, 0.5), (-1.0, 5.0)], "d double, v double")
    a, b = df.select(scalars.physics_eta(F.col("d"), F.col("v")).alias("e")).collect()
    assert abs(a.e.eta_seconds - 71.4286) < 1e-3 and a.e.clamped and b.e.eta_seconds == 0


def test_trust_literal(spark):
    cases = {"agree": [40, 60], "differ": [95, 99], "few": [40]}
    rows = []
    for i, (who, others) in enumerate(cases.items()):
        rows += [(100 * i + j, i, 1, float(s), f"o{j}", 1000) for j, s in enumerate(others)]
        rows.append((100 * i + 50, i, 1, 50.0, who, 2000))
    df = spark.createDataFrame(rows, "arrival long, route_id int, stop_id int, score double, passenger_id string, t long")
    got = {r.passenger_id: r for r in crowd.trust_profiles(crowd.consensus(df, width=1 << 60)).collect()}
    assert got["agree"].trust_score == 0.82 and got["differ"].trust_score == 0.75
    assert got["few"].trust_score == 0.8 and got["few"].verified_reports == 1 and got["differ"].verified_reports == 0


def test_hybrid_literal(spark):
    live = spark.createDataFrame([(1, 5, 80.0, 4.0)], "request_id int, report_count long, avg_live double, trust_sum double")
    out = crowd.hybrid_prediction(live, F.lit(20)).first()
    assert abs(out.final_score - 62) < 1e-9 and out.prediction == "SEMI_FULL" and out.confidence == 0.9 and out.live_adjustment


def test_live_sums_are_rounded_once(spark):
    """Sums of trust equal the exact ones, whatever the order of the reports, of which two share an instant."""
    rng = random.Random(3)
    said = [(7, 8, 1000 * (i - i % 2), rng.randint(0, 100), f"p{rng.randint(0, 30)}") for i in range(60)]
    profiles = {f"p{i}": rng.randint(0, 100) / 100 for i in range(29)}
    reports = spark.createDataFrame(said, "route_id int, stop_id int, t long, score long, passenger_id string")
    trust = spark.createDataFrame(list(profiles.items()), "passenger_id string, trust_score double")
    requests = spark.createDataFrame([(k, 7, 8, 1000 * k) for k in range(60)], "request_id int, route_id int, stop_id int, t long")
    for row in crowd.live_occupancy(requests, reports, trust, exact=True).collect():
        near = [(s, profiles.get(p, 0.8)) for _, _, t, s, p in said if t <= row.t]
        assert row.trust_sum == math.fsum(w for _, w in near) and row.weighted_sum == math.fsum(s * w for s, w in near)
        assert row.report_count == len(near) and row.score_sum == sum(s for s, _ in near)


def test_custom_physics_function(spark):
    rows = spark.createDataFrame([(100.0, 5.0, None, None, "urban")], "distance_m double, speed_ms double, tree_eta double, "
                                                                      "seasonal_eta double, segment_mode string")

    def slow(d, v):
        return F.struct((d / v * 2).alias("eta_seconds"), d.alias("distance_m"), v.alias("speed_ms"), F.lit(False).alias("clamped"))

    assert eta.cascade(rows, "physics", physics=slow).first().eta_seconds == 40


def test_a_bus_at_its_stop_is_scored_by_trees_only_where_there_are_any(spark):
    rows = spark.createDataFrame([(0.0, 5.0, None, None, "urban")], "distance_m double, speed_ms double, tree_eta double, "
                                                                    "seasonal_eta double, segment_mode string")
    with_trees, without = eta.cascade(rows, "xgboost").first(), eta.estimated(rows).first()
    assert (with_trees.model_used, with_trees.fallback) == ("xgboost", False)
    assert (without.model_used, without.fallback, without.eta_seconds, without.clamped) == ("physics", True, 0.0, False)
    assert eta.estimated(rows, model="sarima").first().model_used == "physics"


def test_startup_buffer_keeps_the_first_rows(spark):
    df = spark.range(0, 50).select(F.col("id").alias("arrival"))
    out = context.startup_buffer(df, 30, size=10)
    assert out.filter("error_type is not null").count() == 20
    assert out.filter("arrival < 10").select("evaluate_at").distinct().collect()[0][0] == 30


def test_trip_generation_is_idempotent(spark):
    schedules = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 1, 3)], "schedule_id int, route_id int, day_of_week int")
    none = spark.createDataFrame([], "schedule_id int, date date")
    first = timetable.generate_trips(schedules, none, "2026-05-03")  # a Sunday
    assert {r.schedule_id for r in first.collect()} == {1, 2}
    assert timetable.generate_trips(schedules, first, "2026-05-03").count() == 0
    again = timetable.generate_trips(schedules, none, "2026-05-03")
    assert rows_of(again) == rows_of(first)


# --- sources and sinks -------------------------------------------------------------------------

@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="busline-io-", dir="/tmp")


KML = """<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>{}</Document></kml>"""
POINT = "<Placemark><name>{}</name><Point><coordinates>{}</coordinates></Point></Placemark>"
LINE = "<Placemark><name>x</name><LineString><coordinates>{}</coordinates></LineString></Placemark>"


def test_kml_files(spark, folder):
    good = LINE.format("80.0,6.0,0 80.0,7.0,0") + POINT.format("First", "80.0,6.0,0") + POINT.format(" ", "80.0,7.0")
    bad = {"line-only": LINE.format("80.0,6.0 80.0,7.0"), "broken": LINE.format("80.0,x 80.0,7.0") + POINT.format("a", "80,6") * 2, "bare": "<name>x</name>"}
    for name, body in {"good": good, **bad}.items():
        with open(f"{folder}/{name}.kml", "w") as f:
            f.write(KML.format(body))
    routes, rejects = kml.read_kml(spark, folder)
    route = routes.first()
    assert routes.count() == 1 and route.route_name == "good" and [list(c) for c in route.coordinates] == [[80.0, 6.0], [80.0, 7.0]]
    assert [s.stop_name for s in route.stops] == ["First", "Unnamed Stop"]
    assert {os.path.basename(r.file): r.reason for r in rejects.collect()} == {
        "line-only.kml": "NEEDS_LINE_AND_TWO_STOPS", "broken.kml": "MALFORMED_COORDINATE", "bare.kml": "NEEDS_LINE_AND_TWO_STOPS"}


def test_polymorphic_payloads(spark):
    texts = ['{"items":[{"routeId":1,"polyline":[{"lat":6,"lon":80},{"latitude":7,"longitude":81},{"lat":1}]}]}',
             '{"routes":[{"route_id":"2","geometry":[[6,80],[7,80]]},{"points":[[1,2]]}]}', '[{"id":3,"points":[[6.5,80]]}]',
             '{"id":"4","points":[]}', '{bad', '{"id":"5","points":[[1,2]]}']
    df = spark.createDataFrame([(t,) for t in texts], "value string")
    got = {r.route_id: [tuple(p) for p in r.points] for r in payloads.read_routes(df).collect()}
    assert got == {"1": [(6, 80), (7, 81)], "2": [(6, 80), (7, 80)], "3": [(6.5, 80)], "5": [(1, 2)]}
    trips = ['{"activeTrips":[{"busId":1,"tripId":"a","routeId":"r"},{"busId":2}]}', '[{"bus_id":"3","trip_id":"c"}]']
    got = rows_of(payloads.read_active_trips(spark.createDataFrame([(t,) for t in trips], "value string")).select("bus_id", "trip_id", "route_id"))
    assert got == [("1", "a", "r"), ("3", "c", None)]


def test_bad_coordinate_drops_the_route(spark):
    df = spark.createDataFrame([("a", [[80.0, 6.0], [80.0, 7.0]]), ("b", [[80.0, 6.0], [80.0]])], "route_id string, coordinates array<array<double>>")
    assert [(r.route_id, r.lat) for r in network.route_points(df).orderBy("seq").collect()] == [("a", 6.0), ("a", 7.0)]


def test_training_csv_names_missing_columns(spark, folder):
    writers.export_csv(spark.createDataFrame([(1.0, 2.0)], "distance_m double, speed_ms double"), f"{folder}/csv")
    assert readers.training_csv(spark, f"{folder}/csv", ["distance_m"]).first().distance_m == 1.0
    with pytest.raises(ValueError, match="physics_eta, eta_seconds"):
        readers.training_csv(spark, f"{folder}/csv", ["distance_m", "physics_eta", "eta_seconds"])


def test_payload_files_and_invalid_utf8(spark, folder):
    path = f"{folder}/transport/bus/b7/location"
    os.makedirs(path)
    with open(f"{path}/1", "wb") as f:
        f.write(b'\xff\xfe{"busId"')
    rows = readers.payload_table(spark, folder)
    envelope = validate.dlq_envelope(rows.withColumns({"error_type": F.lit("JSON_PARSE"), "error_reason": F.lit("x")})).first()
    assert envelope.busId == "b7" and envelope.source_topic == "transport/bus/b7/location" and "�" in envelope.original_payload
    assert validate.decode_gps(rows, "payload").first().decode_error == "JSON_PARSE"


def test_month_partitions_are_pruned(spark, folder):
    df = spark.range(40).select(*[F.lit("x").alias(c) for c in ("trip_id", "route_id")], F.lit(1).alias("stop_id"),
                                F.expr("timestamp'2026-01-20' + make_interval(0,0,0,cast(id as int))").alias("timestamp")).withColumn(
        "recorded_at", F.col("timestamp"))
    writers.write_eta_records(df, f"{folder}/records")
    stored = spark.read.parquet(f"{folder}/records")
    part = stored.filter(readers.between_months("recorded_month", F.lit("2026-02-01").cast("timestamp"), F.lit("2026-02-10").cast("timestamp")))
    assert stored.count() == 40 and part.count() == 28
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(recorded_month" in plan


def test_snapshot_versions_survive_a_retry(spark, folder):
    sink = writers.snapshot_sink(f"{folder}/snap", "bus_id", "t")
    schema = T.StructType([T.StructField("bus_id", T.StringType()), T.StructField("t", T.LongType())])
    sink(spark.createDataFrame([("a", 1), ("b", 5)], schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame([("a", 3), ("b", 2)], schema), 1)
    assert rows_of(spark.read.parquet(writers.latest_version(spark, f"{folder}/snap"))) == [("a", 3), ("b", 5)]


def test_audiences_and_alert_rows(spark, folder):
    readings = spark.createDataFrame([("b", k, "T", "R", 6.9, 80.0, 1_777_716_000_000) for k in ("STATIONARY", "OFF_ROUTE", "NEW_KIND")],
                                     "bus_id string, kind string, trip_id string, route_id string, lat double, lon double, t long")
    alerts = detect.alert(readings, F.col("kind"), F.lit("m"), F.lit('{"dlqCount":3,"features":{"average_speed":1.5}}'), "origin")
    assert alerts.columns == detect.ALERT_COLUMNS
    writers.write_audiences(alerts, f"{folder}/out")
    got = rows_of(spark.read.parquet(f"{folder}/out").groupBy("anomaly_type").agg(F.count("*")))
    assert got == [("NEW_KIND", 1), ("OFF_ROUTE", 2), ("STATIONARY", 3)]
    row = writers.alert_rows(alerts).filter("anomaly_type = 'OFF_ROUTE'").first()
    assert (row.lat, row.lon, row.model_version, row.source, str(row.date)) == (6.9, 80.0, "rules-v1", "origin", "2026-05-02")
    assert json.loads(row.payload) == {
        "busId": "b", "anomalyType": "OFF_ROUTE", "severity": "HIGH", "message": "m", "tripId": "T", "routeId": "R",
        "location": {"lat": 6.9, "lon": 80.0}, "timestamp": "2026-05-02T10:00:00.000Z", "modelVersion": "rules-v1", "source": "origin",
        "dlqCount": 3, "features": {"average_speed": 1.5}}
    plain = detect.alert(readings, F.col("kind"), F.lit("m"))
    assert "source" not in json.loads(plain.select(detect.alert_message(plain).alias("p")).first().p)


# --- models ------------------------------------------------------------------------------------

def test_forest_ranks_erratic_windows_higher(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(3000)
    rare = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(20)) == 0
    data = rows.select(F.monotonically_increasing_id().alias("id"), rare.alias("erratic"), *[
        (F.when(rare, 6.0).otherwise(1.0) * (F.col("l_quantity").cast("double") + n) / 10).alias(c) for n, c in enumerate(C.BEHAVIOURAL_FEATURES)]).persist()
    trees = forest.grow_forest(data, C.BEHAVIOURAL_FEATURES, ["id"], trees=60)
    judged = forest.verdict(forest.score(data, trees, C.BEHAVIOURAL_FEATURES)).persist()
    hit = judged.filter("erratic and forest_anomaly").count() / judged.filter("erratic").count()
    assert hit > 0.6 and abs(judged.filter("forest_anomaly").count() / 3000 - 0.05) < 0.01


def test_seasonal_model_learns_a_daily_pattern(spark):
    rng = random.Random(2)
    rows = [("R", 1, h * 3_600_000, 300 + 100 * math.sin(h % 24 / 24 * 2 * math.pi) + rng.gauss(0, 2)) for h in range(240)]
    rows += [("R", 2, h * 3_600_000, 300.0) for h in range(20)]
    models = seasonal.fit(spark.createDataFrame(rows, "route_id string, stop_id int, hour_ms long, eta_seconds double"))
    one = models.collect()
    assert len(one) == 1 and one[0].hold_out == 24 and one[0].rmse < 15
    ask = spark.createDataFrame([("R", 1), ("R", 2)], "route_id string, stop_id int")
    got = {r.stop_id: r.seasonal_eta for r in seasonal.lookup(ask, models).collect()}
    assert got[2] is None and got[1] > 0


def test_hotspots_join_neighbouring_cells(spark):
    rows = [(6.9 + i * 0.0005 + 0.0001, 80.0001, 0.0) for i in range(6) for _ in range(10)] + [(7.5, 80.5, 0.0)] * 30 + [(7.9, 80.9, 9.0)] * 50
    cells = hotspots.dense_cells(spark.createDataFrame(rows, "lat double, lon double, speed double"))
    found = hotspots.clusters(cells)
    assert rows_of(found.select("points", "cells")) == [(30, 1), (60, 6)]
    asked = spark.createDataFrame([(1, 7.5, 80.5), (2, 7.0, 80.5)], "id int, lat double, lon double")
    got = {r.id: r.threshold_ms for r in hotspots.stationary_threshold_ms(asked, found, ["id"]).collect()}
    assert got == {1: 900_000, 2: 300_000}


def test_hotspot_rounds_keep_a_known_size(spark):
    # one winding cluster: it takes several rounds, and the planner's size of a round must not square with each
    cells = spark.range(200).select(F.expr("id div 20 * 2").alias("cy"), F.expr("IF(id div 20 % 2 = 0, id % 20, 19 - id % 20)").alias("cx"))
    turns = spark.range(9).select(F.expr("id * 2 + 1").alias("cy"), F.expr("IF(id % 2 = 0, 19, 0)").cast("long").alias("cx"))
    found = hotspots.clusters(cells.unionByName(turns).withColumns({"n": F.lit(10), "lat_sum": F.lit(1.0), "lon_sum": F.lit(1.0)}))
    assert rows_of(found.select("points", "cells")) == [(2090, 209)]
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 40


def test_eta_model_beats_nothing_and_respects_gate(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").limit(1500)
    data = rows.select(
        (F.col("l_extendedprice").cast("double") / 10).alias("distance_m"), (F.col("l_quantity").cast("double") / 4 + 1.4).alias("speed_ms"),
        (F.col("l_orderkey") % 24).cast("double").alias("hour_of_day"), (F.col("l_orderkey") % 7).cast("double").alias("day_of_week"),
        (F.col("l_orderkey") % 7 >= 5).cast("double").alias("is_weekend"), F.col("l_linenumber").cast("double").alias("stops_remaining"))
    data = data.withColumn("physics_eta", F.col("distance_m") / F.col("speed_ms")).withColumn(
        "eta_seconds", F.col("physics_eta") * F.when(F.col("hour_of_day").between(7, 9), 1.25).otherwise(1.0)).withColumn(
        "id", F.monotonically_increasing_id()).persist()
    fit_on, test_on = train.split_by_hash(data, ["id"])
    model = train.train_eta_model(fit_on, trees=8, depth=4)
    scored = train.score_eta(model, test_on)
    errors = train.error_metrics(scored, "eta_seconds", "tree_eta").first()
    plain = test_on.agg(F.stddev("eta_seconds")).first()[0]
    assert errors.rmse < plain * 0.6
    assert abs(train.regression_metrics(scored)["rmse"] - errors.rmse) < 1e-6
    assert train.promotable(train.error_metrics(scored, "eta_seconds", "eta_seconds")).count() == 1
    path = tempfile.mkdtemp(prefix="busline-model-", dir="/tmp")
    model.write().overwrite().save(path)
    assert train.load_model(path) is not None and train.load_model(path + "-none") is None


def test_crowd_model(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(800)
    route = F.element_at(F.array(*[F.lit(r) for r in (101, 102, 138, 177, 255)]), (F.col("user_id") % 5 + 1).cast("int"))
    made = events.select(
        F.concat(F.lit("T"), "event_id").alias("trip_id"), route.alias("route_id"), (F.col("event_id") % 2).cast("int").alias("direction_id"),
        (F.col("event_id") % 10 + 1).cast("int").alias("stop_sequence"), (F.lit(1_777_716_000_000) - F.col("event_id") * 3_600_000).alias("t"),
        F.col("user_id").cast("string").alias("passenger_id"))
    made = made.withColumn("stop_id", F.col("route_id") * 10 + F.col("stop_sequence")).withColumn(
        "score", F.least(F.lit(100), F.col("stop_sequence") * 10).cast("int")).withColumn("occupancy_label", scalars.occupancy_label(F.col("score")))
    reports = crowd.crowd_features(made).persist()
    assert train.train_crowd_model(reports.limit(10)) is None
    model = train.train_crowd_model(reports, trees=20)
    ask = spark.createDataFrame([(1, 101, 0, 1015, 1_777_716_000_000)], "request_id int, route_id int, direction_id int, stop_id int, t long")
    assert train.historical_score(model, ask).first().historical in (20, 55, 90)
    assert train.historical_score(None, ask).first().historical in (20, 55)
    scored = model.transform(reports.withColumn("label", F.col("label").cast("string")))
    ours, theirs = train.classification_metrics(scored, "label_index", "prediction").first(), train.classifier_metrics(scored)
    assert abs(ours.accuracy - theirs["accuracy"]) < 1e-9 and abs(ours.weighted_f1 - theirs["weighted_f1"]) < 1e-9


def test_insufficient_data_is_explained(spark):
    few = spark.createDataFrame([(0, 1, 1)], "t long, route_id int, stop_id int")
    out = train.sufficiency(few, few, 86_400_000).first()
    assert not out.sufficient and out.reasons == "history_days 1.0 < 7.0; eta_records 1 < 500"


def test_enriched_progress_stays_in_range(spark):
    shapes = geo.route_segments(line(spark, [(6, 80), (6.5, 80.2), (7, 80)]))
    links = spark.createDataFrame([("R", 1, 1), ("R", 2, 2)], "route_id string, stop_id int, stop_order int")
    stops = spark.createDataFrame([(1, "A", 6.2, 80.08), (2, "B", 6.8, 80.08)], "stop_id int, stop_name string, lat double, lon double")
    rng = random.Random(1)
    rows = [("b", i, "T", "R" if i % 4 else None, rng.uniform(5.9, 7.2), rng.uniform(79.8, 80.4), 10.0, 0.0) for i in range(60)]
    df = spark.createDataFrame(rows, "bus_id string, t long, trip_id string, route_id string, lat double, lon double, speed double, heading double")
    out = enrich.enrich(df, shapes, enrich.stops_along(links, stops, shapes), geo.route_cells(shapes)).withColumn("trip_status", F.lit("x"))
    for r in enrich.cleaned_message(out).collect():
        assert 0 <= r.routeProgressPct <= 100 and r.onRoute == (not r.offRoute) and len(r.stopsAhead) == r.stopsRemaining
        assert r.routeId is not None or (not r.offRoute and r.offRouteDistanceM == 0)
        assert (r.nextStopId is None) == (r.stopsRemaining == 0)


#: Speeds whose mean is 1.4 on paper: added oldest first it is not below 1.4, newest first it is, and the other way round.
TIED_SPEEDS = {"A": [2.2901, 1.4694, 0.4405], "B": [1.7389, 0.7364, 1.7247]}


def test_speeds_are_added_newest_first_as_in_the_sql(spark):
    import duckdb

    from busline.plans import estimates
    rows = [(trip, 1000 * i, v) for trip, speeds in TIED_SPEEDS.items() for i, v in enumerate(speeds)]
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE ranked (trip_id VARCHAR, t BIGINT, speed_ms DOUBLE, rn BIGINT, end_t BIGINT)")
    con.executemany("INSERT INTO ranked VALUES (?, ?, ?, ?, NULL)", [(*r, r[1] // 1000 + 1) for r in rows])
    want = sorted(con.execute(f"SELECT trip_id, t, total / n FROM ({estimates._FEATURES['smoothed']})").fetchall())
    df = spark.createDataFrame(rows, "trip_id string, t long, speed_ms double")
    for width in (1 << 60, 120_000):
        assert sorted(tuple(r) for r in eta.smooth_speed(df, width=width).select("trip_id", "t", "smoothed_ms").collect()) == want
    slow = {trip: v < 1.4 for trip, t, v in want if t == 2000}
    assert slow == {"A": True, "B": False}


def test_trust_is_added_newest_first(spark):
    """Blends of 40 on paper: added oldest first the first one is SEMI_FULL and the second NOT_FULL, newest first the other way round."""
    said = {1: [(19, 1), (51, 10), (66, 2), (19, 1), (17, 0)], 2: [(48, 0), (62, 1), (70, 2), (33, 2), (36, 2)]}
    reports = spark.createDataFrame([(place, 7, f"p{trust}", float(score), 1000 * i) for place, rows in said.items()
                                     for i, (score, trust) in enumerate(rows)], "route_id long, stop_id long, passenger_id string, score double, t long")
    profiles = spark.createDataFrame([(f"p{trust}", trust / 100) for trust in range(11)], "passenger_id string, trust_score double")
    asked = spark.createDataFrame([(place, place, 7, 9000) for place in said], "request_id long, route_id long, stop_id long, t long")
    out = crowd.hybrid_prediction(crowd.live_occupancy(asked, reports, profiles), F.lit(20)).collect()
    assert {r.request_id: r.prediction for r in out} == {1: "NOT_FULL", 2: "SEMI_FULL"}
    assert all(abs(r.final_score - 40) < 1e-9 for r in out)


def test_trees_are_trained_on_as_many_rows_as_their_cuts_tell_apart(spark, monkeypatch):
    """Ten times the records are the same merged rows with ten times the weight; a record and its merged row reach the same leaves."""
    mix = lambda n, k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    rows = spark.range(4000).select("id", (mix(100_000, 1) / 7.0).alias("distance_m"), (1.5 + mix(20, 2) / 4.0).alias("speed_ms"), mix(24, 3).cast("double").alias("hour_of_day"),
                                    F.lit(1.0).alias("day_of_week"), F.when(F.col("id") % 5 > 0, 0.0).alias("is_weekend"), F.lit(1.0).alias("stops_remaining"))
    rows = rows.withColumn("physics_eta", F.col("distance_m") / F.col("speed_ms")).withColumn("eta_seconds", F.col("physics_eta") + F.col("hour_of_day") * 10).persist()
    values = train.standing_values(rows, C.ETA_FEATURES)
    assert values["hour_of_day"] == [float(h) for h in range(24)] and len(values["distance_m"]) == 32 and values["day_of_week"] == [1.0]
    once = train.merged(rows, C.ETA_FEATURES, "eta_seconds").collect()
    tenfold = train.merged(rows.crossJoin(spark.range(10).toDF("copy")), C.ETA_FEATURES, "eta_seconds").collect()
    assert len(once) < 4000 and sum(r.weight for r in once) == 4000
    cells = lambda found: {tuple(r[c] for c in C.ETA_FEATURES): r for r in found}
    first, second = cells(once), cells(tenfold)
    assert first.keys() == second.keys() and all(second[k].weight == 10 * r.weight and abs(second[k].eta_seconds - r.eta_seconds) < 1e-6 for k, r in first.items())
    sizes, fit = [], train.Pipeline.fit
    monkeypatch.setattr(train.Pipeline, "fit", lambda self, df: sizes.append(df.count()) or fit(self, df))
    model = train.train_eta_model(rows.crossJoin(spark.range(3).toDF("copy")), trees=5, depth=4)
    assert sizes == [len(once)]
    told = train.score_eta(model, rows).select("id", F.col("tree_eta").alias("of_row"))
    near = rows.select("id", *[train.snapped(F.col(c), values[c]).alias(c) for c in C.ETA_FEATURES])
    both = train.score_eta(model, near).join(told, "id")
    assert both.count() == 4000 and both.filter("tree_eta <> of_row").count() == 0


def test_forest_draws_are_compiled_and_scores_are_those_of_the_trees(spark):
    import numpy as np
    df = spark.range(3000).select(F.col("id").alias("k"), (F.xxhash64("id") % 100 / 7.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 10 / 3.0).alias("b"))
    grown = forest.grow_forest(df, ["a", "b"], ["k"], trees=20)
    assert "lambda" not in grown._jdf.queryExecution().executedPlan().toString()
    packed, data = forest.Packed(grown), np.random.default_rng(2).uniform(-15, 15, (200, 2))

    def depth(tree, point):
        at = 0
        while tree.feature[at] >= 0:
            at = (tree.left if point[tree.feature[at]] < tree.cut[at] else tree.right)[at]
        return tree.depth[at]

    rows = grown.orderBy("tree").collect()
    want = [2.0 ** (-(sum(depth(t, p) for t in rows) / len(rows)) / packed.scale) for p in data]
    assert np.allclose(packed.rate(data), want, rtol=1e-12)
