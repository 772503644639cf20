"""Each stream processor must give the rows of its batch operator on the same input."""

import datetime
import json
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import geo
from busline.operators import context, crowd, detect, dwell, enrich, eta, forest, train, trees, validate
from busline.sinks import writers
from busline.sources import readers
from busline.streaming import jobs
from busline.streaming import processors as P

T0 = 1_777_716_000_000
#: A width that puts all rows of a key in one chunk.
WHOLE = 1 << 60


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="busline-stream-", dir="/tmp")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(spark, stream, folder, name):
    query = (stream.writeStream.format("parquet").option("path", f"{folder}/{name}-out")
             .option("checkpointLocation", f"{folder}/{name}-cp").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/{name}-out")


def as_stream(spark, df, folder, name, order, files=3):
    """Rows as JSON files in order, read one file per trigger."""
    rows = df.orderBy(order).collect()
    size = (len(rows) + files - 1) // files
    import os
    import time
    for i in range(files):
        part = rows[i * size:(i + 1) * size]
        if part:
            spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").json(f"{folder}/{name}")
            newest = max((os.path.join(f"{folder}/{name}", f) for f in os.listdir(f"{folder}/{name}") if f.endswith(".json")),
                         key=os.path.getmtime)
            os.utime(newest, (time.time() - 1000 + i * 10,) * 2)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(f"{folder}/{name}")


@pytest.fixture(scope="module")
def readings(spark):
    rng = random.Random(3)
    rows = []
    for bus in ("a", "b"):
        t = T0
        for i in range(60):
            t += rng.choice([0, 500, 1000, 2000, 3000, -4000, 200_000])
            rows.append((bus, 10 * i + 1, t, None if i % 5 else f"T{bus}-0", None, 6.5 + 0.001 * i, 80.0,
                         float(rng.randint(0, 90)), float(rng.randint(0, 359)), rng.random() < 0.6))
    return spark.createDataFrame(rows, "bus_id string, arrival long, t long, payload_trip string, payload_route string, "
                                       "lat double, lon double, speed double, heading double, off_route boolean")


@pytest.fixture(scope="module")
def lifecycle(spark):
    rows = []
    for bus in ("a", "b"):
        for i, event in enumerate(["TRIP_STARTED", "INCIDENT_REPORTED", "TRIP_ENDED", "TRIP_STARTED", "TRIP_ENDED", "TRIP_STARTED"]):
            rows.append((bus, 10 * (8 * i + 4), event, f"T{bus}-{i % 2}", "R1", T0 + i * 30_000))
    return spark.createDataFrame(rows, "bus_id string, arrival long, event string, trip_id string, route_id string, t long")


def test_trip_context(spark, folder, readings, lifecycle):
    boot = spark.createDataFrame([("b", "T-boot", "R9")], "bus_id string, boot_trip string, boot_route string")
    batch = context.attach_trips(readings, lifecycle, boot, width=WHOLE)
    chunked = context.attach_trips(readings, lifecycle, boot, width=70)
    both = readings.withColumns({"event": F.lit(None).cast("string"), "trip_id": F.lit(None).cast("string"),
                                 "route_id": F.lit(None).cast("string")}).unionByName(lifecycle, allowMissingColumns=True)
    stream = as_stream(spark, both, folder, "ctx", "arrival")
    live = jobs.in_context(stream.filter("event is null"), stream.filter("event is not null"), boot)
    cols = ["bus_id", "arrival", "t", "trip_id", "route_id", "trip_status"]
    got = rows_of(run(spark, live, folder, "ctx").select(*cols))
    assert got == rows_of(batch.select(*cols))
    assert got == rows_of(chunked.select(*cols))
    kept = {}
    for r in batch.orderBy("arrival").collect():
        assert r.t > kept.get(r.bus_id, -1)
        kept[r.bus_id] = r.t


def test_ingest_rules(spark, folder, readings):
    again = readings.filter("arrival % 3 = 0").withColumn("arrival", F.col("arrival") + 5)
    rows = readings.unionByName(again).withColumn("trip_id", F.coalesce("payload_trip", F.lit("none")))
    batch = validate.stateful_ingest(rows, width=WHOLE).select("bus_id", "arrival", "verdict")
    chunked = validate.stateful_ingest(rows, width=70).select("bus_id", "arrival", "verdict")
    live = jobs.ingest_verdicts(as_stream(spark, rows, folder, "ingest", "arrival"))
    got = rows_of(run(spark, live, folder, "ingest"))
    assert got == rows_of(batch) == rows_of(chunked)
    assert {r[2] for r in got} == {None, "DUPLICATE", "SEQUENCE_ERROR", "RATE_LIMIT_EVENT_TIME"}


def distinct_times(readings):
    kept = context.strictly_newer(readings, WHOLE)
    return kept.withColumns({"route_id": F.lit("R1"), "trip_id": F.concat(F.lit("T"), "bus_id"), "off_route_m": F.lit(60.0)})


def test_off_route_streak(spark, folder, readings):
    rows = distinct_times(readings)
    live = jobs.keyed(as_stream(spark, rows, folder, "streak", "t"), ["bus_id"], P.OffRouteStreak())
    got = rows_of(run(spark, live, folder, "streak").select("bus_id", "t"))
    assert got == rows_of(detect.off_route_streaks(rows, width=WHOLE).select("bus_id", "t"))
    assert got == rows_of(detect.off_route_streaks(rows, width=7_000).select("bus_id", "t"))
    assert got


def test_behaviour_window(spark, folder, readings):
    rows = distinct_times(readings)
    live = jobs.keyed(as_stream(spark, rows, folder, "beh", "t"), ["bus_id"], P.BehaviourWindow())
    rounded = [F.round(c, 6).alias(c) for c in C.BEHAVIOURAL_FEATURES]
    got = rows_of(run(spark, live, folder, "beh").select("bus_id", "t", *rounded))
    assert got == rows_of(detect.behaviour_windows(rows, width=WHOLE).select("bus_id", "t", *rounded))
    assert got == rows_of(detect.behaviour_windows(rows, width=30_000).select("bus_id", "t", *rounded))
    assert got


def test_smoothing(spark, folder, readings, lifecycle):
    rows = distinct_times(readings).withColumn("speed_ms", F.col("speed"))
    ends = rows.filter("arrival % 70 = 1").select("trip_id", "t")
    both = rows.select("trip_id", "t", "speed_ms", F.lit(False).alias("end")).unionByName(
        ends.select("trip_id", "t", F.lit(None).cast("double").alias("speed_ms"), F.lit(True).alias("end")))
    stream = as_stream(spark, both, folder, "smooth", "t", files=1)
    live = jobs.smoothed(stream.filter("not end"), stream.filter("end"))
    cols = ["trip_id", "t", F.round("smoothed_ms", 6), "smoothing_rows"]
    got = rows_of(run(spark, live, folder, "smooth").select(*cols))
    assert got == rows_of(eta.smooth_speed(rows, ends, width=WHOLE).select(*cols))
    assert got == rows_of(eta.smooth_speed(rows, ends, width=130_000).select(*cols))


def test_dwell(spark, folder, readings):
    visits = distinct_times(readings).select("bus_id", "trip_id", "t", F.concat(F.lit("S"), (F.floor(F.col("t") / 7000) % 3).cast("string")).alias("stop_id"))
    limits = C.Thresholds(dwell_ttl_ms=150_000)
    live = jobs.keyed(as_stream(spark, visits, folder, "dwell", "t"), ["bus_id", "trip_id"], P.DwellState(limits))
    cols = ["bus_id", "trip_id", "t", "stop_id", "dwell_current_s", "dwell_prev_s"]
    got = rows_of(run(spark, live, folder, "dwell").select(*cols))
    assert got == rows_of(dwell.dwell(visits, limits, width=WHOLE).select(*cols))
    assert got == rows_of(dwell.dwell(visits, limits, width=50_000).select(*cols))


def test_inactive_trip_burst(spark, folder, readings):
    rows = readings.withColumn("t", F.lit(T0) + F.col("arrival") * 997).withColumns({
        "error_type": F.lit("INACTIVE_TRIP"), "error_reason": F.lit(None).cast("string"), "trip_id": F.lit("x"), "route_id": F.lit("r")})
    live = jobs.keyed(as_stream(spark, rows, folder, "burst", "arrival"), ["bus_id"], P.InactiveTripBurst())
    got = rows_of(run(spark, live, folder, "burst"))
    for width in (WHOLE, 70_000):
        out = detect.trip_not_started(rows, width=width).select(
            "bus_id", "t", F.get_json_object("detail", "$.dlqCount").cast("long").alias("n"))
        assert rows_of(out) == got
    assert len(got) >= 2


def test_stationary(spark, folder):
    rng = random.Random(9)
    rows = []
    for i in range(90):
        moving = 45 <= i < 50
        rows.append(("s", T0 + i * 10_000, 6.9 + (0.01 * i if moving else 0.00001 * rng.randint(0, 5)), 80.0, "T", "R"))
    df = spark.createDataFrame(rows, "bus_id string, t long, lat double, lon double, trip_id string, route_id string")
    live = jobs.keyed(as_stream(spark, df, folder, "stat", "t"), ["bus_id"], P.StationaryWindow())
    got = rows_of(run(spark, live, folder, "stat"))
    assert got == rows_of(detect.stationary(df, width=WHOLE).select("bus_id", "t"))
    assert got == rows_of(detect.stationary(df, width=610_000).select("bus_id", "t"))
    assert got


def test_silence(spark, folder, readings):
    rows = distinct_times(readings).select("bus_id", "t", F.timestamp_millis("t").alias("event_time"))
    stream = as_stream(spark, rows, folder, "sil", "t").withWatermark("event_time", "5 seconds")
    got = {r[:2] for r in rows_of(run(spark, jobs.silence(stream), folder, "sil"))}
    full = distinct_times(readings)
    end = full.agg(F.max("t")).first()[0]
    want = {r for r in rows_of(detect.communication_loss(full, end, width=WHOLE).select("bus_id", "t"))}
    # the as-of rule also sees the silence that is still open when the input ends
    closed = {r for r in rows_of(detect.communication_loss(full, 0, width=50_000).select("bus_id", "t"))}
    assert closed <= got <= want | closed


def steady(number):
    """Rounded so that the last bit does not decide: halves go up by a clear margin."""
    return math.floor(float(number) * 1e4 + 0.500001) / 1e4


def alert_set(alerts):
    """Alerts as comparable rows: floats of the details rounded, keys in order."""
    def told(text):
        return None if text is None else json.dumps(json.loads(text, parse_float=steady, parse_int=float), sort_keys=True)

    return sorted(((*[r[c] for c in detect.ALERT_COLUMNS[:-1]], told(r.detail)) for r in alerts.collect()), key=str)


def test_detector_job_equals_all_detectors(spark, folder, readings):
    """Messages of both topics through the job: the history, topic and audiences hold the alerts of the batch detectors."""
    rng = random.Random(12)
    rows = distinct_times(readings).select("bus_id", "t", "lat", "lon", "speed", "heading", "off_route", "off_route_m", "trip_id", "route_id").collect()
    rows = [tuple(r) if n % 9 else (*tuple(r)[:8], None, None) for n, r in enumerate(rows)]
    for i in range(90):  # a bus that stands, moves on and stands again
        moving = 45 <= i < 50
        rows.append(("s", T0 + i * 10_000, 6.9 + (0.01 * i if moving else 0.00001 * rng.randint(0, 5)), 80.0, 130.0 if i == 47 else 3.0 + 0.25 * (i % 7), float(rng.randint(80, 100)), False, 0.0, "Ts", "R1"))
    schema = "bus_id string, t long, lat double, lon double, speed double, heading double, off_route boolean, off_route_m double, trip_id string, route_id string"
    table = spark.createDataFrame(rows, schema).persist()
    refused = spark.createDataFrame([("d", T0 + at * 1000, i, "INACTIVE_TRIP", None, "x", None, 6.5, 80.5) for i, at in enumerate([0, 20, 40, 40, 50, 350, 360, 361])],
                                    "bus_id string, t long, arrival long, error_type string, error_reason string, trip_id string, route_id string, lat double, lon double")
    at = F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    body = F.struct(F.col("bus_id").alias("busId"), F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId"), "lat", "lon", "speed", "heading",
                    at.alias("timestamp"), F.col("off_route").alias("offRoute"), F.col("off_route_m").alias("offRouteDistanceM"))
    sent = table.select(F.col("bus_id").alias("key"), F.to_json(body).alias("value"), F.col("t").alias("arrival"), F.timestamp_millis("t").alias("received_at"))
    sent = sent.unionByName(spark.createDataFrame([("s", "no json", T0, None), ("s", "{}", T0, None)], sent.schema))
    payload = F.to_json(F.struct(F.col("bus_id").alias("busId"), F.col("trip_id").alias("tripId"), "lat", "lon"))
    envelope = F.to_json(F.struct("error_type", at.alias("received_at"), payload.alias("original_payload")))
    dlq = refused.select(F.col("bus_id").alias("key"), envelope.alias("value"), "arrival", F.timestamp_millis("t").alias("received_at"))
    as_stream(spark, sent, folder, readers.TOPICS["cleaned"][0], "arrival")
    as_stream(spark, dlq, folder, readers.TOPICS["dlq"][0], "arrival", files=2)
    trees = forest.grow_forest(detect.behaviour_windows(table.filter("route_id IS NOT NULL")), C.BEHAVIOURAL_FEATURES, ["bus_id", "t"], trees=20)
    packed = (forest.Packed(trees), 0.6)
    job = jobs.detector_job(readers.message_stream(spark, "cleaned", path=folder, max_files=1), readers.message_stream(spark, "dlq", path=folder, max_files=1),
                            f"{folder}/out", f"{folder}/cp", version="forest-v3", forest=packed)
    job.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/history")

    windows = detect.behaviour_windows(table)
    judged = forest.score(windows, trees, C.BEHAVIOURAL_FEATURES).withColumn("odd", F.col("forest_score") > 0.6)
    batch = detect.detect_all(table, 0, version="forest-v3")
    batch = batch.filter("anomaly_type <> 'ERRATIC_DRIVING'").unionByName(
        detect.erratic_driving(judged, F.col("odd")).unionByName(detect.trip_not_started(refused)).withColumn("model_version", F.lit("forest-v3")))
    # a silence that is open when the input ends is raised by its timer once the watermark has passed it
    last = table.filter("route_id IS NOT NULL").agg(F.max("t")).first()[0]
    open_ = detect.communication_loss(table, last, width=WHOLE).withColumn("model_version", F.lit("forest-v3"))
    want, open_ = alert_set(batch), alert_set(open_)
    told = got.select("bus_id", "anomaly_type", "severity", "message", "trip_id", "route_id", F.struct("lat", "lon").alias("location"), "t", "model_version", "source", "payload")
    shape = {"busId", "anomalyType", "severity", "message", "tripId", "routeId", "location", "timestamp", "modelVersion", "source"}

    def detail(text):
        rest = {k: v for k, v in json.loads(text, parse_float=steady, parse_int=float).items() if k not in shape}
        return json.dumps(rest, sort_keys=True) if rest else None

    seen = sorted(((*tuple(r)[:-1], detail(r.payload)) for r in told.collect()), key=str)
    assert [r for r in seen if r not in want] == [r for r in seen if r in open_ and r not in want]
    assert [r for r in want if r not in seen] == []
    assert len(seen) == len(set(map(str, seen))) and {r[1] for r in seen} == set(C.ADMIN_ALERTS)
    assert {json.loads(r[-1])["detectionMethod"] for r in seen if r[1] == "ERRATIC_DRIVING"} == {"isolation_forest", "rules_fallback"}

    topic = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/anomalies")
    assert rows_of(topic.select("value")) == rows_of(got.select("payload"))
    channels = spark.read.option("basePath", f"{folder}/out/audiences").parquet(f"{folder}/out/audiences")
    assert channels.filter(F.col("channel") == C.PASSENGER_CHANNEL).count() == sum(r[1] == "STATIONARY" for r in seen)
    # a batch that is tried again changes nothing
    alerts = detect.row_alerts(table)
    for _ in range(2):
        jobs.alert_sinks(f"{folder}/again")(alerts, 7)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/again/history").count() == alerts.count()


def test_eta_job_equals_batch_estimates(spark, folder, readings):
    """Feature messages through the job with a trained ensemble: records, snapshots and live events of the batch operators."""
    rng = random.Random(8)
    records = spark.createDataFrame([(rng.uniform(0, 4000), rng.uniform(1, 20), rng.randint(0, 6), T0 + 977_000 * i, rng.uniform(10, 900)) for i in range(400)],
                                    "distance_m double, speed_ms double, stops_remaining int, t long, eta_seconds double")
    model = train.train_eta_model(train.eta_features(records), trees=6, depth=4)
    model.write().overwrite().save(f"{folder}/model")
    flat = trees.Flat(trees.stored_nodes(spark, f"{folder}/model"))
    scored = train.score_eta(model, train.eta_features(records))
    again = scored.withColumn("flat", flat.column(*[F.col(c) for c in C.ETA_FEATURES]))
    assert again.filter(F.abs(F.col("flat") - F.col("tree_eta")) > 1e-9).count() == 0 and again.count() == 400

    stops = F.array(F.struct(F.lit(7).alias("stopId"), F.lit("S7").alias("stopName"), F.lit(1).alias("stopOrder"), F.lit(9.5).alias("distanceAlongRouteMeters")))
    rows = distinct_times(readings).withColumns({
        "next_stop_id": F.when(F.col("arrival") % 9 != 0, F.lit(7)), "next_stop_m": F.col("speed") * (F.col("arrival") % 37) * 20, "stops_remaining": F.lit(1), "progress_pct": F.lit(12.5),
        "segment_mode": F.when(F.col("arrival") % 4 == 0, "expressway").otherwise("urban"), "stops_ahead": stops, "route_id": F.when(F.col("bus_id") == "a", "1").otherwise("2")}).persist()
    ends = rows.filter("arrival % 70 = 1").select("trip_id", "t")
    body = F.struct(F.col("bus_id").alias("busId"), F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId"), F.col("t").alias("timestampMs"),
                    F.lit("2026-05-02T10:00:00Z").alias("timestamp"), "speed", F.col("next_stop_id").alias("nextStopId"), F.col("next_stop_m").alias("distanceToNextStop"),
                    F.col("stops_remaining").alias("stopsRemaining"), F.col("stops_ahead").alias("stopsAhead"), F.col("progress_pct").alias("routeProgressPct"),
                    F.col("segment_mode").alias("segmentMode"), F.col("off_route").alias("offRoute"))
    sent = rows.select(F.col("bus_id").alias("key"), F.to_json(body, {"ignoreNullFields": "false"}).alias("value"), (F.col("t") * 2 + 1).alias("arrival"), F.timestamp_millis("t").alias("received_at"))
    # a trip end without a time counts from its receipt; a message that lacks fields is left out
    ended = ends.select(F.lit(None).cast("string").alias("key"), F.to_json(F.struct(F.lit("TRIP_ENDED").alias("event"), F.col("trip_id").alias("tripId"))).alias("value"),
                        (F.col("t") * 2).alias("arrival"), F.timestamp_millis("t").alias("received_at"))
    bad = rows.limit(1).select(F.lit("x").alias("key"), F.lit('{"tripId":"Ta","speed":1,"timestampMs":5}').alias("value"), (F.col("t") * 2).alias("arrival"), F.timestamp_millis("t").alias("received_at"))
    as_stream(spark, sent.unionByName(ended).unionByName(bad), folder, readers.TOPICS["eta_features"][0], "arrival")
    seasonal = spark.createDataFrame([(1, 7, 321.0)], "route_id int, stop_id int, seasonal_eta double")
    stream = readers.message_stream(spark, "eta_features", path=folder, max_files=1)
    jobs.eta_job(stream, f"{folder}/out", f"{folder}/cp", flat, seasonal, version="v9").trigger(availableNow=True).start().awaitTermination()

    used = rows.filter("NOT off_route AND next_stop_id IS NOT NULL").withColumn("speed_ms", F.col("speed"))
    smooth = eta.smooth_speed(used.drop("speed"), ends).withColumns({"distance_m": F.col("next_stop_m"), "speed_ms": F.col("smoothed_ms")})
    batch = eta.estimated(smooth, flat, seasonal)

    def told(df, drop=()):
        columns = [F.round(c, 6).alias(c) if t == "double" else F.to_json(c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes if c not in drop]
        return rows_of(df.select(*columns))

    names = eta.eta_records(batch, F.lit(0), "v9").columns
    got = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/records").select(*names)
    assert told(got, ("recorded_at",)) == told(eta.eta_records(batch, F.lit(0), "v9"), ("recorded_at",))
    assert {r.model_used for r in got.select("model_used").distinct().collect()} == {"xgboost", "sarima", "physics"}
    snapshots = spark.read.parquet(writers.latest_version(spark, f"{folder}/out/snapshots"))
    want = eta.latest_snapshots(eta.snapshot(batch, "v9"))
    assert told(snapshots.select(*want.columns)) == told(want)
    live = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/live")
    fields = lambda df: rows_of(df.select("trip_id", "t", F.get_json_object("value", "$.stopName"), F.get_json_object("value", "$.model_used"), F.round(F.get_json_object("value", "$.eta_seconds").cast("double"), 6)))
    assert fields(live) == fields(eta.live_event(batch, "v9"))
    # a batch that is tried again changes nothing
    for _ in range(2):
        jobs.eta_sinks(f"{folder}/again", clock=lambda: 1_777_716_000.0)(batch, 3)
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/again/records").count() == batch.count()


def test_crowd_trust(spark, folder):
    rng = random.Random(4)
    rows = [(i, 1, rng.randint(1, 2), float(rng.randint(0, 100)), rng.choice(["p1", "p2", "p3", None]), T0 + 40_000 * i)
            for i in range(120)]
    df = spark.createDataFrame(rows, "arrival long, route_id int, stop_id int, score double, passenger_id string, t long")
    judged = jobs.keyed(as_stream(spark, df, folder, "con", "t"), ["route_id", "stop_id"], P.StopConsensus())
    table = run(spark, judged, folder, "con")
    for width in (WHOLE, 1_500_000):
        batch = crowd.consensus(df, width=width).select("passenger_id", "arrival", "score", "others", F.round("consensus", 9))
        assert rows_of(table.withColumn("consensus", F.round("consensus", 9))) == rows_of(batch)
    trust = jobs.keyed(as_stream(spark, table, folder, "trust", "arrival"), ["passenger_id"], P.TrustState())
    last = run(spark, trust, folder, "trust").groupBy("passenger_id").agg(
        F.max_by(F.struct("trust_score", "total_reports", "verified_reports"), "arrival").alias("s")).select("passenger_id", "s.*")
    assert rows_of(last) == rows_of(crowd.trust_profiles(table, width=10, span=3))
    assert all(0 <= r[1] <= 1 for r in rows_of(last))


def test_crowd_jobs_append_reports_and_upsert_profiles(spark, folder):
    """Messages of the report topic end as the rows and profiles that the batch operators give."""
    rng = random.Random(5)
    sent, good = [], []
    for i in range(60):
        row = {"trip_id": "T", "route_id": 1, "stop_id": rng.choice([1, 2, 9]), "occupancy_score": rng.choice([10, 50, 90, 200]),
               "passenger_id": rng.choice(["p1", "p2", "p3", None]), "timestamp": f"2026-05-02T10:{i:02d}:00Z"}
        sent.append((None, json.dumps(row), i, datetime.datetime(2026, 5, 2, 10, i)))
        if row["stop_id"] != 9 and row["occupancy_score"] <= 100:
            good.append((1, row["stop_id"], row["passenger_id"], i, T0 + 60_000 * i, float(row["occupancy_score"])))
    stream = as_stream(spark, spark.createDataFrame(sent, readers.FILE_SCHEMA), folder, readers.TOPICS["crowd_reports"][0], "arrival")
    routes = spark.createDataFrame([(1,)], "route_id int")
    links = spark.createDataFrame([(1, 1), (1, 2)], "route_id int, stop_id int")
    for job in jobs.crowd_jobs(stream, routes, links, f"{folder}/out", f"{folder}/cp"):
        job.trigger(availableNow=True).start().awaitTermination()
    batch = spark.createDataFrame(good, "route_id int, stop_id int, passenger_id string, arrival long, t long, score double")
    kept = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/reports").select("arrival", "stop_id", "score")
    assert rows_of(kept) == rows_of(batch.select("arrival", "stop_id", "score"))
    profiles = spark.read.parquet(writers.latest_version(spark, f"{folder}/out/profiles")).select(
        "passenger_id", "trust_score", "total_reports", "verified_reports")
    named = crowd.consensus(batch, width=1_500_000).select("passenger_id", "arrival", "score", "others", "consensus")
    assert rows_of(profiles) == rows_of(crowd.trust_profiles(named, width=10, span=3))


def test_cleaned_job_writes_every_sink(spark, folder):
    """Messages of both topics through the whole job; the snapshot and the cleaned rows must agree."""
    rows, events = [], []
    for i in range(20):
        rows.append(("1", f'{{"busId":"1","lat":{6.0 + 0.01 * i},"lon":80.0,"speed":{10 + i},"heading":0,"timestamp":"2026-05-02T10:00:{i:02d}Z"}}', 2 * i + 2, None))
    rows.append(("1", "{bad", 50, None))
    events.append(("1", '{"event":"TRIP_STARTED","busId":"1","tripId":"T1","routeId":"R1","timestamp":"2026-05-02T09:59:00Z"}', 1, None))
    for topic, data in (("telemetry", rows), ("lifecycle", events)):
        spark.createDataFrame(data, readers.FILE_SCHEMA).coalesce(1).write.json(f"{folder}/in/{readers.TOPICS[topic][0]}")
    points = spark.createDataFrame([("R1", 0, 6.0, 80.0), ("R1", 1, 7.0, 80.0)], "route_id string, seq int, lat double, lon double")
    shapes = geo.route_segments(points)
    links = spark.createDataFrame([("R1", 1, 1), ("R1", 2, 2)], "route_id string, stop_id int, stop_order int")
    stops = spark.createDataFrame([(1, "A", 6.0, 80.0), (2, "B", 7.0, 80.0)], "stop_id int, stop_name string, lat double, lon double")
    route_stops = enrich.stops_along(links, stops, shapes)
    messages = readers.message_stream(spark, "telemetry", path=f"{folder}/in")
    good, bad = validate.split(jobs.classified(messages))
    lifecycle = context.parse_lifecycle(readers.message_stream(spark, "lifecycle", path=f"{folder}/in"))
    loads = []

    def load():
        loads.append(1)
        return shapes

    job = jobs.cleaned_job(jobs.in_context(good, lifecycle), jobs.Refreshed(load), jobs.Refreshed(lambda: route_stops),
                           f"{folder}/out", f"{folder}/cp")
    job.trigger(availableNow=True).start().awaitTermination()
    invalid = writers.invalid_json(bad.select("value", "invalid_reason")).select("value")
    assert '"_invalid_reason":"MALFORMED_JSON"' in run(spark, invalid, folder, "bad").first()[0]
    sent = '{"tags":[1,2.5,"x"],"lat":99.5,"ok":true,"none":null,"deep":{"a":{"b":[]}},"_invalid_reason":"old"}'
    kept = writers.invalid_json(spark.createDataFrame([(sent, "GEO")], "value string, invalid_reason string")).first().value
    assert json.loads(kept) == {**json.loads(sent), "_invalid_reason": "GEO"}
    cleaned = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/cleaned")
    assert cleaned.count() == 20 and len(loads) == 1
    last = spark.read.parquet(writers.latest_version(spark, f"{folder}/out/positions")).first()
    assert (last.bus_id, last.trip_id, last.route_id) == ("1", "T1", "R1") and abs(last.progress_pct - 19) < 0.1
    history = spark.read.option("basePath", f"{folder}/out/history").parquet(f"{folder}/out/history")
    assert history.count() == 20 and "date" in history.columns
    live = spark.read.parquet(f"{folder}/out/live")
    assert {r.channel for r in live.select("channel").distinct().collect()} == {"telemetry:live"}


def test_refreshed_dimension_reloads_by_age():
    now, loads = [0.0], []
    table = jobs.Refreshed(lambda: loads.append(1) or len(loads), 300.0, lambda: now[0])
    assert table.get() == 1 and table.get() == 1
    now[0] = 300.0
    assert table.get() == 2


def test_arrival_orders_topics_of_independent_offsets(spark):
    schema = "key string, value string, offset long, timestamp timestamp"
    at = lambda s: datetime.datetime(2026, 5, 2, 10, 0, s)
    events = spark.createDataFrame([("1", "start", 0, at(0)), ("1", "end", 1, at(20))], schema)
    readings = spark.createDataFrame([("1", "r1", 90_000, at(0)), ("1", "r2", 90_001, at(10)), ("1", "r3", 90_002, at(20)), ("1", "r4", 90_003, at(30))], schema)
    both = readers.from_broker(events, "lifecycle").unionByName(readers.from_broker(readings, "telemetry"))
    assert [r.value for r in both.orderBy("arrival").collect()] == ["start", "r1", "r2", "end", "r3", "r4"]


def test_kafka_options():
    options = readers.kafka_options("t", "host:1", "latest", 500)
    assert options["startingOffsets"] == "latest" and options["maxOffsetsPerTrigger"] == "500"
    assert readers.TOPICS["eta_features"][1] == "latest" and readers.TOPICS["telemetry"][1] == "earliest"


def test_smoothing_adds_speeds_as_the_batch_form(spark, folder):
    rows = spark.createDataFrame([(trip, 1000 * i, v) for trip, speeds in (("A", [2.2901, 1.4694, 0.4405]), ("B", [1.7389, 0.7364, 1.7247]))
                                  for i, v in enumerate(speeds)], "trip_id string, t long, speed_ms double")
    stream = as_stream(spark, rows.withColumn("end", F.lit(False)), folder, "tied", "t", files=1)
    live = jobs.smoothed(stream.filter("not end"), stream.filter("end"))
    assert rows_of(run(spark, live, folder, "tied").select("trip_id", "t", "smoothed_ms")) == rows_of(
        eta.smooth_speed(rows, width=WHOLE).select("trip_id", "t", "smoothed_ms"))
