"""Queries over arrival estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked, eta, trees
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import AS_OF_MS, BASE_MS, oracle, view
from busline.sources import messages


def _sql(select: str, _views: tuple[str, ...] = (), **extra: str) -> str:
    return oracle(select, *S.ENRICHED_VIEWS, *_views, extra=S.parts(S.ENRICHED_PARTS, **extra))


# one reading per trip and instant: a bus has one clock, but a payload may name any trip
_FEATURES = {
    "kept": """SELECT bus_id, trip_id, route_id, t, speed AS speed_ms, next_stop_id, next_stop_m, stops_remaining,
        progress_pct, segment_mode, off_route FROM enriched WHERE NOT off_route AND next_stop_id IS NOT NULL
          AND trip_id IS NOT NULL""",
    "ends": "SELECT trip_id, t FROM lifecycle WHERE event = 'TRIP_ENDED'",
    "ended": """SELECT k.*, (SELECT max(e.t) FROM ends e WHERE e.trip_id = k.trip_id AND e.t <= k.t) AS end_t FROM kept k""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY trip_id ORDER BY t) AS rn FROM ended",
    "smoothed": """SELECT a.trip_id, a.t, sum(b.speed_ms) AS total, count(*) AS n FROM ranked a JOIN ranked b
        ON b.trip_id = a.trip_id AND b.rn BETWEEN a.rn - 9 AND a.rn AND b.t >= a.t - 120000
        AND (a.end_t IS NULL OR b.t >= a.end_t) GROUP BY ALL""",
    "feats": "SELECT k.*, s.total / s.n AS v, s.n FROM kept k JOIN smoothed s USING (trip_id, t)",
}


def features(spark, sf):
    """On-route readings with a stop ahead, their speed smoothed per trip."""
    rows = S.enriched(spark, sf).filter(eta.skip_reason(
        F.lit(None).cast("string"), F.col("off_route"), F.col("next_stop_id"), F.col("trip_id")).isNull())
    rows = rows.select("bus_id", "trip_id", "route_id", "t",
                       eta.speed_ms(F.col("speed")).alias("speed_ms"), "next_stop_id", "next_stop_m", "stops_remaining",
                       "progress_pct", "segment_mode", "stops_ahead")
    ends = view(spark, sf, "lifecycle").filter("event = 'TRIP_ENDED'").select("trip_id", "t")
    return eta.smooth_speed(rows, ends, width=chunked.HOUR_MS)


@query("smoothed_speed", _sql(f"""SELECT trip_id, t, floor(v * 10000 + 0.500001d) / 10000 AS smoothed_ms, CAST(n AS BIGINT) AS smoothing_rows FROM feats""",
                              **_FEATURES))
def smoothed_speed(spark, sf):
    return features(spark, sf).select("trip_id", "t", S.steady("smoothed_ms", 4).alias("smoothed_ms"),
                                      F.col("smoothing_rows").cast("long").alias("smoothing_rows"))


@query("skip_reasons", _sql("""SELECT arrival, CASE WHEN off_route THEN 'off_route' WHEN next_stop_id IS NULL THEN 'NO_NEXT_STOP'
    WHEN trip_id IS NULL THEN 'NO_TRIP' END AS reason
  FROM enriched"""))
def skip_reasons(spark, sf):
    return S.enriched(spark, sf).select("arrival", eta.skip_reason(
        F.lit(None).cast("string"), F.col("off_route"), F.col("next_stop_id"), F.col("trip_id")).alias("reason"))


@query("required_fields", """
SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'Missing ETA feature fields: tripId, speed'
  WHEN event_id % 3 = 0 THEN 'Missing ETA feature fields: tripId' WHEN event_id % 5 = 0 THEN 'Missing ETA feature fields: speed' END AS reason
FROM events""")
def required_fields(spark, sf):
    rows = view(spark, sf, "ev")
    filled = {n: F.lit("x") for n in ("busId", "routeId", "nextStopId", "distanceToNextStop", "stopsRemaining", "stopsAhead",
                                      "routeProgressPct", "timestamp")}
    filled["tripId"] = F.when(F.col("event_id") % 3 != 0, "x")
    filled["speed"] = F.when(F.col("event_id") % 5 != 0, "x")
    return rows.withColumns(filled).select("event_id", eta.missing_fields().alias("reason"))


@query("physics_eta", """
SELECT event_id, round(greatest(d, 0) / greatest(v, 1.4e0), 6) AS eta_seconds, v < 1.4e0 AS clamped,
  round(greatest(d, 0) / greatest(v, 1.4e0) * greatest(w, 0.5e0), 6) AS expressway_seconds
FROM (SELECT event_id, value * 10 - 100 AS d, (event_id % 40) / 4e0 AS v, (event_id % 9) / 4e0 AS w FROM events)""")
def physics_eta(spark, sf):
    rows = view(spark, sf, "ev").select("event_id", (F.col("value") * 10 - 100).alias("d"),
                                        ((F.col("event_id") % 40) / 4.0).alias("v"), ((F.col("event_id") % 9) / 4.0).alias("w"))
    plain, fast = scalars.physics_eta(F.col("d"), F.col("v")), scalars.expressway_eta(F.col("d"), F.col("v"), F.col("w"))
    return rows.select("event_id", F.round(plain["eta_seconds"], 6).alias("eta_seconds"), plain["clamped"].alias("clamped"),
                       F.round(fast["eta_seconds"], 6).alias("expressway_seconds"))


@query("model_cascade", """
WITH r AS (SELECT event_id, value * 10 - 50 AS d, (event_id % 40) / 4e0 AS v,
   CASE WHEN event_id % 4 = 0 THEN NULL ELSE (value * 10 - 50) / 5 END AS tree,
   CASE WHEN event_id % 3 = 0 THEN NULL ELSE value - 20 END AS sea,
   CASE event_id % 6 WHEN 0 THEN 'physics' WHEN 1 THEN 'sarima' WHEN 5 THEN 'oracle' ELSE 'xgboost' END AS m,
   CASE WHEN event_id % 7 = 0 THEN 'expressway' ELSE 'urban' END AS seg FROM events),
 p AS (SELECT *, greatest(d, 0) AS dd, greatest(v, 1.4e0) AS vv, greatest(d, 0) / greatest(v, 1.4e0) AS phys FROM r WHERE m <> 'oracle'),
 q AS (SELECT *, dd = 0 OR tree IS NOT NULL AS usable, coalesce(dd > 0 AND abs(tree - phys) / phys > 0.8, false) AS wild FROM p),
 s AS (SELECT *, CASE WHEN dd = 0 THEN v < 1.4 WHEN wild THEN true ELSE v < 1.4 END AS tclamp,
   CASE WHEN dd = 0 THEN 0 WHEN wild THEN phys ELSE greatest(0, tree) END AS teta FROM q),
 u AS (SELECT *, CASE WHEN m = 'physics' THEN 'plain' WHEN m = 'sarima' AND sea IS NOT NULL THEN 'sea' WHEN m = 'sarima' AND usable THEN 'tree'
   WHEN m = 'sarima' THEN 'base' WHEN usable AND NOT tclamp THEN 'tree' WHEN sea IS NOT NULL THEN 'sea' ELSE 'last' END AS way FROM s)
SELECT event_id, round(CASE way WHEN 'tree' THEN teta WHEN 'sea' THEN greatest(0, sea) ELSE phys END, 6) AS eta_seconds,
  CASE way WHEN 'tree' THEN tclamp WHEN 'sea' THEN false ELSE v < 1.4 END AS clamped,
  CASE way WHEN 'tree' THEN CASE WHEN tclamp THEN 'physics' ELSE 'xgboost' END WHEN 'sea' THEN 'sarima' ELSE 'physics' END AS model_used,
  CASE way WHEN 'tree' THEN m = 'sarima' AND tclamp WHEN 'last' THEN true WHEN 'base' THEN true ELSE false END AS fallback
FROM u""")
def model_cascade(spark, sf):
    rows = view(spark, sf, "ev").select(
        "event_id", (F.col("value") * 10 - 50).alias("distance_m"), ((F.col("event_id") % 40) / 4.0).alias("speed_ms"),
        F.when(F.col("event_id") % 4 != 0, (F.col("value") * 10 - 50) / 5).alias("tree_eta"),
        F.when(F.col("event_id") % 3 != 0, F.col("value") - 20).alias("seasonal_eta"),
        F.expr("CASE event_id % 6 WHEN 0 THEN 'physics' WHEN 1 THEN 'sarima' WHEN 5 THEN 'oracle' ELSE 'xgboost' END").alias("model"),
        F.when(F.col("event_id") % 7 == 0, "expressway").otherwise("urban").alias("segment_mode"))
    return eta.cascade(rows, F.col("model")).select(
        "event_id", F.round("eta_seconds", 6).alias("eta_seconds"), "clamped", "model_used", "fallback")


def estimates(spark, sf):
    """Estimates without any trained model."""
    return eta.estimated(features(spark, sf).withColumns({"distance_m": F.col("next_stop_m"), "speed_ms": F.col("smoothed_ms")}))


_ESTIMATES = {**_FEATURES, "est": """SELECT *, next_stop_m / greatest(v, 1.4d) AS eta_seconds, v < 1.4d AS clamped FROM feats""",
              "snap": "SELECT trip_id, max(t) AS t FROM est GROUP BY 1",
              "snaps": "SELECT e.* FROM est e JOIN snap USING (trip_id, t)"}


@query("eta_stream_records", _sql("""SELECT trip_id, t, CAST(next_stop_id AS BIGINT) AS stop_id, floor(eta_seconds * 1000 + 0.500001d) / 1000 AS eta_seconds,
  clamped, 'physics' AS model_used FROM est""", **_ESTIMATES))
def eta_stream_records(spark, sf):
    """Records that the estimate loop appends, without any trained model."""
    out = eta.eta_records(estimates(spark, sf), F.lit(AS_OF_MS))
    return out.select("trip_id", F.unix_millis("timestamp").alias("t"), F.col("stop_id").cast("long").alias("stop_id"),
                      S.steady("eta_seconds", 3).alias("eta_seconds"), "clamped", "model_used")


# an ensemble of one tree per route: distance at its mean, then speed at its mean; a leaf holds the mean of its records
_CELL = "2 * CAST(distance_m > d AS INT) + CAST(speed_ms > v AS INT)"
_TREES = {
    "means": "SELECT route_id, avg(distance_m) AS d, avg(speed_ms) AS v, avg(eta_seconds) AS e FROM eta_records WHERE NOT off_route GROUP BY route_id",
    "leaves": f"""SELECT route_id, {_CELL} AS cell, avg(eta_seconds) AS e FROM eta_records JOIN means m USING (route_id)
        WHERE NOT off_route GROUP BY ALL""",
    "nodes": """SELECT CAST(route_id AS INT) AS tree, 0.2d AS weight, 0 AS node, 0 AS feature, d AS cut, 1 AS "left", 2 AS "right", e AS value FROM means
        UNION ALL SELECT route_id, 0.2d, 1 + side, 1, v, 3 + 2 * side, 4 + 2 * side, e FROM means, (SELECT unnest([0, 1]) AS side)
        UNION ALL SELECT route_id, 0.2d, 3 + cell, NULL, NULL, NULL, NULL, e FROM leaves""",
    "forecasts": """SELECT CAST(route_id AS STRING) AS route_id, stop_id, avg(eta_seconds) AS seasonal_eta FROM eta_records
        WHERE NOT off_route AND stop_id % 2 = 0 GROUP BY ALL""",
    "numbered": "SELECT *, row_number() OVER (ORDER BY trip_id, t) AS k, greatest(next_stop_m, 0) AS dd, greatest(v, 1.4d) AS vv FROM feats",
    "walk": """SELECT k, tree, node, feature, cut, "left", "right", weight * value AS value, dd, vv FROM numbered, (SELECT * FROM nodes WHERE node = 0)
        UNION ALL SELECT w.k, w.tree, n.node, n.feature, n.cut, n."left", n."right", n.weight * n.value, dd, vv FROM walk w
          JOIN nodes n ON n.tree = w.tree AND n.node = CASE WHEN CASE w.feature WHEN 0 THEN dd ELSE vv END <= w.cut THEN w."left" ELSE w."right" END
          WHERE w.feature IS NOT NULL""",
    "scores": "SELECT k, sum(value) AS tree_eta FROM walk WHERE feature IS NULL GROUP BY k",
    "judged": """SELECT f.*, s.tree_eta, c.seasonal_eta, dd / vv AS phys, v < 1.4d AS slow, dd > 0 AND abs(s.tree_eta - dd / vv) / (dd / vv) > 0.8d AS wild
        FROM numbered f JOIN scores s USING (k) LEFT JOIN forecasts c ON c.route_id = f.route_id AND c.stop_id = f.next_stop_id""",
    "chosen": "SELECT *, CASE WHEN NOT slow AND NOT wild THEN 'xgboost' WHEN seasonal_eta IS NOT NULL THEN 'sarima' ELSE 'physics' END AS model_used FROM judged",
}


def stored_trees(records: DataFrame) -> DataFrame:
    """Node table of the ensemble above."""
    kept = records.filter("NOT off_route")
    means = kept.groupBy("route_id").agg(F.avg("distance_m").alias("d"), F.avg("speed_ms").alias("v"), F.avg("eta_seconds").alias("e"))
    leaves = kept.join(means.drop("e"), "route_id").groupBy("route_id", F.expr(_CELL).alias("cell")).agg(F.avg("eta_seconds").alias("e"))

    def node(rows: DataFrame, *columns: str) -> DataFrame:
        names = [f.split()[0] for f in trees.NODES.split(", ")]
        kinds = [f.split()[1] for f in trees.NODES.split(", ")]
        return rows.select(*[F.expr(c).cast(k).alias(n) for c, n, k in zip(columns, names, kinds, strict=True)])

    sides = means.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    return (node(means, "route_id", "0.2D", "0", "0", "d", "1", "2", "e")
            .unionByName(node(sides, "route_id", "0.2D", "1 + side", "1", "v", "3 + 2 * side", "4 + 2 * side", "e"))
            .unionByName(node(leaves, "route_id", "0.2D", "3 + cell", "NULL", "NULL", "NULL", "NULL", "e")))


@query("eta_scored_records", _sql("""SELECT trip_id, bus_id, route_id, t, CAST(next_stop_id AS BIGINT) AS stop_id,
  floor(CASE model_used WHEN 'xgboost' THEN CASE WHEN dd = 0 THEN 0 ELSE greatest(0, tree_eta) END WHEN 'sarima' THEN greatest(0, seasonal_eta) ELSE phys END * 1000 + 0.500001d) / 1000 AS eta_seconds,
  floor(tree_eta * 1000 + 0.500001d) / 1000 AS tree_eta, floor(next_stop_m * 100 + 0.500001d) / 100 AS distance_m, model_used,
  CASE model_used WHEN 'physics' THEN slow ELSE false END AS clamped, model_used = 'physics' AS fallback, segment_mode FROM chosen""",
    **_FEATURES, **_TREES, _views=("eta_records",)).replace("WITH ", "WITH RECURSIVE ", 1))
def eta_scored_records(spark, sf):
    """Estimates with a stored tree ensemble and stored forecasts: every reading walks all trees."""
    records = view(spark, sf, "eta_records")
    forecasts = records.filter("NOT off_route AND stop_id % 2 = 0").groupBy("route_id", "stop_id").agg(F.avg("eta_seconds").alias("seasonal_eta"))
    rows = features(spark, sf).withColumns({"distance_m": F.col("next_stop_m"), "speed_ms": F.col("smoothed_ms")})
    out = eta.estimated(rows, trees.Flat(stored_trees(records)), S.materialised(forecasts))
    return out.select("trip_id", "bus_id", "route_id", "t", F.col("next_stop_id").cast("long").alias("stop_id"), S.steady("eta_seconds", 3).alias("eta_seconds"),
                      S.steady("tree_eta", 3).alias("tree_eta"), S.steady("distance_m", 2).alias("distance_m"), "model_used", "clamped", "fallback", "segment_mode")


@query("feature_messages", """SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'Missing ETA feature fields: tripId, speed'
  WHEN event_id % 3 = 0 THEN 'Missing ETA feature fields: tripId' WHEN event_id % 5 = 0 THEN 'Missing ETA feature fields: speed'
  WHEN event_id % 7 = 0 THEN 'stopsAhead must be a list' END AS reason, event_id % 13 = 0 AS ended FROM events""")
def feature_messages(spark, sf):
    """Messages of the feature topic that lack fields, hold nulls, or hold no list of stops."""
    rows = view(spark, sf, "ev")
    told = {n: F.lit('"x"') for n in C.ETA_REQUIRED_FIELDS}
    told["tripId"] = F.when(F.col("event_id") % 3 != 0, '"T"')
    told["speed"] = F.when(F.col("event_id") % 5 != 0, F.when(F.col("event_id") % 11 == 0, "null").otherwise("1.5"))
    told["stopsAhead"] = F.when(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 2 == 0, '"none"').otherwise('{"a":[1]}')).otherwise("[]")
    told["event"] = F.when(F.col("event_id") % 13 == 0, '"TRIP_ENDED"')
    pairs = F.array_compact(F.array(*[F.concat(F.lit(f'"{n}":'), v) for n, v in told.items()]))
    sent = rows.select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}")).alias("value"))
    read = messages.parse_features(sent)
    return read.select("event_id", F.col("feature_error").alias("reason"), F.coalesce(F.col("event") == "TRIP_ENDED", F.lit(False)).alias("ended"))


@query("eta_snapshots", _sql("""SELECT trip_id, t, t + 300000 AS expires_ms, next_stop_m, CAST(stops_remaining AS BIGINT) AS stops_remaining,
  floor(eta_seconds * 1000 + 0.500001d) / 1000 AS eta_seconds FROM snaps""", **_ESTIMATES))
def eta_snapshots(spark, sf):
    out = eta.latest_snapshots(eta.snapshot(estimates(spark, sf)))
    return out.select(F.col("tripId").alias("trip_id"), F.col("timestampMs").alias("t"), "expires_ms",
                      F.col("distanceToNextStop").alias("next_stop_m"), F.col("stopsRemaining").cast("long").alias("stops_remaining"),
                      S.steady("etaSeconds", 3).alias("eta_seconds"))


@query("eta_live_events", _sql("""SELECT e.trip_id, e.t, CAST(e.next_stop_id AS BIGINT) AS stop_id, s.stop_name, 'eta_update' AS event
  FROM est e JOIN stops s ON s.stop_id = e.next_stop_id""", **_ESTIMATES))
def eta_live_events(spark, sf):
    out = eta.live_event(estimates(spark, sf))
    pick = lambda n: F.get_json_object("value", f"$.{n}")
    return out.select("trip_id", "t", pick("stopId").cast("long").alias("stop_id"), pick("stopName").alias("stop_name"),
                      pick("event").alias("event"))


_NOW = BASE_MS + 400_000
_REQUESTS = """SELECT event_id AS request_id, CASE WHEN event_id % 6 = 5 THEN 'T-none' ELSE 'T' || user_id || '-' || (event_id % 2) END AS trip_id,
  event_id % 25 AS stop_id, CASE WHEN event_id % 10 = 0 THEN 'magic' WHEN event_id % 10 = 1 THEN 'physics' END AS model FROM ev"""


@query("eta_requests", oracle(f"""
SELECT r.request_id, CASE WHEN r.model = 'magic' THEN 'UNSUPPORTED_MODEL' WHEN s.trip_id IS NULL OR s.t + 300000 <= {_NOW} THEN 'NO_SNAPSHOT'
    WHEN a.stop_id IS NULL THEN 'STOP_NOT_FOUND' END AS reason,
  CASE WHEN coalesce(r.model, '') <> 'magic' AND s.t + 300000 > {_NOW} AND a.stop_id IS NOT NULL
    THEN floor(a.ahead_m / greatest(s.v, 1.4d) * 1000 + 0.500001d) / 1000 END AS eta_seconds
FROM reqs r LEFT JOIN snaps s ON s.trip_id = r.trip_id
LEFT JOIN ahead_t a ON a.trip_id = s.trip_id AND a.t = s.t AND a.stop_id = r.stop_id""", *S.ENRICHED_VIEWS, extra=S.parts(
    S.ENRICHED_PARTS, **_ESTIMATES, reqs=_REQUESTS,
    ahead_t="""SELECT c.trip_id, c.t, a.stop_id, arg_min(a.ahead_m, a.stop_order) AS ahead_m FROM ahead a
      JOIN (SELECT arrival, trip_id, t FROM ctx) c USING (arrival) GROUP BY ALL""")))
def eta_requests(spark, sf):
    """A batch of stop requests answered from the live snapshots."""
    live = eta.latest_snapshots(eta.snapshot(estimates(spark, sf)))
    ev = view(spark, sf, "ev")
    asked = ev.select(
        F.col("event_id").alias("request_id"),
        F.when(F.col("event_id") % 6 == 5, "T-none").otherwise(F.concat(
            F.lit("T"), F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 2).cast("string"))).alias("trip_id"),
        (F.col("event_id") % 25).alias("stop_id"),
        F.when(F.col("event_id") % 10 == 0, "magic").when(F.col("event_id") % 10 == 1, "physics").alias("model"),
        F.lit(_NOW).alias("as_of_ms"))
    return eta.answer_requests(asked, live).select("request_id", "reason", S.steady("eta_seconds", 3).alias("eta_seconds"))
