"""Queries over occupancy reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from busline.functions import scalars
from busline.operators import chunked, crowd, train
from busline.plans import shared as S
from busline.plans.registry import query
from busline.plans.views import BASE_MS, oracle, view

CROWD_CHUNK = 3 * chunked.HOUR_MS


@query("check_report_stop", oracle("""SELECT c.arrival, CASE WHEN r.route_id IS NULL THEN 'ROUTE_NOT_FOUND' WHEN l.stop_id IS NULL THEN 'STOP_NOT_ON_ROUTE' END
  AS error_reason FROM asked c LEFT JOIN routes r USING (route_id) LEFT JOIN links l ON l.route_id = c.route_id AND l.stop_id = c.stop_id""",
    "crowd_reports", "routes", "links", extra={
        "asked": "SELECT arrival, stop_id, CASE WHEN arrival % 10 = 0 THEN 9 ELSE route_id END AS route_id FROM crowd_reports"}))
def check_report_stop(spark, sf):
    asked = view(spark, sf, "crowd_reports").withColumn("route_id", F.when(F.col("arrival") % 10 == 0, 9).otherwise(F.col("route_id")))
    return crowd.check_stop(asked, view(spark, sf, "routes"), view(spark, sf, "links")).select("arrival", "error_reason")


@query("crowd_contract", """SELECT event_id, CASE WHEN value > 100 AND event_id % 3 = 0 THEN 'trip_id: length must be 1..64; occupancy_score: must be between 0 and 100'
  WHEN value > 100 THEN 'occupancy_score: must be between 0 and 100' WHEN event_id % 3 = 0 THEN 'trip_id: length must be 1..64' END AS error_reason FROM events""")
def crowd_contract(spark, sf):
    from busline.operators import validate
    rows = view(spark, sf, "ev").withColumns({
        "trip_id": F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), 65)).otherwise("T1"), "route_id": F.lit(1), "stop_id": F.lit(1),
        "occupancy_score": F.col("value"), "passenger_id": F.lit("p")})
    return validate.crowd_contract(rows).select("event_id", "error_reason")


@query("crowd_passengers", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'verified' WHEN event_id % 5 <> 0 THEN 'p' || user_id END AS passenger_id,
  CASE WHEN value > 100 THEN 'occupancy_score: must be between 0 and 100' END AS error_reason FROM events""")
def crowd_passengers(spark, sf):
    """Reports whose passenger the gateway has verified: its header, where it has one, replaces the report's own."""
    from busline.operators import validate
    rows = view(spark, sf, "ev").withColumns({
        "trip_id": F.lit("T1"), "route_id": F.lit(1), "stop_id": F.lit(1), "occupancy_score": F.col("value"),
        "passenger_id": F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("p"), F.col("user_id").cast("string"))),
        "verified": F.when(F.col("event_id") % 3 == 0, "verified").when(F.col("event_id") % 2 == 0, "")})
    return validate.crowd_contract(rows, "verified").select("event_id", "passenger_id", "error_reason")


_CONSENSUS = {
    "named": "SELECT * FROM crowd_reports WHERE passenger_id IS NOT NULL",
    "judged": """SELECT a.arrival, a.passenger_id, a.score, count(b.arrival) AS others, avg(b.score) AS consensus FROM named a
        LEFT JOIN named b ON b.route_id = a.route_id AND b.stop_id = a.stop_id AND b.passenger_id <> a.passenger_id
        AND b.t BETWEEN a.t - 1200000 AND a.t GROUP BY ALL""",
}


def _judged(spark, sf):
    return crowd.consensus(view(spark, sf, "crowd_reports"), width=CROWD_CHUNK)


@query("report_consensus", oracle(f"SELECT arrival, CAST(others AS BIGINT) AS others, {S.steady_sql('consensus', 6)} AS consensus FROM judged",
                                  "crowd_reports", extra=_CONSENSUS))
def report_consensus(spark, sf):
    return _judged(spark, sf).select("arrival", F.col("others").cast("long").alias("others"), S.steady("consensus", 6).alias("consensus"))


# trust in hundredths, report by report
_TRUST = {
    **_CONSENSUS,
    "moves": """SELECT passenger_id, arrival, CASE WHEN others < 2 THEN 0 WHEN abs(score - consensus) <= 30 THEN 2 ELSE -5 END AS d,
        row_number() OVER (PARTITION BY passenger_id ORDER BY arrival) AS n FROM judged""",
    "walk": """SELECT DISTINCT passenger_id, CAST(0 AS BIGINT) AS n, CAST(80 AS BIGINT) AS trust FROM moves
        UNION ALL SELECT w.passenger_id, m.n, greatest(0, least(100, w.trust + m.d)) FROM walk w JOIN moves m
        ON m.passenger_id = w.passenger_id AND m.n = w.n + 1""",
    "profiles": """SELECT w.passenger_id, arg_max(w.trust, w.n) / 100.0d AS trust_score, max(w.n) AS total_reports,
        CAST((SELECT count(*) FROM moves m WHERE m.passenger_id = w.passenger_id AND d >= 0) AS BIGINT) AS verified_reports FROM walk w GROUP BY 1""",
}


def _recursive(select: str, *views: str, **extra: str) -> str:
    return oracle(select, "crowd_reports", *views, extra={**_TRUST, **extra}).replace("WITH ", "WITH RECURSIVE ", 1)


@query("trust_profiles", _recursive("SELECT passenger_id, trust_score, total_reports, verified_reports FROM profiles"))
def trust_profiles(spark, sf):
    return crowd.trust_profiles(_judged(spark, sf), width=chunked.ARRIVAL_CHUNK)


@query("report_trust", _recursive("SELECT c.arrival, coalesce(p.trust_score, 0.8d) AS trust FROM crowd_reports c LEFT JOIN profiles p USING (passenger_id)"))
def report_trust(spark, sf):
    return crowd.with_trust(view(spark, sf, "crowd_reports"), crowd.trust_profiles(_judged(spark, sf), width=chunked.ARRIVAL_CHUNK)).select("arrival", "trust")


_HYBRID = {
    "asked": f"""SELECT event_id AS request_id, user_id % 5 AS route_id, user_id % 5 + 5 * (event_id % 2) AS stop_id, {BASE_MS} + 5000 * event_id + 1 AS t
        FROM ev WHERE event_type = 'click'""",
    "hits": """SELECT a.request_id, a.t, count(c.arrival) AS n, sum(c.score) AS s, sum(CASE WHEN c.arrival IS NULL THEN NULL ELSE coalesce(p.trust_score, 0.8d) END) AS tr,
        sum(c.score * CASE WHEN c.arrival IS NULL THEN NULL ELSE coalesce(p.trust_score, 0.8d) END) AS st FROM asked a
        LEFT JOIN crowd_reports c ON c.route_id = a.route_id AND c.stop_id = a.stop_id AND c.t BETWEEN a.t - 1200000 AND a.t
        LEFT JOIN profiles p ON p.passenger_id = c.passenger_id GROUP BY ALL""",
    "scored": """SELECT *, CASE WHEN tr > 0 THEN st / tr ELSE s / CAST(n AS DOUBLE) END AS live, floor(t / 3600000) % 24 AS h FROM hits""",
    "hist": "SELECT *, CASE WHEN h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19 THEN 55 ELSE 20 END AS hs FROM scored",
    "final_": "SELECT *, CASE WHEN n >= 5 THEN 0.7d * live + 0.3d * hs ELSE CAST(hs AS DOUBLE) END AS f FROM hist",
}


def _asked(spark, sf):
    return view(spark, sf, "ev").filter("event_type = 'click'").select(
        F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("route_id"),
        (F.col("user_id") % 5 + 5 * (F.col("event_id") % 2)).alias("stop_id"), (BASE_MS + 5000 * F.col("event_id") + 1).alias("t"))


def _live(spark, sf):
    profiles = S.materialised(crowd.trust_profiles(_judged(spark, sf), width=chunked.ARRIVAL_CHUNK))
    reports, asked = view(spark, sf, "crowd_reports"), _asked(spark, sf)
    return crowd.live_occupancy(asked, reports, profiles, width=CROWD_CHUNK, exact=True)


@query("live_occupancy", _recursive(f"SELECT request_id, CAST(n AS BIGINT) AS report_count, {S.steady_sql('live', 6)} AS avg_live FROM scored", "ev", **_HYBRID))
def live_occupancy(spark, sf):
    return _live(spark, sf).select("request_id", F.col("report_count").cast("long").alias("report_count"), S.steady("avg_live", 6).alias("avg_live"))


@query("hybrid_prediction", _recursive(f"""SELECT request_id, {S.steady_sql('f', 6)} AS final_score,
  CASE WHEN f < 40 THEN 'NOT_FULL' WHEN f < 75 THEN 'SEMI_FULL' ELSE 'FULL' END AS prediction, n >= 5 AS live_adjustment,
  {S.steady_sql('CASE WHEN n >= 5 THEN least(0.95, 0.7 + n * 0.05 * (tr / n)) ELSE 0.75 END', 2)} AS confidence FROM final_""", "ev", **_HYBRID))
def hybrid_prediction(spark, sf):
    """Live reports blended with the cold-start score."""
    asked = train.historical_score(None, _live(spark, sf))
    out = crowd.hybrid_prediction(asked, F.col("historical"))
    return out.select("request_id", S.steady("final_score", 6).alias("final_score"), "prediction", "live_adjustment",
                      S.steady("confidence", 2).alias("confidence"))


@query("training_reports", oracle("""SELECT arrival, passenger_id FROM crowd_reports
  WHERE (SELECT count(*) FROM crowd_reports WHERE passenger_id <> 'synthetic' OR passenger_id IS NULL) < 100
    OR passenger_id <> 'synthetic' OR passenger_id IS NULL""", "crowd_reports"))
def training_reports(spark, sf):
    return crowd.training_reports(view(spark, sf, "crowd_reports")).select("arrival", "passenger_id")


@query("crowd_features", oracle("""SELECT arrival, CAST(floor(t / 3600000) % 24 AS BIGINT) AS hour_of_day,
  CAST((floor(t / 86400000) + 3) % 7 AS BIGINT) AS day_of_week, CAST((floor(t / 86400000) + 3) % 7 >= 5 AS BIGINT) AS is_weekend,
  coalesce(direction_id, 0) AS direction_id, CAST(CASE WHEN score < 40 THEN 0 WHEN score < 75 THEN 1 ELSE 2 END AS BIGINT) AS label
  FROM crowd_reports""", "crowd_reports"))
def crowd_features(spark, sf):
    out = crowd.crowd_features(view(spark, sf, "crowd_reports"))
    return out.select("arrival", *[F.col(c).cast("long").alias(c) for c in ("hour_of_day", "day_of_week", "is_weekend", "direction_id", "label")])


@query("crowd_model_metrics")
def crowd_model_metrics(spark, sf):
    """Occupancy classifier on the reports: held-out accuracy and weighted F1."""
    rows = crowd.crowd_features(crowd.training_reports(view(spark, sf, "crowd_reports"))).withColumn("stop_sequence", F.lit(1))
    fit_on, test_on = train.split_by_hash(rows, ["arrival"])
    model = train.train_crowd_model(fit_on)
    if model is None:
        return spark.createDataFrame([], "accuracy double, weighted_f1 double")
    scored = model.transform(test_on.withColumn("label", F.col("label").cast("string")))
    return train.classification_metrics(scored, "label_index", "prediction")


@query("classification_metrics", oracle("""
SELECT sum(tp) / sum(sup) AS accuracy, sum(CASE WHEN tp > 0 THEN 2.0 * tp / (sup + guess) ELSE 0 END * sup) / sum(sup) AS weighted_f1 FROM (
 SELECT l, CAST(count(*) AS DOUBLE) AS sup, CAST(sum((l = p)::INT) AS DOUBLE) AS tp, (SELECT count(*) FROM y b WHERE b.p = a.l) AS guess FROM y a GROUP BY l)""", "crowd_reports", extra={
    "y": """SELECT CASE WHEN score < 40 THEN 0 WHEN score < 75 THEN 1 ELSE 2 END AS l, CASE WHEN arrival % 4 = 0 THEN arrival % 3 WHEN score < 40 THEN 0
        WHEN score < 75 THEN 1 ELSE 2 END AS p FROM crowd_reports"""}))
def classification_metrics(spark, sf):
    rows = view(spark, sf, "crowd_reports").withColumn("l", scalars.occupancy_class(F.col("score"))).withColumn(
        "p", F.when(F.col("arrival") % 4 == 0, F.col("arrival") % 3).otherwise(F.col("l")))
    return train.classification_metrics(rows, "l", "p")
