"""Passenger occupancy reports: consensus, trust and hybrid prediction.

A stop may draw any number of reports and a passenger may send any number, so windows and folds
never run over reports of one key as such: reports are first summed per instant, and trust changes
are composed from partial results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import scalars
from busline.operators import chunked
from busline.operators.chunked import CHUNK

PLACE = ["route_id", "stop_id"]


def check_stop(reports: DataFrame, routes: DataFrame, links: DataFrame) -> DataFrame:
    """``error_reason``: ROUTE_NOT_FOUND, STOP_NOT_ON_ROUTE or NULL."""
    known = routes.select("route_id", F.lit(1).alias("_route")).distinct()
    on_route = links.select("route_id", "stop_id", F.lit(1).alias("_link")).distinct()
    joined = reports.join(known, "route_id", "left").join(on_route, PLACE, "left")
    reason = (F.when(F.col("_route").isNull(), "ROUTE_NOT_FOUND")
              .when(F.col("_link").isNull(), "STOP_NOT_ON_ROUTE"))
    return joined.withColumn("error_reason", reason).drop("_route", "_link")


def _trailing(reports: DataFrame, key: list[str], window_ms: int, width: int, prefix: str) -> DataFrame:
    """Sum and count of scores in the trailing window, one row per (key, t)."""
    instants = reports.groupBy(*key, "t").agg(F.sum("score").alias("_s"), F.count("*").alias("_c"))
    halo = chunked.range_halo(instants, "t", window_ms, width)
    back = Window.partitionBy(*key, CHUNK).orderBy("t").rangeBetween(-window_ms, 0)
    return (halo.withColumns({f"{prefix}_sum": F.sum("_s").over(back), f"{prefix}_n": F.sum("_c").over(back)})
            .filter(~F.col("_halo")).select(*key, "t", f"{prefix}_sum", f"{prefix}_n"))


def consensus(reports: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = 3 * chunked.HOUR_MS) -> DataFrame:
    """Named reports with count and mean of the *other* passengers' recent reports at the stop.

    The interval self join becomes a difference of two trailing windows: everyone named at the
    stop, minus the passenger. Reports without a passenger count for nobody.
    """
    named = reports.filter(F.col("passenger_id").isNotNull())
    everyone = _trailing(named, PLACE, limits.crowd_window_ms, width, "all")
    own = _trailing(named, [*PLACE, "passenger_id"], limits.crowd_window_ms, width, "own")
    return (named.join(own, [*PLACE, "passenger_id", "t"]).join(everyone, [*PLACE, "t"])
            .withColumn("others", F.col("all_n") - F.col("own_n"))
            .withColumn("consensus", F.when(F.col("others") > 0, (F.col("all_sum") - F.col("own_sum")) / F.col("others")))
            .drop("all_sum", "all_n", "own_sum", "own_n"))


def trust_change(limits: C.Thresholds = C.DEFAULTS) -> Column:
    """Trust points (hundredths): +2 within the consensus band, -5 outside, 0 without consensus."""
    agrees = F.abs(F.col("score") - F.col("consensus")) <= limits.consensus_points
    return F.when(F.col("others") < 2, 0).when(agrees, 2).otherwise(-5)


def trust_profiles(judged: DataFrame, limits: C.Thresholds = C.DEFAULTS,
                   width: int = chunked.BROKER_CHUNK, span: int = 100_000) -> DataFrame:
    """Trust, total and verified reports per passenger after all of them.

    One change is "add d, then clamp to [0, 100]". A run of changes is again "add s, then clamp to
    [lo, hi]", so runs compose: arrival chunks are folded in parallel, then spans of chunks, then the
    few spans of a passenger. Whole hundredths keep the result exact in any grouping.
    """
    start = int(round(limits.default_trust * 100))
    moves = judged.select("passenger_id", "arrival", trust_change(limits).alias("d"))

    def then(acc: Column, s: Column, lo: Column, hi: Column) -> Column:
        clamp = lambda x: F.least(hi, F.greatest(lo, x))
        return F.struct((acc["s"] + s).alias("s"), clamp(acc["lo"] + s).alias("lo"), clamp(acc["hi"] + s).alias("hi"))

    whole = F.lit(100).cast("long"), F.lit(0).cast("long")
    nothing = F.struct(whole[1].alias("s"), whole[1].alias("lo"), whole[0].alias("hi"))
    change = F.when(F.col("d") != 0, F.struct("arrival", F.col("d").cast("long").alias("d")))
    per_chunk = (chunked.with_chunk(moves, "arrival", width).groupBy("passenger_id", CHUNK)
                 .agg(F.array_sort(F.collect_list(change)).alias("_m"), F.count("*").alias("total_reports"),
                      F.count_if(F.col("d") >= 0).alias("verified_reports"))
                 .select("passenger_id", CHUNK, "total_reports", "verified_reports", F.aggregate(
                     "_m", nothing, lambda acc, m: then(acc, m["d"], whole[1], whole[0])).alias("f")))

    def fold(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
        sums = ["total_reports", "verified_reports"]
        return (df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "f"))).alias("_m"),
                                      *[F.sum(c).alias(c) for c in sums])
                .select(*keys, *sums, F.aggregate("_m", nothing, lambda acc, m: then(
                    acc, m["f"]["s"], m["f"]["lo"], m["f"]["hi"])).alias("f")))

    per_span = fold(per_chunk.withColumn("_span", F.floor(F.col(CHUNK) / span)), CHUNK, ["passenger_id", "_span"])
    total = fold(per_span, "_span", ["passenger_id"])
    points = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.lit(start) + F.col("f.s")))
    return total.select("passenger_id", (points / 100.0).alias("trust_score"), "total_reports", "verified_reports")


def with_trust(reports: DataFrame, profiles: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Trust of each report's author. Authors are joined on distinct-per-instant sums upstream, so a
    prolific author does not fan out; AQE splits a hot author's partition."""
    return (reports.join(profiles.select("passenger_id", "trust_score"), "passenger_id", "left")
            .withColumn("trust", F.coalesce("trust_score", F.lit(limits.default_trust))).drop("trust_score"))


def exact_parts(value: Column, name: str) -> dict[str, Column]:
    """A double from 2^-14 to 2^33, or 0, as whole numbers of 2^-30 and 2^-66; these add up exactly, in any order."""
    scaled = value * 2.0 ** 30
    whole = F.floor(scaled)
    return {f"{name}_hi": whole, f"{name}_lo": ((scaled - whole) * 2.0 ** 36).cast("long")}


def exact_sum(name: str) -> Column:
    """The sum of such parts, rounded once."""
    return F.col(f"{name}_hi") * 2.0 ** -30 + F.col(f"{name}_lo") * 2.0 ** -66


def live_occupancy(requests: DataFrame, reports: DataFrame, profiles: DataFrame, limits: C.Thresholds = C.DEFAULTS,
                   width: int = 3 * chunked.HOUR_MS, exact: bool = False) -> DataFrame:
    """Requests (request_id, route_id, stop_id, t) with sums over the reports of the last 20 minutes.

    No request meets a report. Reports are summed per (place, instant), the instants that requests
    ask about are added with zero weight, and one trailing window over these instants answers them
    all. Requests then pick up their instant's answer, one row per (place, instant).
    The window runs backwards, so that trust is added newest first: a blend exactly on the edge of two labels hangs on the
    last bit of these sums. With ``exact`` they are rounded once instead, and no order of the reports matters.
    """
    added = {"_t": F.col("trust"), "_st": F.col("score") * F.col("trust")}
    if exact:
        added = {n: part for name, value in added.items() for n, part in exact_parts(value, name).items()}
    sums = ["_n", "_s", *added]
    said = with_trust(reports, profiles, limits).groupBy(*PLACE, "t").agg(
        F.count("*").alias("_n"), F.sum("score").cast("double").alias("_s"), *[F.sum(c).alias(n) for n, c in added.items()])
    asked = requests.select(*PLACE, "t").distinct().select(
        *PLACE, "t", *[F.lit(0).cast(said.schema[c].dataType).alias(c) for c in sums])
    instants = said.unionByName(asked).groupBy(*PLACE, "t").agg(*[F.sum(c).alias(c) for c in sums])
    halo = chunked.range_halo(instants, "t", limits.crowd_window_ms, width)
    back = Window.partitionBy(*PLACE, CHUNK).orderBy(F.desc("t")).rangeBetween(0, limits.crowd_window_ms)
    totals = halo.select(*PLACE, "t", "_halo", *[F.sum(c).over(back).alias(c) for c in sums]).filter(~F.col("_halo"))
    total = exact_sum if exact else F.col
    totals = totals.select(*PLACE, "t", F.col("_n").alias("report_count"), F.col("_s").alias("score_sum"),
                           total("_t").alias("trust_sum"), total("_st").alias("weighted_sum"))
    return requests.join(totals, [*PLACE, "t"], "left").withColumn(
        "avg_live", F.when(F.col("trust_sum") > 0, F.col("weighted_sum") / F.col("trust_sum"))
        .when(F.col("report_count") > 0, F.col("score_sum") / F.col("report_count")))


def hybrid_prediction(live: DataFrame, historical: Column) -> DataFrame:
    """Blend of live average and historical score, with confidence and label."""
    enough = F.col("report_count") >= 5
    final = F.when(enough, 0.7 * F.col("avg_live") + 0.3 * historical).otherwise(historical.cast("double"))
    confidence = F.when(enough, F.least(F.lit(0.95), 0.70 + F.col("report_count") * 0.05
                                        * (F.col("trust_sum") / F.col("report_count")))).otherwise(0.75)
    return live.withColumns({
        "final_score": final, "prediction": scalars.occupancy_label(final),
        "confidence": F.floor(confidence * 100 + 0.500001) / 100, "historical_prediction": scalars.occupancy_label(historical),
        "live_adjustment": enough})


def training_reports(reports: DataFrame, minimum_real: int = 100) -> DataFrame:
    """Only real reports once there are enough of them, otherwise real and synthetic ones.

    The number of real reports is a scalar subquery.
    """
    real = (F.col("passenger_id") != "synthetic") | F.col("passenger_id").isNull()
    n_real = reports.agg(F.count_if(real)).scalar()
    return reports.filter((n_real < minimum_real) | real)


def crowd_features(reports: DataFrame) -> DataFrame:
    at = F.timestamp_millis("t")
    return reports.withColumns({
        "hour_of_day": F.hour(at), "day_of_week": F.weekday(at), "is_weekend": scalars.is_weekend(at),
        "direction_id": F.coalesce("direction_id", F.lit(0)), "label": scalars.occupancy_class(F.col("score"))})
