"""Seasonal arrival model per (route, stop) with seasonal and non-seasonal AR, MA terms.

The hourly series is differenced once and once over a day. Coefficients come from two regressions
whose normal equations are grouped sums: first on the lagged differences, then also on the lagged
residuals of the first. A series is at most as long as the calendar, so its windows are bounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.operators import train

PLACE = train.PLACE
SEASON = 24
TAIL = 2 * SEASON + 2


def _solve(n_terms: int):
    """Pandas UDF: solve each row's normal equations (flattened matrix, right-hand side)."""
    @F.pandas_udf("array<double>")
    def solve(matrix: pd.Series, right: pd.Series) -> pd.Series:
        def one(m, r):
            a, b = np.array(m, dtype=float).reshape(n_terms, n_terms), np.array(r, dtype=float)
            if not np.isfinite(a).all() or not np.isfinite(b).all():
                return [0.0] * n_terms
            return np.linalg.lstsq(a, b, rcond=None)[0].tolist()
        return pd.Series([one(m, r) for m, r in zip(matrix, right)])
    return solve


def _regress(rows: DataFrame, target: str, terms: list[str], out: str) -> DataFrame:
    """Least-squares coefficients of ``target`` on ``terms`` per place, as one array."""
    complete = rows.filter(F.col(target).isNotNull())
    for t in terms:
        complete = complete.filter(F.col(t).isNotNull())
    sums = complete.groupBy(*PLACE).agg(
        F.array(*[F.sum(F.col(a) * F.col(b)) for a in terms for b in terms]).alias("_m"),
        F.array(*[F.sum(F.col(a) * F.col(target)) for a in terms]).alias("_r"))
    return sums.select(*PLACE, _solve(len(terms))("_m", "_r").alias(out))


def fit(hourly: DataFrame, limits: C.Thresholds = C.DEFAULTS) -> DataFrame:
    """Model table keyed by place: coefficients, hours, hold-out size and error, next forecast."""
    marked = train.hold_out(hourly).filter(F.col("n_hours") >= limits.seasonal_hours)
    series = Window.partitionBy(*PLACE).orderBy("hour_ms")
    known = marked.filter(~F.col("held_out"))
    y = F.col("eta_seconds")
    diffed = known.withColumn("w", (y - F.lag(y, 1).over(series)) - (F.lag(y, SEASON).over(series) - F.lag(y, SEASON + 1).over(series)))
    lagged = diffed.withColumns({"w1": F.lag("w", 1).over(series), "w24": F.lag("w", SEASON).over(series)})
    first = _regress(lagged, "w", ["w1", "w24"], "_a")
    residual = lagged.join(first, PLACE).withColumn(
        "e", F.col("w") - F.col("_a")[0] * F.col("w1") - F.col("_a")[1] * F.col("w24"))
    full = residual.withColumns({"e1": F.lag("e", 1).over(series), "e24": F.lag("e", SEASON).over(series)})
    second = _regress(full, "w", ["w1", "w24", "e1", "e24"], "coefficients")

    newest = F.row_number().over(Window.partitionBy(*PLACE).orderBy(F.desc("hour_ms")))
    tails = (full.withColumn("_n", newest).filter(F.col("_n") <= TAIL).groupBy(*PLACE)
             .agg(F.array_sort(F.collect_list(F.struct("hour_ms", "eta_seconds", "w", "e"))).alias("tail"),
                  F.max("n_hours").alias("n_hours")))
    held = marked.filter("held_out").groupBy(*PLACE).agg(
        F.array_sort(F.collect_list(F.struct("hour_ms", "eta_seconds"))).alias("held"))
    table = tails.join(held, PLACE, "left").join(second, PLACE, "left")

    @F.pandas_udf("struct<forecast:array<double>,rmse:double>")
    def project(tail: pd.Series, held: pd.Series, coefficients: pd.Series) -> pd.DataFrame:
        rows = []
        for points, test, coef in zip(tail, held, coefficients):
            ys = [p["eta_seconds"] for p in points]
            zero = lambda v: 0.0 if v is None or not np.isfinite(v) else float(v)
            ws, es = [zero(p["w"]) for p in points], [zero(p["e"]) for p in points]
            c = [0.0] * 4 if coef is None else list(coef)
            out = []
            steps = max(1, 0 if test is None else len(test))
            for _ in range(steps):
                back = lambda seq, k: seq[-k] if len(seq) >= k else 0.0
                w = c[0] * back(ws, 1) + c[1] * back(ws, SEASON) + c[2] * back(es, 1) + c[3] * back(es, SEASON)
                season = ys[-SEASON] - ys[-SEASON - 1] if len(ys) > SEASON else 0.0
                value = ys[-1] + season + w
                ys.append(value)
                ws.append(w)
                es.append(0.0)
                out.append(value)
            error = None
            if test is not None and len(test):
                actual = np.array([p["eta_seconds"] for p in test])
                error = float(np.sqrt(np.mean((actual - np.array(out)) ** 2)))
            rows.append((out, error))
        return pd.DataFrame(rows, columns=["forecast", "rmse"])

    return (table.withColumn("_p", project("tail", "held", "coefficients"))
            .select(*PLACE, "n_hours", F.coalesce(F.size("held"), F.lit(0)).alias("hold_out"), "coefficients",
                    F.col("_p.rmse").alias("rmse"), F.get("_p.forecast", F.lit(0)).alias("next_eta")))


def lookup(requests: DataFrame, models: DataFrame) -> DataFrame:
    """``seasonal_eta`` of each request's place, never negative, NULL without a model."""
    known = models.select(*PLACE, F.col("next_eta").alias("_next"))
    return requests.join(known, PLACE, "left").withColumn(
        "seasonal_eta", F.when(F.col("_next").isNotNull(), F.greatest(F.lit(0.0), F.col("_next")))).drop("_next")
