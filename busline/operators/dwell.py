"""Stop zones and time spent at them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C
from busline.functions import geo
from busline.operators import chunked, spatial

# the planar zone metric: metres per degree of latitude, and the shrinking of longitude
METRES_PER_DEGREE, LON_SHARE = 111_000, 0.7


def resolve_stop(points: DataFrame, zones: DataFrame, point_key: list[str]) -> DataFrame:
    """Add ``stop_id`` of the first listed zone that contains the point, NULL outside all zones.

    Zones (stop_id, zone_pos, lat, lon, radius_m) may be of any size: each is spread over the grid cells around it, of
    the power of two above its own radius, and a point looks into one cell of each size that occurs. The
    reduction to one zone is a min over structs, which combines before the shuffle.
    """
    lat_cell = F.pow(F.lit(2.0), F.col("_level")) / METRES_PER_DEGREE
    lon_cell = lat_cell / LON_SHARE
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                                 for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    placed = (zones.withColumns({"_o": around, "_level": spatial.level(F.col("radius_m"))})
              .select(F.col("stop_id").alias("_stop"), F.col("zone_pos").alias("_pos"), F.col("lat").alias("_zlat"),
                      F.col("lon").alias("_zlon"), F.col("radius_m").alias("_radius"), "_level",
                      (F.floor(F.col("lat") / lat_cell) + F.col("_o.a")).alias("_cy"),
                      (F.floor(F.col("lon") / lon_cell) + F.col("_o.b")).alias("_cx")))
    near = (points.select(*point_key, "lat", "lon", F.explode(spatial.levels(zones)).alias("_level"))
            .withColumns({"_cy": F.floor(F.col("lat") / lat_cell), "_cx": F.floor(F.col("lon") / lon_cell)})
            .join(placed, ["_level", "_cy", "_cx"])
            .filter(geo.zone_distance_m(F.col("lat"), F.col("lon"), F.col("_zlat"), F.col("_zlon")) <= F.col("_radius")))
    first = near.groupBy(*point_key).agg(F.min(F.struct("_pos", "_stop"))["_stop"].alias("stop_id"))
    return points.join(first, point_key, "left")


def dwell(visits: DataFrame, limits: C.Thresholds = C.DEFAULTS, width: int = chunked.HOUR_MS) -> DataFrame:
    """Seconds at the current stop and at the previous one, per (bus_id, trip_id) in time order.

    A new stay begins when the stop changes. State older than the TTL is forgotten: after such a
    gap the stay begins anew and nothing is known of the previous stop. A chunk without a new stay passes its state
    on; any other leaves its last stay, whatever came before.
    """
    ttl = limits.dwell_ttl_ms

    def read(table: pa.Table) -> tuple[np.ndarray, pd.Series, np.ndarray, np.ndarray]:
        """(times, stops, where a stay begins, where the state is forgotten) of the rows after the first one."""
        t, stop = table.column("t").to_numpy().astype(np.int64), table.column("stop_id").to_pandas()
        fresh = np.append(False, np.diff(t) > ttl)
        known = stop.notna().to_numpy()
        moved = np.append(False, (stop.to_numpy()[1:] != stop.to_numpy()[:-1]) & known[1:] & known[:-1]) & ~fresh
        return t, stop, fresh | moved, fresh

    def opened(state: tuple | None, stop, t: int) -> tuple[int, int | None]:
        """(entry time, seconds at the previous stop) at a chunk's first row."""
        if state is None or t - state[2] > ttl:
            return t, None
        stop_before, entry, last, previous = state
        if stop is not None and stop_before is not None and stop != stop_before:
            return t, (last - entry) // 1000
        return entry, previous

    def text(value):
        return None if value is None or value != value else value

    def summarise(table: pa.Table) -> tuple:
        t, stop, begins, fresh = read(table)
        at = np.flatnonzero(begins)
        ends = text(stop.iloc[0]), int(t[0]), text(stop.iloc[-1]), int(t[-1])
        if not len(at):
            return (*ends, None, None, None, None)
        before = int(t[at[-2]]) if len(at) > 1 else None
        return (*ends, int(t[at[-1]]), bool(fresh[at[-1]]), int(t[at[-1] - 1]), before)

    def step(state: tuple | None, chunk: tuple) -> tuple:
        stop, t, last_stop, last, begun, fresh, closed, before = chunk
        entry, previous = opened(state, stop, t)
        if begun is None:
            return last_stop, entry, last, previous
        return last_stop, begun, last, None if fresh else (closed - (entry if before is None else before)) // 1000

    def apply(table: pa.Table, state: tuple | None, _: int) -> list:
        t, stop, begins, fresh = read(table)
        entry, previous = opened(state, text(stop.iloc[0]), int(t[0]))
        at = np.flatnonzero(begins)
        entries = np.append(entry, t[at])
        closed = [previous, *[None if fresh[n] else int(t[n - 1] - e) // 1000 for n, e in zip(at.tolist(), entries[:-1].tolist(), strict=True)]]
        stay = np.cumsum(begins)
        return [(t - entries[stay]) // 1000, pa.array(closed, pa.int64()).take(pa.array(stay))]

    kind = visits.schema["stop_id"].dataType.simpleString()
    return chunked.scan(
        visits, ["bus_id", "trip_id"], "t", width, summarise=summarise, step=step, apply=apply,
        summary=f"stop {kind}, t0 long, last_stop {kind}, t1 long, begun long, fresh boolean, closed long, before long",
        state=f"stop {kind}, entry long, last long, previous long", added="dwell_current_s long, dwell_prev_s long")


def grouped_median(rows: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """(key, out): the exact median of each group, by rank among the counts of its distinct values; the mean of the middle two."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*key)
    ranked = counts.withColumns({"_upto": F.sum("_n").over(group.orderBy(value)), "_all": F.sum("_n").over(group)})
    low, high = (F.min(F.when(F.col("_upto") * 2 >= F.col("_all") + more, F.col(value))) for more in (0, 1))
    return ranked.groupBy(*key).agg(((low + high) / 2).alias(out))


def dwell_quality(stays: DataFrame) -> DataFrame:
    """Documented quality rules: slow and long enough to be a stop, terminal layover, median fill.

    A missing previous dwell is filled with the exact median of the stop and hour.
    """
    median = grouped_median(stays, ["stop_id", "hour"], "dwell_prev_s", "_median")
    return (stays.join(median, ["stop_id", "hour"], "left")
            .withColumns({
                "is_dwell": (F.col("speed_ms") < 1) & (F.col("dwell_current_s") > 10),
                "is_layover": F.col("dwell_current_s") > 300,
                "dwell_prev_filled_s": F.coalesce(F.col("dwell_prev_s").cast("double"), "_median")}).drop("_median"))


def dwell_statistics(reports: DataFrame) -> DataFrame:
    return reports.groupBy("stop_id", "hour").agg(F.avg("score").alias("avg_score"), F.count("*").alias("n"))
