"""Grid-bucketed spatial joins: equi joins on cells instead of comparing everything with everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.functions import geo

# a degree of latitude is nowhere shorter than this
METRES_PER_DEGREE = 110_000.0
# 2^25 m is more than half way round
MAX_LEVEL = 25
PRUNE_CELL_DEG = 0.05


def level(radius_m: Column) -> Column:
    """Power of two (exponent) that is not below the radius, at least one metre."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(radius_m, F.lit(1.0)))), F.lit(0)), F.lit(MAX_LEVEL)).cast("int")


def levels(df: DataFrame, radius_m: str = "radius_m") -> Column:
    """The levels that occur, as one scalar array of at most ``MAX_LEVEL`` + 1 numbers."""
    found = df.select(level(F.col(radius_m)).alias("_level")).agg(F.collect_set("_level"))
    return F.coalesce(found.scalar(), F.array().cast("array<int>"))


def _lon_cell(lat_cell: Column, band: Column) -> Column:
    """Width in degrees that covers the cell's metres anywhere in the band and its neighbours."""
    edge = (F.greatest(F.abs(band), F.abs(band + 1)) + 1) * lat_cell
    return lat_cell / F.cos(F.radians(F.least(edge, F.lit(89.9))))


def near(left: DataFrame, right: DataFrame, out: str = "distance_m") -> DataFrame:
    """Pairs within ``left.radius_m``, whatever the radius.

    Left has (.., lat, lon, radius_m); right has (.., lat, lon), returned with the prefix ``r_``. Each request meets
    places in cells of its own size: radii fall into levels of powers of two, and the level is part of the
    join key. The right side, a table of places, is spread over nine cells for each level that occurs; the left
    side, which grows with traffic, keeps one row per point. Cells widen with latitude and close around the
    globe. A crowded cell is split by the adaptive skew join.
    """
    size = F.pow(F.lit(2.0), F.col("_level")) / METRES_PER_DEGREE
    asked = left.withColumn("_level", level(F.col("radius_m"))).withColumn("_cy", F.floor(F.col("lat") / size))
    wide = _lon_cell(size, F.col("_cy"))
    asked = asked.withColumn("_cx", F.when(wide > 90, 0).otherwise(F.floor(F.col("lon") / wide)))
    steps = F.array(*[F.lit(a) for a in (-1, 0, 1)])
    held = (right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
            .withColumn("_level", F.explode(levels(left))).withColumn("_a", F.explode(steps))
            .withColumn("_cy", F.floor(F.col("r_lat") / size) + F.col("_a")))
    # the same place is also met from the other side of the date line
    turned = F.filter(F.array(F.col("r_lon") - 360, F.col("r_lon"), F.col("r_lon") + 360), lambda x: x.between(-180 - 2 * wide, 180 + 2 * wide))
    columns = F.when(wide > 90, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.flatten(F.transform(
        turned, lambda x: F.transform(steps, lambda b: F.floor(x / wide) + b)))))
    held = held.withColumn("_cx", F.explode(columns)).drop("_a")
    pairs = asked.join(held, ["_level", "_cy", "_cx"]).withColumn(
        out, geo.haversine_m(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon")))
    return pairs.filter(F.col(out) <= F.col("radius_m")).drop("_level", "_cy", "_cx")


def nearest_vertex(points: DataFrame, vertices: DataFrame, point_key: list[str]) -> DataFrame:
    """Distance from each point to the nearest of all vertices: ``nearest_m``, exact at any distance.

    Vertices are grouped into cells. By the triangle inequality a cell can only hold the nearest
    vertex if the distance to its sample vertex, less the cell's diameter, is not above the best
    sample distance. The list of cell samples is bounded by the drawn network's area over the cell
    area (a few thousand entries for the service area), whatever the traffic; only the surviving
    cells are joined.
    """
    cell = PRUNE_CELL_DEG
    diameter = cell * 111_200.0 * 2 ** 0.5
    in_cells = vertices.select(F.col("lat").alias("_vlat"), F.col("lon").alias("_vlon"),
                               F.floor(F.col("lat") / cell).alias("_cy"), F.floor(F.col("lon") / cell).alias("_cx"))
    samples = in_cells.groupBy("_cy", "_cx").agg(F.min(F.struct("_vlat", "_vlon")).alias("_s"))
    listing = samples.agg(F.collect_list(F.struct("_cy", "_cx", F.col("_s._vlat").alias("lat"),
                                                  F.col("_s._vlon").alias("lon"))).alias("_cells"))
    measured = (points.select(*point_key, "lat", "lon").withColumn("_cells", listing.scalar())
                .withColumn("_d", F.transform("_cells", lambda c: F.struct(
                    geo.haversine_m(F.col("lat"), F.col("lon"), c["lat"], c["lon"]).alias("d"),
                    c["_cy"].alias("_cy"), c["_cx"].alias("_cx")))))
    best = F.array_min("_d")["d"]
    candidates = (measured.withColumn("_best", best)
                  .select(*point_key, "lat", "lon", F.explode(F.filter(
                      "_d", lambda c: c["d"] - diameter <= F.col("_best"))).alias("_c"))
                  .select(*point_key, "lat", "lon", "_c._cy", "_c._cx"))
    pairs = candidates.join(in_cells, ["_cy", "_cx"])
    return pairs.groupBy(*point_key).agg(
        F.min(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("_vlat"), F.col("_vlon"))).alias("nearest_m"))


def scaffold_classify(readings: DataFrame, vertices: DataFrame, key: list[str], limit_kmh: float = 120.0,
                      deviation_m: float = 50.0) -> DataFrame:
    """Older physics rule: nearest route vertex decides ``on_route``; existing fields win.

    A reading that names a known route is compared with that route's vertices only, every other
    accepted reading with all of them.
    """
    reason = (F.when(F.col("lat").isNull() | F.col("lon").isNull(), "MISSING_COORDINATES")
              .when(F.coalesce(F.col("speed"), F.lit(0.0)) > limit_kmh, "UNREALISTIC_SPEED"))
    judged = readings.withColumn("invalid_reason", reason)
    accepted = judged.filter(F.col("invalid_reason").isNull()).select(*key, "lat", "lon", "route_id")
    outline = vertices.groupBy("route_id").agg(F.collect_list(F.struct("lat", "lon")).alias("_line"))
    declared = accepted.join(outline, "route_id", "left")
    own = declared.filter(F.col("_line").isNotNull()).select(*key, F.array_min(F.transform(
        "_line", lambda v: geo.haversine_m(F.col("lat"), F.col("lon"), v["lat"], v["lon"]))).alias("nearest_m"))
    rest = nearest_vertex(declared.filter(F.col("_line").isNull()), vertices, key)
    measured = judged.join(own.unionByName(rest), key, "left")
    return measured.withColumns({
        "route_deviation_m": F.round("nearest_m", 2),
        "on_route": F.when(F.col("invalid_reason").isNull(),
                           F.coalesce(F.col("nearest_m") <= deviation_m, F.lit(True))),
        "physics_status": F.when(F.col("invalid_reason").isNull(), "accepted")}).drop("nearest_m")
