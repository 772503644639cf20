"""Stationary hotspots over history: dense grid cells joined into clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.operators import spatial
from busline.session import written

CELL_DEG = 0.0005


def _around(df: DataFrame, prefix: str) -> DataFrame:
    """Each cell once per neighbour position (itself included)."""
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
                                for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    return df.withColumn("_o", steps).withColumns({
        f"{prefix}cy": F.col("cy") + F.col("_o.a"), f"{prefix}cx": F.col("cx") + F.col("_o.b")}).drop("_o")


def dense_cells(readings: DataFrame, min_points: int = 10, cell: float = CELL_DEG) -> DataFrame:
    """Cells of zero-speed readings whose 3x3 neighbourhood holds enough of them.

    Readings are counted per cell before anything is joined, so a depot with a third of all
    readings is one row here.
    """
    counts = (readings.filter(F.col("speed") == 0)
              .groupBy(F.floor(F.col("lat") / cell).alias("cy"), F.floor(F.col("lon") / cell).alias("cx"))
              .agg(F.count("*").alias("n"), F.sum("lat").alias("lat_sum"), F.sum("lon").alias("lon_sum")))
    spread = _around(counts.select("cy", "cx", "n"), "n").select(F.col("ncy").alias("cy"), F.col("ncx").alias("cx"), "n")
    hoods = spread.groupBy("cy", "cx").agg(F.sum("n").alias("hood"))
    return counts.join(hoods, ["cy", "cx"]).filter(F.col("hood") >= min_points)


def clusters(cells: DataFrame) -> DataFrame:
    """Connected groups of neighbouring dense cells with weighted centroids.

    Smallest-label propagation with a jump to the label's own label, so rounds grow with the
    logarithm of a cluster's extent. Each round is written and ends when no label changes. A checkpoint keeps the
    planner's size of the joins that made it, which squares from round to round; a written round has the size of its files.
    """
    label = F.struct("cy", "cx")
    labelled = written(cells.withColumn("label", label), "hotspots")
    while True:
        offers = _around(labelled.select("cy", "cx", "label"), "n").groupBy(
            F.col("ncy").alias("cy"), F.col("ncx").alias("cx")).agg(F.min("label").alias("_best"))
        stepped = labelled.join(offers, ["cy", "cx"], "left").withColumn("_new", F.least("label", "_best"))
        jump = stepped.select(F.col("cy").alias("_jy"), F.col("cx").alias("_jx"), F.col("_new").alias("_jump"))
        moved = (stepped.join(jump, (F.col("_new.cy") == F.col("_jy")) & (F.col("_new.cx") == F.col("_jx")), "left")
                 .withColumn("_new", F.least("_new", "_jump")))
        after = written(moved.select(*cells.columns, F.col("label").alias("_old"), F.col("_new").alias("label")), "hotspots")
        changed = after.filter(F.col("_old") != F.col("label")).limit(1).count()
        labelled = after.drop("_old")
        if not changed:
            return labelled.groupBy("label").agg(
                F.sum("n").alias("points"), F.count("*").alias("cells"),
                (F.sum("lat_sum") / F.sum("n")).alias("lat"), (F.sum("lon_sum") / F.sum("n")).alias("lon")).select(
                F.concat_ws(":", F.col("label.cy").cast("string"), F.col("label.cx").cast("string")).alias("cluster"),
                "points", "cells", "lat", "lon")


def stationary_threshold_ms(readings: DataFrame, centroids: DataFrame, key: list[str], radius_m: float = 50.0,
                            usual_ms: int = 300_000, extended_ms: int = 900_000) -> DataFrame:
    """Stationary threshold per reading, longer inside a hotspot."""
    asked = readings.select(*key, "lat", "lon").withColumn("radius_m", F.lit(radius_m))
    inside = spatial.near(asked, centroids.select("cluster", "lat", "lon")).select(*key).distinct()
    hit: Column = F.col("_in").isNotNull()
    return (readings.join(inside.withColumn("_in", F.lit(1)), key, "left")
            .withColumn("threshold_ms", F.when(hit, extended_ms).otherwise(usual_ms)).drop("_in"))
