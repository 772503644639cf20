"""Spherical geometry as Column expressions (whole-stage codegen where Spark allows it)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busline import contracts as C


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.pow(F.sin(half_dlat), 2)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_dlon), 2))
    return 2 * C.EARTH_RADIUS_M * F.atan2(F.sqrt(chord), F.sqrt(1 - chord))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_m(lat1, lon1, lat2, lon2) / 1000.0


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360), one decimal."""
    phi1, phi2, dlon = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dlon) * F.cos(phi2)
    north = F.cos(phi1) * F.sin(phi2) - F.sin(phi1) * F.cos(phi2) * F.cos(dlon)
    return F.round(F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0)), 1)


def in_bounds(lat: Column, lon: Column) -> Column:
    return lat.between(C.MIN_LAT, C.MAX_LAT) & lon.between(C.MIN_LON, C.MAX_LON)


def segment_mode(lat: Column, lon: Column) -> Column:
    inside = (lat.between(C.EXPRESSWAY_MIN_LAT, C.EXPRESSWAY_MAX_LAT)
              & lon.between(C.EXPRESSWAY_MIN_LON, C.EXPRESSWAY_MAX_LON))
    return F.when(inside, F.lit("expressway")).otherwise(F.lit("urban"))


def zone_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar stop-zone metric: 111 km per degree, longitude shrunk by 0.7."""
    return F.sqrt(F.pow(F.abs(lat1 - lat2) * 111000, 2)
                  + F.pow(F.abs(lon1 - lon2) * 111000 * 0.7, 2))


def route_segments(points: DataFrame, key: str = "route_id") -> DataFrame:
    """One row per route: non-degenerate segments with running length, total length, first point.

    ``points`` has (key, seq, lat, lon). One route is one polyline, so the array is as long as
    the drawn line, never as long as the traffic on it.
    """
    line = Window.partitionBy(key).orderBy("seq")
    legs = (points
            .withColumn("lat2", F.lead("lat").over(line))
            .withColumn("lon2", F.lead("lon").over(line))
            .withColumn("len", F.coalesce(haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")),
                                          F.lit(0.0)))
            .withColumn("cum", F.sum("len").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("len")))
    leg = F.struct("seq", F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), "lat2", "lon2", "len", "cum")
    return legs.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("len") > 0, leg))).alias("segments"),
        F.sum("len").alias("total_m"),
        F.count("*").alias("n_points"),
        F.min_by("lat", "seq").alias("first_lat"),
        F.min_by("lon", "seq").alias("first_lon"),
    )


def segment_distances(lat: Column, lon: Column, segments: Column) -> Column:
    """array of struct(distance_m, seq, along_m), one per segment.

    The chained transforms bind the projection ratio once per segment instead of repeating its
    trigonometry.
    """
    def with_ratio(s: Column) -> Column:
        d1 = haversine_m(lat, lon, s["lat1"], s["lon1"])
        d2 = haversine_m(lat, lon, s["lat2"], s["lon2"])
        ratio = (F.pow(d1, 2) + F.pow(s["len"], 2) - F.pow(d2, 2)) / (2 * F.pow(s["len"], 2))
        return F.struct(s.alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).alias("t"))

    def with_distance(p: Column) -> Column:
        s, t = p["s"], p["t"]
        foot_lat = s["lat1"] + t * (s["lat2"] - s["lat1"])
        foot_lon = s["lon1"] + t * (s["lon2"] - s["lon1"])
        return F.struct(haversine_m(lat, lon, foot_lat, foot_lon).alias("distance_m"),
                        s["seq"].alias("seq"), (s["cum"] + t * s["len"]).alias("along_m"))

    return F.transform(F.transform(segments, with_ratio), with_distance)


def nearest_on_route(lat: Column, lon: Column, segments: Column) -> Column:
    """struct(distance_m, seq, along_m) of the nearest segment; ties keep the earlier segment."""
    return F.array_min(segment_distances(lat, lon, segments))


CELL_DEG = 0.002


def cell_of(degrees: Column) -> Column:
    return F.floor(degrees / CELL_DEG).cast("long")


def route_cells(shapes: DataFrame, key: str = "route_id") -> DataFrame:
    """(route, cell) → the segments that can be nearest for a point in that cell.

    Cells lie in a band of one cell around the drawn line. For the centre c of a cell with half
    diagonal h, a segment further from c than the nearest one by more than 2h is never nearest
    inside the cell, so the short list gives the exact answer. The table grows with the length of
    the network, not with traffic. Points outside the band use the whole segment array.
    """
    legs = shapes.select(key, F.explode("segments").alias("s"))
    reach = F.greatest(F.abs(F.col("s.lat2") - F.col("s.lat1")), F.abs(F.col("s.lon2") - F.col("s.lon1")))
    pieces = F.greatest(F.lit(1), F.ceil(reach / (CELL_DEG / 2))).cast("int")
    along = (legs.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
             .select(key, (F.col("s.lat1") + (F.col("s.lat2") - F.col("s.lat1")) * F.col("_i") / F.col("_n")).alias("lat"),
                     (F.col("s.lon1") + (F.col("s.lon2") - F.col("s.lon1")) * F.col("_i") / F.col("_n")).alias("lon")))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cells = (along.select(key, cell_of(F.col("lat")).alias("cy"), cell_of(F.col("lon")).alias("cx")).distinct()
             .select(key, "cy", "cx", F.explode(around).alias("o"))
             .select(key, (F.col("cy") + F.col("o.a")).alias("cy"), (F.col("cx") + F.col("o.b")).alias("cx")).distinct())
    centre_lat, centre_lon = (F.col("cy") + 0.5) * CELL_DEG, (F.col("cx") + 0.5) * CELL_DEG
    # twice the half diagonal at its widest. The 2 % and the 5 m cover the flat projection inside a
    # segment and the plain-degree metric of planar_locate, which within 10 degrees of the equator
    # differs from metres by at most 1.6 %.
    margin = CELL_DEG * 111_320.0 * 2 ** 0.5 * 1.02 + 5.0
    sized = (cells.join(shapes.select(key, "segments"), key)
             .withColumn("_d", F.explode(F.array(segment_distances(centre_lat, centre_lon, F.col("segments"))))))
    limit = F.array_min(F.transform("_d", lambda x: x["distance_m"])) * 1.02 + margin
    return (sized.withColumn("_limit", F.explode(F.array(limit)))
            .select(key, "cy", "cx", F.transform(
                F.filter(F.arrays_zip("segments", "_d"), lambda z: z["_d"]["distance_m"] <= F.col("_limit")),
                lambda z: z["segments"]).alias("near_segments")))


def with_near_segments(df: DataFrame, cells: DataFrame, key: str = "route_id", lat: str = "lat",
                       lon: str = "lon") -> DataFrame:
    """Join each row with its cell's short list (NULL outside the band)."""
    placed = df.withColumns({"cy": cell_of(F.col(lat)), "cx": cell_of(F.col(lon))})
    return placed.join(cells, [key, "cy", "cx"], "left").drop("cy", "cx")


def route_position(df: DataFrame, lat: str = "lat", lon: str = "lon", out: str = "pos") -> DataFrame:
    """Add ``pos`` = struct(off_m, along_m, remaining_m, progress_pct).

    Needs the columns of :func:`route_segments` on the row and uses ``near_segments`` of
    :func:`with_near_segments` where present. No route or no drawn length gives zero progress; a
    one-point route gives the distance to that point. The search passes through a one-row
    generator, so that later filters and lambdas read its result instead of repeating it.
    """
    legs = F.coalesce("near_segments", "segments") if "near_segments" in df.columns else F.col("segments")
    near = nearest_on_route(F.col(lat), F.col(lon), legs)
    to_first = haversine_m(F.col(lat), F.col(lon), F.col("first_lat"), F.col("first_lon"))
    total, along = F.col("total_m"), F.coalesce(F.col("_near.along_m"), F.lit(0.0))
    drawn = F.col("_near").isNotNull()
    return (df.withColumn("_near", F.explode(F.array(F.when(F.size("segments") > 0, near))))
            .withColumn(out, F.struct(
                F.coalesce(F.col("_near.distance_m"), F.when(F.col("n_points") >= 1, to_first),
                           F.lit(0.0)).alias("off_m"),
                along.alias("along_m"),
                F.when(drawn, F.greatest(F.lit(0.0), total - along)).otherwise(0.0).alias("remaining_m"),
                F.when(drawn, F.least(F.lit(100.0), F.greatest(F.lit(0.0), along / total * 100)))
                 .otherwise(0.0).alias("progress_pct")))
            .drop("_near", *(["near_segments"] if "near_segments" in df.columns else [])))


def planar_locate(lat: Column, lon: Column, segments: Column) -> Column:
    """Nearest foot in plain degree space: struct(d2, seq, along_m, foot_lat, foot_lon).

    The metre length up to the foot uses the haversine leg lengths.
    """
    def foot(s: Column) -> Column:
        dx, dy = s["lon2"] - s["lon1"], s["lat2"] - s["lat1"]
        ratio = ((lon - s["lon1"]) * dx + (lat - s["lat1"]) * dy) / (dx * dx + dy * dy)
        return F.struct(s.alias("s"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)).alias("t"))

    def measure(p: Column) -> Column:
        s, t = p["s"], p["t"]
        foot_lat = s["lat1"] + t * (s["lat2"] - s["lat1"])
        foot_lon = s["lon1"] + t * (s["lon2"] - s["lon1"])
        d2 = F.pow(lat - foot_lat, 2) + F.pow(lon - foot_lon, 2)
        return F.struct(d2.alias("d2"), s["seq"].alias("seq"), (s["cum"] + t * s["len"]).alias("along_m"),
                        foot_lat.alias("foot_lat"), foot_lon.alias("foot_lon"))

    return F.array_min(F.transform(F.transform(segments, foot), measure))
