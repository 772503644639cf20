"""KML route files through the built-in XML source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COORDINATES = T.StructType([T.StructField("coordinates", T.StringType())])
PLACEMARK = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("Point", _COORDINATES),
    T.StructField("LineString", _COORDINATES)])


def _pair(text: Column) -> Column:
    """[lon, lat] of a ``lon,lat[,alt]`` text; NULL entries where a number is missing."""
    bits = F.split(F.trim(text), ",")
    number = lambda i: F.get(bits, F.lit(i)).try_cast("double")
    return F.array(number(0), number(1))


def read_kml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(routes, rejects). Routes: (route_name, loaded_at, coordinates, stops array in file order).

    A file needs one line with at least two points and at least two stops; anything else, a file without any
    placemark included, or a malformed coordinate, rejects the file.
    """
    # names only: contents are not read
    listed = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    marks = (spark.read.format("xml").option("rowTag", "Placemark").schema(PLACEMARK).load(path)
             .select("*", F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_modification_time").alias("loaded_at"),
                     F.monotonically_increasing_id().alias("_pos")))
    stop = F.col("Point.coordinates").isNotNull()
    spot = _pair(F.col("Point.coordinates"))
    points = F.transform(F.split(F.trim("LineString.coordinates"), r"\s+"), _pair)
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("Unnamed Stop"))
    rows = marks.select(
        "file", "loaded_at", "_pos",
        F.when(stop, F.struct(name.alias("stop_name"), spot[1].alias("lat"), spot[0].alias("lon"))).alias("stop"),
        F.when(~stop, points).alias("line"))
    # one group is one uploaded file
    files = rows.groupBy("file").agg(
        F.max("loaded_at").alias("loaded_at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("_pos", "line")))),
                    lambda x: x["line"]).alias("_lines"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("stop").isNotNull(), F.struct("_pos", "stop")))),
                    lambda x: x["stop"]).alias("stops"))
    none = F.array()
    whole = listed.join(files, "file", "left").select(
        "file", "loaded_at", F.coalesce("stops", none).alias("stops"), F.coalesce(F.flatten("_lines"), none).alias("coordinates"))
    bad_number = (F.exists("coordinates", lambda c: c[0].isNull() | c[1].isNull())
                  | F.exists("stops", lambda s: s["lat"].isNull() | s["lon"].isNull()))
    reason = F.when(bad_number, "MALFORMED_COORDINATE").when(
        (F.size("coordinates") < 2) | (F.size("stops") < 2), "NEEDS_LINE_AND_TWO_STOPS")
    judged = whole.withColumn("reason", reason).withColumn(
        "route_name", F.regexp_extract("file", r"([^/]+)\.kml$", 1))
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull()).select(
        "file", "reason")
