"""Stream and table readers.

Every stream goes through :func:`message_stream`: Kafka in production, files with the same columns
where there is no broker. Both give (key, value, arrival, received_at); ``arrival`` is the order
within a key, across topics too. Offsets of two topics have no common scale, so it is built from the
broker's time, then the topic's rank, then the offset; a key lives in one partition of a topic. The topics must use
the broker's append time, which never runs against the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busline.operators.chunked import ARRIVAL_PER_MS

TOPICS = {
    "telemetry": ("transport-telemetry-raw", "earliest"),
    "lifecycle": ("trip.lifecycle", "earliest"),
    "cleaned": ("transport-telemetry-cleaned", "earliest"),
    "dlq": ("transport-telemetry-dlq", "earliest"),
    "eta_features": ("transport-eta-features", "latest"),
    "crowd_reports": ("crowd-reports", "latest"),
    "device_config": ("device.config", "latest"),
}

#: Messages and files that one micro batch takes at most, so that the first one is not the whole topic.
MOST_OFFSETS, MOST_FILES = 5_000_000, 1_000

FILE_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("arrival", T.LongType()), T.StructField("received_at", T.TimestampType())])


def kafka_options(topic: str, servers: str, starting: str, max_offsets: int | None = None) -> dict[str, str]:
    # offsets that have expired stop the query: skipping them would lose messages without a word
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "failOnDataLoss": "true"}
    if max_offsets:
        options["maxOffsetsPerTrigger"] = str(max_offsets)
    return options


def arrival_order(received_at: Column, name: str, offset: Column) -> Column:
    """One long that orders messages of all topics: time in milliseconds, lifecycle before other topics, offset."""
    rank = 0 if name == "lifecycle" else 1
    return F.unix_millis(received_at) * ARRIVAL_PER_MS + rank * (1 << 20) + F.pmod(offset, F.lit(1 << 20))


def from_broker(df: DataFrame, name: str) -> DataFrame:
    """Broker records as messages."""
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     arrival_order(F.col("timestamp"), name, F.col("offset")).alias("arrival"), F.col("timestamp").alias("received_at"))


def message_stream(spark: SparkSession, name: str, *, servers: str | None = None, path: str | None = None,
                   max_offsets: int | None = MOST_OFFSETS, max_files: int | None = MOST_FILES) -> DataFrame:
    """Stream of one of the engine's topics, from Kafka (``servers``) or a JSON folder (``path``), in bounded micro batches."""
    topic, starting = TOPICS[name]
    if servers:
        return from_broker(spark.readStream.format("kafka")
                           .options(**kafka_options(topic, servers, starting, max_offsets)).load(), name)
    reader = spark.readStream.schema(FILE_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(f"{path}/{topic}")


def message_table(spark: SparkSession, name: str, *, servers: str | None = None, path: str | None = None) -> DataFrame:
    """The same topic as a bounded table, from its beginning to its present end."""
    topic, _ = TOPICS[name]
    if servers:
        options = {**kafka_options(topic, servers, "earliest"), "endingOffsets": "latest"}
        return from_broker(spark.read.format("kafka").options(**options).load(), name)
    return spark.read.schema(FILE_SCHEMA).json(f"{path}/{topic}")


def payload_table(spark: SparkSession, path: str) -> DataFrame:
    """Raw device payload files under ``transport/bus/<id>/location``: bytes, topic and receive time."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    topic = F.regexp_extract("path", r"(transport/bus/[^/]+/[^/]+)/", 1)
    return files.select(F.col("content").alias("payload"), topic.alias("source_topic"),
                        F.col("modificationTime").alias("received_at"))


def history_scan(points: DataFrame, as_of_ms: int, back_ms: int, measurement: str, fields: list[str],
                 time: str = "t") -> DataFrame:
    """Long points of the trailing range, one row per (time, tags) with the fields as columns.

    The fields are named, so one hash aggregation turns the points of a reading into its row, before the shuffle already;
    a pivot would sort and shuffle all points twice.
    """
    recent = points.filter((F.col("measurement") == measurement) & (F.col(time) >= as_of_ms - back_ms))
    tagged = recent.withColumn("_tags", F.array_sort(F.map_entries("tags")))
    return (tagged.groupBy(time, "_tags").agg(*[F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f) for f in fields])
            .withColumn("tags", F.map_from_entries("_tags")).drop("_tags"))


def between_months(column: str, start: Column, end: Column) -> Column:
    """Partition predicate of a time range; Catalyst cannot derive it from the time filter."""
    return F.col(column).between(F.date_format(start, "yyyy-MM"), F.date_format(end, "yyyy-MM"))


def eta_record_scan(records: DataFrame, limit: int | None = None, order: list[str] | None = None) -> DataFrame:
    """Newest records first; with a limit this is a distributed top-k."""
    newest = records.orderBy(*[F.desc(c) for c in order or ["recorded_at"]])
    return newest.limit(limit) if limit is not None else newest


def seasonal_scan(records: DataFrame) -> DataFrame:
    """On-route records with route and stop, only the columns the seasonal model reads."""
    return records.filter(~F.col("off_route") & F.col("route_id").isNotNull() & F.col("stop_id").isNotNull()).select(
        "route_id", "stop_id", "eta_seconds", "t")


def training_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """CSV with a header; missing required columns are all named in the error."""
    header = spark.read.option("header", "true").csv(path)
    missing = [c for c in required if c not in header.columns]
    if missing:
        raise ValueError(f"training data lacks columns: {', '.join(missing)}")
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in required else T.StringType()) for c in header.columns])
    return spark.read.option("header", "true").schema(schema).csv(path)
