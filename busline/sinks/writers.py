"""Sinks: message topics, snapshots, history, partitioned tables, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from busline.functions import scalars
from busline.operators import detect

CHECKPOINT_EVERY = "10 seconds"


def keyed_json(df: DataFrame, key: Column | None = None) -> DataFrame:
    """(key, value) messages: JSON of the whole row, keyed by bus."""
    return df.select((key if key is not None else F.col("bus_id").cast("string")).alias("key"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))


def sorted_json(df: DataFrame) -> Column:
    """JSON of the row with its keys in order, NULL fields kept."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def invalid_json(df: DataFrame, raw: str = "value", reason: str = "invalid_reason") -> DataFrame:
    """Rejected messages as JSON: the object with its reason, or the original text wrapped.

    Numbers, booleans, arrays and nested objects stay what they are; the keys of an object come in order.
    """
    fields = F.map_filter(F.try_parse_json(raw).try_cast("map<string,variant>"), lambda k, _: k != "_invalid_reason")
    tagged = F.map_concat(fields, F.map_from_arrays(F.array(F.lit("_invalid_reason")), F.array(F.col(reason).cast("variant"))))
    wrapped = F.struct(F.col(raw).alias("original_payload"), F.col(reason).alias("_invalid_reason"))
    is_object = F.schema_of_variant(F.try_parse_json(raw)).startswith("OBJECT")
    return df.withColumn("value", F.when(F.coalesce(is_object, F.lit(False)), F.to_json(tagged)).otherwise(F.to_json(wrapped)))


def topic_writer(df: DataFrame, topic: str, checkpoint: str, *, servers: str | None = None,
                 path: str | None = None) -> DataStreamWriter:
    """Stream (key, value) to Kafka (at least once) or to JSON files (exactly once)."""
    writer = (df.writeStream.option("checkpointLocation", f"{checkpoint}/{topic}")
              .trigger(processingTime=CHECKPOINT_EVERY))
    if servers:
        return writer.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option(
            "topic", topic)
    return writer.format("json").option("path", f"{path}/{topic}")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def snapshot_sink(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """Upsert of the newest row per key into versioned folders ``path/v=<batch>``.

    A batch reads the version before it and writes its own; a repeated batch overwrites the same
    version, so a retry after a lost driver changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, previous = batch, latest_version(spark, path, before=batch_id)
        if previous is not None:
            rows = batch.unionByName(spark.read.parquet(previous).select(*batch.columns))
        rest = [c for c in batch.columns if c != key]
        newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")
        newest.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    return write


def latest_version(spark: SparkSession, path: str, before: int | None = None) -> str | None:
    """Folder of the newest finished snapshot version (older than ``before``)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    numbers = [int(s.getPath().getName()[2:]) for s in fs.listStatus(root) if s.getPath().getName().startswith("v=")]
    done = [n for n in numbers if (before is None or n < before) and _exists(spark, f"{path}/v={n}/_SUCCESS")]
    return f"{path}/v={max(done)}" if done else None


def append_sink(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """Append each micro batch under its batch number, so that a retry overwrites instead of repeating."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(*partitions).parquet(f"{path}/batch={batch_id}")
    return write


def live_feed(df: DataFrame, channel: str = "telemetry:live") -> DataFrame:
    return df.select(F.lit(channel).alias("channel"), sorted_json(df).alias("value"))


def history_rows(df: DataFrame) -> DataFrame:
    """Readings in the history layout: tags, fields with their defaults, and the write date."""
    text = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return df.select(text("bus_id").alias("bus_id"), text("route_id").alias("route_id"), text("trip_id").alias("trip_id"),
                     *[number(c).alias(c) for c in ("lat", "lon", "speed", "heading", "progress_pct")], "t",
                     F.to_date(F.timestamp_millis("t")).alias("date"))


def to_points(df: DataFrame, measurement: str, time: str, tags: list[str] | None = None) -> DataFrame:
    """Long points (time, measurement, tags, field, value): numeric columns are fields, others tags."""
    numeric = ("tinyint", "smallint", "int", "bigint", "float", "double")
    tags = tags or []
    fields = [c for c, t in df.dtypes if (t in numeric or t.startswith("decimal")) and c not in (time, *tags)]
    labels = [c for c in df.columns if c not in fields and c != time]
    tag_map = F.map_from_arrays(F.array(*[F.lit(c) for c in labels]), F.array(*[F.col(c).cast("string") for c in labels]))
    shaped = df.select(time, tag_map.alias("tags"), *[F.col(c).cast("double").alias(c) for c in fields])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in fields])
    return shaped.select(time, F.lit(measurement).alias("measurement"), "tags", F.inline(pairs)).filter(
        F.col("value").isNotNull())


def _mode(batch_id: int | None) -> str:
    return "append" if batch_id is None else "overwrite"


def _place(path: str, batch_id: int | None) -> str:
    return path if batch_id is None else f"{path}/batch={batch_id}"


def write_eta_records(records: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append to month folders, clustered by place and time so that readers skip row groups.

    Range partitioning splits a hot month or stop over several tasks. A micro batch names itself by ``batch_id`` and
    writes a folder of its own, so a batch that is tried again replaces its rows instead of repeating them.
    """
    monthly = records.withColumn("recorded_month", F.date_format("recorded_at", "yyyy-MM"))
    (monthly.repartitionByRange("recorded_month", "route_id", "stop_id", "timestamp")
     .sortWithinPartitions("recorded_month", "route_id", "stop_id", "timestamp")
     .write.mode(_mode(batch_id)).partitionBy("recorded_month").parquet(_place(path, batch_id)))


def alert_rows(alerts: DataFrame) -> DataFrame:
    """Alert history rows: the searchable columns, the day, and the whole alert as its message."""
    return alerts.select("bus_id", "anomaly_type", "severity", "message", "trip_id", "route_id", F.col("location.lat").alias("lat"),
                         F.col("location.lon").alias("lon"), "t", "model_version", "source", detect.alert_message(alerts).alias("payload"),
                         F.to_date(F.timestamp_millis("t")).alias("date"))


def write_audiences(alerts: DataFrame, path: str, batch_id: int | None = None) -> None:
    """One folder per audience channel; ``batch_id`` as for arrival records."""
    routed = alerts.withColumn("channel", F.explode(scalars.audiences(F.col("anomaly_type"))))
    routed.write.mode(_mode(batch_id)).partitionBy("channel").parquet(_place(path, batch_id))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)
