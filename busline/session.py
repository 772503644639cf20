"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "busline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine needs; ``conf`` overrides any of them.

    The number of shuffle partitions is only an upper bound: AQE merges small ones and splits
    skewed ones at run time.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # plans here are built from many small expressions; recording a call site for each is slow
        "spark.sql.dataFrameQueryContext.enabled": "false",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and read it back.

    The folder is the cluster's ``spark.checkpoint.dir``, which all its machines share.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: columns can be pruned, and its size is known to
    the planner, which broadcasts it only below the session's threshold."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{folder.rstrip('/')}/busline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, part_bytes: int | None = None) -> DataFrame:
    """Deal the rows of a table that has fewer input splits than there are cores to all cores.

    With ``part_bytes``, to as many parts as the files have of these: rows that cost much must not share a few large splits,
    whose tasks grow with the table. Only the layout of the files is looked at, nothing is read. Tables with enough splits
    stay as they are.
    """
    spark = table.sparkSession
    wanted = spark.sparkContext.defaultParallelism
    if part_bytes:
        paths = [spark._jvm.org.apache.hadoop.fs.Path(f) for f in table.inputFiles()]
        conf = spark._jsc.hadoopConfiguration()
        wanted = max(wanted, -(-sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths) // part_bytes))
    return table if table.rdd.getNumPartitions() >= wanted else table.repartition(wanted)
