"""Sharding by jump consistent hashing.

A key and the number of shards alone decide the shard; there is no ring to store. When shards are appended, a key
either stays or moves to one of the new shards, which happens to the share of keys the new shards must hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busline.llm.common import stored, without

#: Multiplier of the 64-bit congruential step of the published algorithm (fixed value).
STEP = np.uint64(2862933555777941757)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of 64-bit keys: every key jumps ahead until it would leave the range."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    going = np.arange(len(state))
    ahead = np.zeros(len(state), np.float64)
    while len(going):
        shard[going] = ahead[going].astype(np.int64)
        state[going] = state[going] * STEP + np.uint64(1)
        ahead[going] = np.floor((shard[going] + 1) * (2.0**31 / ((state[going] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)))
        going = going[ahead[going] < shards]
    return shard


def shard_of(key: Column | str, shards: int) -> Column:
    """Shard (int) of a long key; a null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be a shard")

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(np.int64), shards), dtype="int32")

    column = F.col(key) if isinstance(key, str) else key
    return run(F.coalesce(column.cast("long"), F.lit(0).cast("long")))


def assign(rows: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard, slot and the shard after one more is appended, for every row.

    Columns: the key, size (UTF-8 bytes of the text plus 8), text_crc32, law, shard, slot, grown_shard. A null text has
    no bytes, a null key is hashed as 0, equal keys share a shard, and repeated rows are kept. Slots count from 0 in
    the order of the key (null first, equal keys in any order). Rows are dealt to ranges of (shard, key, place in
    the input), so a shard, or a key with a large share of the rows, is spread over many tasks: each range numbers its own
    rows, and moves them on by the sizes of the ranges before it.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    sized = rows.select(
        F.col(key), (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), shard_of(key, shards).alias("shard"),
        shard_of(key, shards + 1).alias("grown_shard"), F.monotonically_increasing_id().alias("place"))
    # a narrow table; the range of a row is fixed once it is written
    sized = stored(sized.repartitionByRange("shard", key, "place").withColumn("part", F.spark_partition_id()), "shards")
    counts = sized.groupBy("shard", "part").count()  # ranges are disjoint: at most (ranges + shards) rows
    starts = counts.select("shard", "part", F.expr("sum(count) OVER (PARTITION BY shard ORDER BY part) - count").alias("start"))
    number = F.expr(f"row_number() OVER (PARTITION BY shard, part ORDER BY `{key}`, place) - 1")
    return (sized.withColumn("number", number)
            .join(F.broadcast(starts), ["shard", "part"])  # bounded as above
            .select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("start") + F.col("number")).cast("long").alias("slot"), "grown_shard"))


def write_shards(rows: DataFrame, shards: int, path: str, key: str = "doc_id", files: int = 1) -> None:
    """Write all rows as Parquet, one folder per shard (``shard=<n>``) of ``files`` files; the folder must be new."""
    part = F.pmod(F.monotonically_increasing_id(), F.lit(files))
    dealt = without(rows, "shard").withColumn("shard", shard_of(key, shards)).withColumn("_file", part)
    dealt.repartition(shards * files, "shard", "_file").drop("_file").write.partitionBy("shard").parquet(path)
