"""Helpers that the text operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that one step inside a task looks at together.
SLICE_CHARS = 2_000_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that all machines share (``spark.checkpoint.dir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{folder.rstrip('/')}/busline-llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: computed once, and safe when executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def beside(op: Callable[[DataFrame], DataFrame], rows: DataFrame, *used: str) -> DataFrame:
    """``op`` over the columns ``used`` of ``rows``; the others travel past it as one value, so no name of theirs can clash.

    Gives the columns of ``rows`` in order, without those that a new column of the same name replaces, then the new columns.
    """
    named = [c for c in rows.columns if c in used]
    place = {c: f"_rest{n}" for n, c in enumerate(c for c in rows.columns if c not in used)}
    slim = rows.select(*[F.col(f"`{c}`") for c in named], F.struct(*[F.col(f"`{c}`").alias(p) for c, p in place.items()], F.lit(0).alias("_rest")).alias("_rest"))
    out = op(slim)
    new = [c for c in out.columns if c not in slim.columns]
    # a generator takes the value apart: the optimizer does not reach through it
    wide = out.select(*[c for c in out.columns if c != "_rest"], F.inline(F.array("_rest")))
    return wide.select(*[F.col(f"`{c}`") if c in named else F.col(place[c]).alias(c) for c in rows.columns if c not in new], *new)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the input columns that a result column of the same name replaces."""
    return df.drop(*names)


def extended(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *fields])


def slices(column: pa.Array, most_chars: int = SLICE_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) so that a step holds about ``most_chars`` characters, or one longer text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
    first = held = 0
    for row, size in enumerate(sizes):
        if held and held + size > most_chars:
            yield first, column.slice(first, row - first).to_pylist()
            first, held = row, 0
        held += size + 64
    if first < len(sizes):
        yield first, column.slice(first).to_pylist()


def text_key(text: str = "text") -> F.Column:
    """128 bits that stand for a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``number`` (from 0, in the order of ``order``, within ``group``) and ``total`` (the group's size).

    Rows are dealt to sorted ranges of (group, order), so a group of any size is spread over many tasks; rows that agree
    in all columns of ``order`` must be alike. Ranges are counted, and each moves its numbers on by the ranges before it.
    """
    place = stored(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                   .withColumn("place", F.monotonically_increasing_id()), "places").withColumn("part", F.shiftright("place", 33))
    counts = place.groupBy(*group, "part").agg(F.min("place").alias("head"), F.count("*").alias("held"))
    by = f"PARTITION BY {', '.join(group)}" if group else ""
    # one row per range and group in it
    starts = stored(counts.select(*[F.col(c).alias(f"of_{c}") for c in group], F.col("part").alias("of_part"), "head",
                                  F.expr(f"sum(held) OVER ({by} ORDER BY part) - held").alias("start"),
                                  F.expr(f"sum(held) OVER ({by})").alias("total")), "starts")
    same = F.col("part") == F.col("of_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    return place.join(starts, same).select(*rows.columns, (F.col("place") - F.col("head") + F.col("start")).alias("number"), "total")
