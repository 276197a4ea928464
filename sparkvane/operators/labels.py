"""Texts and vectors by id, and aggregates over vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timebucket import name_of


def label_by_id(routed: DataFrame, id: int, *, indexes: list[int] | None = None, ts_ms: int = 0, granularity: str = "hourly") -> DataFrame:
    """(id, chunk, partition_key): the newest text of the id in its first bucket, by key, that has one not empty."""
    rows = routed.filter(F.col("id") == id)
    if indexes is not None:
        rows = rows.filter(F.col("custom_index").isin(*indexes) if indexes else F.lit(False))
    if ts_ms > 0:
        rows = rows.filter(F.col("ts_partition") == name_of(ts_ms, granularity))
    newest = rows.groupBy("id", "partition_key").agg(F.max_by("chunk", "seq").alias("chunk"))
    return newest.filter(F.coalesce("chunk", F.lit("")) != "").orderBy("partition_key").limit(1).select("id", "chunk", "partition_key")


def first_vector_last_label(vectors: DataFrame) -> DataFrame:
    """Per id: its first vector, its newest text and time, and how many rows it has."""
    return vectors.groupBy("id").agg(
        F.min_by("embedding", "seq").alias("embedding"), F.max_by("chunk", "seq").alias("chunk"), F.max_by("ts_ms", "seq").alias("ts_ms"), F.count("*").alias("copies")
    )


def vector_mean(vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the mean of each component, summed where the rows are before anything moves."""
    parts = vectors.select(key, F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
