"""Routing into time x tag x capacity buckets, the manifest, pruning and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.timebucket import bucket_end, bucket_name, bucket_start
from .config import DEFAULT_TAG

#: Rows of a tag table up to which it is broadcast.
BROADCAST_TAGS = 100_000


def partition_key(ts_partition: Column, custom_index: Column, bucket: Column) -> Column:
    return F.concat_ws("_", ts_partition, custom_index.cast("string"), F.lpad(bucket.cast("string"), 4, "0"))


def parse_key(key: Column) -> list[Column]:
    parts = F.split(key, "_")
    return [F.element_at(parts, 1).alias("ts_partition"), F.element_at(parts, 2).cast("int").alias("custom_index"), F.element_at(parts, 3).cast("int").alias("bucket_number")]


def no_tags(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("custom_index"), F.lit(DEFAULT_TAG).alias("tag"))


def with_new_tags(tags: DataFrame, arriving: DataFrame, order: str = "seq") -> DataFrame:
    """Tags and those first seen in `arriving` (tag, order), numbered on from the highest index by first arrival."""
    first = arriving.groupBy("tag").agg(F.min(order).alias("first")).join(tags, "tag", "left_anti")
    top = tags.agg(F.coalesce(F.max("custom_index"), F.lit(0)).alias("top"))
    numbered = first.select("tag", F.row_number().over(W.orderBy("first", "tag")).alias("i")).crossJoin(F.broadcast(top))
    return tags.select("custom_index", "tag").unionByName(numbered.select((F.col("top") + F.col("i")).cast("int").alias("custom_index"), "tag"))


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, given only after a count within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_TAGS + 1).count() <= BROADCAST_TAGS else df


#: Arrival numbers in a slice: the most rows of a time and tag that one task numbers.
SLICE = 1 << 20


def numbered_rows(rows: DataFrame, keys: list[str], seq: str, then: str) -> DataFrame:
    """rows with rn, their number from 0 within keys in order of (seq, then).

    Each slice of seq is numbered on its own and begins where the sums of the slices before it end, so no task needs
    all rows of a key.
    """
    sliced = rows.withColumn("slice", F.floor(F.col(seq) / SLICE))
    sizes = sliced.groupBy(*keys, "slice").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*keys, "slice", before.alias("before"))
    i = F.row_number().over(W.partitionBy(*keys, "slice").orderBy(seq, then))
    return sliced.withColumn("i", i).join(starts, [*keys, "slice"]).withColumn("rn", F.col("before") + F.col("i") - 1).drop("slice", "i", "before")


def route(vectors: DataFrame, tags: DataFrame, granularity: str, capacity: int, filled: DataFrame | None = None) -> DataFrame:
    """Adds ts_partition, custom_index, bucket_number and partition_key.

    Rows of a time and tag fill their highest bucket in order of seq, then the next ones. filled: (ts_partition,
    custom_index, held), the rows already stored.
    """
    keys = ["ts_partition", "custom_index"]
    tagged = vectors.join(small(tags), "tag").withColumn("ts_partition", bucket_name(F.col("ts_ms"), granularity))
    rows = numbered_rows(tagged, keys, "seq", "id")
    held = F.lit(0)
    if filled is not None:
        rows = rows.join(filled.select(*keys, "held"), keys, "left")
        held = F.coalesce("held", F.lit(0))
    number = F.floor((held + F.col("rn")) / capacity).cast("int")
    return rows.withColumn("bucket_number", number).withColumn("partition_key", partition_key(F.col("ts_partition"), F.col("custom_index"), F.col("bucket_number"))).drop("rn", "held")


def manifest(routed: DataFrame, *more: Column) -> DataFrame:
    """One row per bucket with event-time bounds and size."""
    return routed.groupBy("partition_key", "ts_partition", "custom_index", "bucket_number").agg(
        F.min("ts_ms").alias("ts_start"), F.max("ts_ms").alias("ts_end"), F.count("*").alias("element_count"), *more
    )


def prune(buckets: DataFrame, ts_start: int = 0, ts_end: int = 0, indexes: list[int] | None = None) -> DataFrame:
    """Buckets that overlap a time range, ends included and 0 open, and have one of the tags. Bounds of 0 or less stay."""
    keep = F.lit(True)
    if ts_start > 0:
        keep &= (F.col("ts_end") <= 0) | (F.col("ts_end") >= ts_start)
    if ts_end > 0:
        keep &= (F.col("ts_start") <= 0) | (F.col("ts_start") <= ts_end)
    if indexes is not None:
        keep &= F.col("custom_index").isin(*indexes) if indexes else F.lit(False)
    return buckets.filter(keep)


def with_pending(buckets: DataFrame, pending: DataFrame) -> DataFrame:
    """Manifest rows and, by name range, those of buckets not yet in it."""
    parsed = pending.select("partition_key", *parse_key(F.col("partition_key")))
    dated = parsed.select("*", F.coalesce(bucket_start(F.col("ts_partition")), F.lit(0)).alias("ts_start"), F.coalesce(bucket_end(F.col("ts_partition")) - 1, F.lit(0)).alias("ts_end"), F.lit(0).cast("long").alias("element_count"))
    return buckets.unionByName(dated.join(buckets, "partition_key", "left_anti"))


def highest_bucket(buckets: DataFrame) -> DataFrame:
    return buckets.groupBy("ts_partition", "custom_index").agg(F.max("bucket_number").alias("bucket_number"))


def list_partitions(buckets: DataFrame, tags: DataFrame) -> DataFrame:
    named = tags.groupBy("custom_index").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))
    return buckets.join(named, "custom_index", "left").select(
        "partition_key", "ts_partition", "custom_index", "bucket_number", F.coalesce("tags", F.lit("")).alias("tags"), F.lit(False).alias("loaded"), "element_count"
    )


def partition_info(tags: DataFrame, tag: str) -> DataFrame:
    """(custom_index, tags) of a tag and its aliases; no row for an unknown one."""
    own = tags.filter(F.col("tag") == tag).select("custom_index")
    return tags.join(own, "custom_index", "left_semi").groupBy("custom_index").agg(F.array_join(F.sort_array(F.collect_set("tag")), ",").alias("tags"))


def full_scan(routed: DataFrame) -> DataFrame:
    return routed.agg(
        F.count("*").alias("vectors"), F.countDistinct("partition_key").alias("buckets"), F.countDistinct("ts_partition").alias("partitions"), F.lit(0).cast("long").alias("wal_files")
    )
