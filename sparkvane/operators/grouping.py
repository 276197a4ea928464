"""Greedy clustering around running centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.catalog import no_tags, small
from ..plans.catalog import partition_key as partition_key_of
from ..plans.config import DEFAULT_TAG


class Centroids:
    """Takes unit vectors one by one: each joins the most similar centroid, or founds one."""

    def __init__(self, threshold: float, capacity: int = 64):
        self.threshold, self.count = threshold, 0
        self.rows, self.members = None, []
        self.capacity = capacity

    def add(self, vector: np.ndarray) -> int | None:
        length = float(np.sqrt((vector * vector).sum()))
        if not length:
            return None
        unit = vector / length
        if self.rows is None:
            self.rows = np.zeros((self.capacity, len(unit)))
        if self.rows.shape[1] != len(unit):
            return None
        if self.count:
            similar = self.rows[: self.count] @ unit
            best = int(similar.argmax())
            if similar[best] >= self.threshold:
                joined = self.rows[best] * self.members[best] + unit
                size = float(np.sqrt((joined * joined).sum()))
                self.rows[best] = joined / size if size else joined
                self.members[best] += 1
                return best
        if self.count == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.count] = unit
        self.members.append(1)
        self.count += 1
        return self.count - 1


def resolve_vectors(
    items: DataFrame, routed: DataFrame, id_key: str = "image_id", partition_key: str = "device_id", time_bucket: str = "ts_partition", full_partition_key: str = "", tags: DataFrame | None = None
) -> DataFrame:
    """(id, embedding) of each item, the first stored one where the item points.

    An item names its bucket by a full key, or by a time bucket and a tag; one without a time or tag means `default`. The
    bucket it names comes first (the first of a time and tag), then the others of that time and tag in order, and of the
    whole time only where the tag is unknown. tags: (custom_index, tag), aliases included; without it the tags of the
    stored rows. Items that repeat an id are looked up each, and the best hit counts; those without a stored vector go.
    """
    if id_key not in items.columns:
        raise ValueError(f"items have no column {id_key!r}")
    col = lambda name: F.col(name).cast("string") if name and name in items.columns else F.lit(None).cast("string")
    default = F.lit(DEFAULT_TAG)
    asked = items.select(F.col(id_key).cast("long").alias("id"), col(full_partition_key).alias("key"), F.coalesce(col(partition_key), default).alias("tag"), F.coalesce(col(time_bucket), default).alias("time")).distinct()
    known = tags if tags is not None else routed.select("custom_index", "tag").union(no_tags(routed.sparkSession)).distinct()
    asked = asked.join(small(known.select("tag", F.col("custom_index").alias("index"))), "tag", "left")
    whole_time = F.concat(F.col("time"), F.lit("_"))
    named = F.coalesce("key", partition_key_of(F.col("time"), F.coalesce("index", F.lit(0)), F.lit(0)))
    wider = F.when(F.col("key").isNotNull(), F.when(F.contains("key", F.lit("_")), F.regexp_replace("key", "_[^_]*$", "_"))).otherwise(F.when(F.col("index").isNull(), whole_time).otherwise(F.concat(whole_time, F.col("index").cast("string"), F.lit("_"))))
    asked = asked.select("id", named.alias("named"), wider.alias("wider"))
    hits = asked.join(routed.select("id", "embedding", "seq", "partition_key"), "id").filter((F.col("partition_key") == F.col("named")) | F.col("partition_key").startswith(F.col("wider")))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.col("partition_key") != F.col("named"), "partition_key", "seq"))
    return hits.withColumn("best", best).filter("best = 1").select("id", "embedding")


def group_by_centroids(vectors: DataFrame, threshold: float) -> DataFrame:
    """(group_id, id): ids ascending join the most similar centroid at or above the threshold, else found a group.

    The rule is sequential, so one task reads the sorted rows as a stream; it holds the centroids and one batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Centroids(threshold)
        for b in batches:
            found = [(state.add(np.asarray(v, np.float64)) if v is not None else None) for v in b["embedding"]]
            got = pd.DataFrame({"group_id": pd.array(found, "Int64"), "id": b["id"]}).dropna()
            yield got.astype({"group_id": "int64", "id": "int64"})

    ordered = vectors.select("id", "embedding").dropDuplicates(["id"]).repartition(1).sortWithinPartitions("id")
    return ordered.mapInPandas(run, "group_id long, id long")


def grouped_ids(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.sort_array(F.collect_list("id")).alias("ids"))
