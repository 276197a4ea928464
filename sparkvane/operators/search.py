"""Similarity search over flat and partitioned vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.timebucket import name_of
from ..functions.vectors import distance, distances, score
from .dedup import dedup

RESULT = ("id", "score", "chunk", "partition_key", "ts_ms")


def checked_query(query: Sequence[float], dimension: int | None, k: int) -> list[float]:
    query = [float(x) for x in query]
    if k <= 0:
        raise ValueError("k must be above 0")
    if dimension is not None and len(query) != dimension:
        raise ValueError(f"the query has {len(query)} components, not {dimension}")
    return query


def flat_knn(vectors: DataFrame, query: Sequence[float], k: int, space: str = "l2", where: Column | None = None) -> DataFrame:
    """The k nearest by distance, then id: (id, distance, score, chunk)."""
    checked_query(query, None, k)
    rows = vectors if where is None else vectors.filter(where)
    text = F.col("chunk") if "chunk" in vectors.columns else F.lit("")
    found = rows.select("id", distance(space, F.col("embedding"), query).alias("distance"), text.alias("chunk"))
    return found.orderBy("distance", "id").limit(k).select("id", "distance", score(F.col("distance")).alias("score"), "chunk")


def without_deleted(vectors: DataFrame, deleted: DataFrame) -> DataFrame:
    return vectors.join(deleted.select("id"), "id", "left_anti")


def time_filter(ts_start: int = 0, ts_end: int = 0) -> Column:
    """Rows within a range, ends included; a bound of 0 or less is open, a row without time always passes."""
    keep = F.lit(True)
    if ts_start > 0:
        keep &= F.col("ts_ms") >= ts_start
    if ts_end > 0:
        keep &= F.col("ts_ms") <= ts_end
    return (F.col("ts_ms") == 0) | keep


def resolve_tags(tags: DataFrame, wanted: Sequence[str] | None, compat_unknown_tag: bool = False) -> list[int] | None:
    """Indexes of tags; None is every partition. Unknown tags match nothing; with compat, all unknown match everything."""
    if not wanted:
        return None
    rows = tags.filter(F.col("tag").isin(*wanted)).select("custom_index").distinct().collect()
    found = sorted(r[0] for r in rows)
    return None if compat_unknown_tag and not found else found


def partitioned_lookup(
    routed: DataFrame, query: Sequence[float], k: int, *, space: str = "l2", indexes: list[int] | None = None, ts_start: int = 0, ts_end: int = 0,
    dedup_threshold: float = 0.0, dedup_scope: str = "bucket", mode: str = "exact", granularity: str = "hourly",
) -> DataFrame:
    """The best k over the buckets that a time range and tags leave, by score and id.

    Each bucket gives its k nearest, near duplicates are dropped in each bucket, or with dedup_scope="global" over all,
    and the best k of what is left are the result. mode="exact" filters by time before a bucket's k are taken,
    mode="reference" behind, so that fewer than k rows may come back.
    """
    checked_query(query, None, k)
    rows = routed
    if indexes is not None:
        rows = rows.filter(F.col("custom_index").isin(*indexes) if indexes else F.lit(False))
    if ts_start > 0 or ts_end > 0:
        low = name_of(ts_start, granularity) if ts_start > 0 else ""
        high = name_of(ts_end, granularity) if ts_end > 0 else "9999"
        rows = rows.filter(F.col("ts_partition").between(low, high) | (F.col("ts_partition") == "default"))
        if mode == "exact":
            rows = rows.filter(time_filter(ts_start, ts_end))
    rows = rows.withColumn("distance", distance(space, F.col("embedding"), query))
    near = rows.withColumn("place", F.row_number().over(W.partitionBy("partition_key").orderBy("distance", "id"))).filter(F.col("place") <= k)
    near = near.withColumn("score", score(F.col("distance")))
    if dedup_threshold > 0:
        near = dedup(near, dedup_threshold, ["partition_key"] if dedup_scope == "bucket" else [])
    if mode == "reference":
        near = near.filter(time_filter(ts_start, ts_end))
    return near.orderBy(F.desc("score"), "id").limit(k).select(*RESULT)


def batch_knn(vectors: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, space: str = "l2") -> DataFrame:
    """(query_id, id, distance, place) of the k nearest vectors for each query.

    The queries, as many as the driver sends, go out once; each Arrow batch yields its own k nearest for each query by
    one matrix product, so the shuffle carries k rows a batch and query and no vector.
    """
    ids = np.array([i for i, _ in queries], np.int64)
    held = vectors.sparkSession.sparkContext.broadcast(np.array([q for _, q in queries], np.float64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            d = distances(space, np.stack(b["embedding"].to_numpy()).astype(np.float64), held.value)
            own = b["id"].to_numpy()
            part = min(k, len(b))
            # A tie at the k-th place must go by id, so everything up to that distance stays.
            bound = np.partition(d, part - 1, axis=0)[part - 1]
            row, q = np.nonzero(d <= bound[None, :])
            yield pd.DataFrame({"query_id": ids[q], "id": own[row], "distance": d[row, q]})

    found = vectors.select("id", "embedding").mapInPandas(run, "query_id long, id long, distance double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def range_search(vectors: DataFrame, query: Sequence[float], epsilon: float, space: str = "l2", most: int | None = None) -> DataFrame:
    found = vectors.select("id", distance(space, F.col("embedding"), query).alias("distance")).filter(F.col("distance") <= epsilon)
    return found.orderBy("distance", "id").limit(most) if most else found


def multivector_search(vectors: DataFrame, query: Sequence[float], n_docs: int, space: str = "l2", doc: str = "doc_id") -> DataFrame:
    """The n documents whose nearest vector is nearest, and their vectors up to the last one's first hit."""
    d = vectors.select(doc, "id", distance(space, F.col("embedding"), query).alias("distance"))
    docs = d.groupBy(doc).agg(F.min("distance").alias("doc_distance")).orderBy("doc_distance", doc).limit(n_docs)
    worst = docs.agg(F.max("doc_distance").alias("worst"))
    return d.join(F.broadcast(docs), doc).crossJoin(F.broadcast(worst)).filter(F.col("distance") <= F.col("worst")).select(doc, "id", "distance", "doc_distance")


def pairwise_extremes(vectors: DataFrame, block: int = 4096) -> DataFrame:
    """The least and largest squared L2 distance of two different rows, by blocks of rows against blocks of rows."""
    n = max(1, -(-vectors.count() // block))
    placed = vectors.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(n)).alias("b"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    down = placed.select("id", "embedding", F.col("b").alias("i"), every.alias("j"), F.lit(True).alias("own")).filter("i <= j")
    across = placed.select("id", "embedding", every.alias("i"), F.col("b").alias("j"), F.lit(False).alias("own")).filter("i <= j")

    def run(t: pd.DataFrame) -> pd.DataFrame:
        a, b = t[t.own], t[~t.own]
        if not len(a) or not len(b):
            return pd.DataFrame({"low": [], "high": []}, dtype="float64")
        d = distances("l2", np.stack(a.embedding).astype(np.float64), np.stack(b.embedding).astype(np.float64))
        other = a.id.to_numpy()[:, None] != b.id.to_numpy()[None, :]
        return pd.DataFrame({"low": [d[other].min()], "high": [d[other].max()]}) if other.any() else pd.DataFrame({"low": [], "high": []}, dtype="float64")

    found = down.union(across).groupBy("i", "j").applyInPandas(run, "low double, high double")
    return found.agg(F.min("low").alias("min_distance"), F.max("high").alias("max_distance"))
