"""Approximate search: inverted lists around k-means centres."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.vectors import distances
from .search import batch_knn

#: Vectors that centres are fitted on, at most; every vector is indexed.
SAMPLE_ROWS = 50_000


def fit_centres(vectors: DataFrame, lists: int = 64, rounds: int = 8, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Lloyd's k-means over a bounded sample, chosen by a hash of the id."""
    rows = vectors.select("embedding").orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    x = np.array([r[0] for r in rows], np.float64)
    centres = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        own = distances("l2", x, centres).argmin(axis=1)
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vectors with ivf_list, the nearest centre; write it partitioned by ivf_list and a search reads its lists only."""
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(distances("l2", np.stack(v).astype(np.float64), held.value).argmin(axis=1)) if len(v) else pd.Series([], dtype="int32")

    return vectors.withColumn("ivf_list", nearest("embedding"))


def ivf_knn(indexed: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = 8, space: str = "l2") -> DataFrame:
    """The k nearest in the `probes` lists nearest to the query."""
    near = distances("l2", centres, np.array([query], np.float64))[:, 0].argsort(kind="stable")[:probes]
    return batch_knn(indexed.filter(F.col("ivf_list").isin(*[int(i) for i in near])), [(0, query)], k, space)


def ivf_batch(indexed: DataFrame, centres: np.ndarray, queries: Sequence[tuple[int, Sequence[float]]], k: int, probes: int = 8, space: str = "l2") -> DataFrame:
    """(query_id, id, distance, place): each query against its `probes` lists, a list's vectors against the queries that probe it."""
    q = np.array([x for _, x in queries], np.float64)
    ids = np.array([i for i, _ in queries], np.int64)
    near = distances("l2", q, centres).argsort(axis=1, kind="stable")[:, :probes]
    indexed = indexed.filter(F.col("ivf_list").isin(*np.unique(near).tolist()))  # a stored index is read by these folders only
    held = indexed.sparkSession.sparkContext.broadcast((q, ids, near))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, ids, near = held.value
        for b in batches:
            lists = b["ivf_list"].to_numpy()
            for c in np.unique(lists):
                asking = np.flatnonzero((near == c).any(axis=1))
                if not len(asking):
                    continue
                own = b[lists == c]
                d = distances(space, np.stack(own["embedding"].to_numpy()).astype(np.float64), q[asking])
                bound = np.partition(d, min(k, len(own)) - 1, axis=0)[min(k, len(own)) - 1]
                row, i = np.nonzero(d <= bound[None, :])
                yield pd.DataFrame({"query_id": ids[asking[i]], "id": own["id"].to_numpy()[row], "distance": d[row, i]})

    found = indexed.select("id", "embedding", "ivf_list").mapInPandas(run, "query_id long, id long, distance double")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= k)


def recall(indexed: DataFrame, centres: np.ndarray, queries: Sequence[tuple[int, Sequence[float]]], exact: DataFrame, k: int, probes: int = 8) -> DataFrame:
    """(queries, found, wanted, recall, read_part) of the lists against an exact result (query_id, id).

    read_part: the part of all vectors that a query's lists hold, on average.
    """
    near = distances("l2", np.array([x for _, x in queries], np.float64), centres).argsort(axis=1, kind="stable")[:, :probes]
    sizes = {r["ivf_list"]: r["n"] for r in indexed.groupBy("ivf_list").agg(F.count("*").alias("n")).collect()}
    read = sum(sizes.get(int(c), 0) for c in near.ravel()) / max(1, len(near) * sum(sizes.values()))
    got = ivf_batch(indexed, centres, queries, k, probes).select("query_id", "id", F.lit(1).alias("hit"))
    both = exact.join(got, ["query_id", "id"], "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("hit").alias("found"), F.count("*").alias("wanted"), (F.count("hit") / F.count("*")).alias("recall"), F.lit(read).alias("read_part"))
