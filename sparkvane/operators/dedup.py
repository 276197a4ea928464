"""Greedy suppression of near duplicates among a few results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keep_distinct(vectors: list, threshold: float) -> list[int]:
    """Indexes kept, walking in order: one goes when its cosine with an earlier kept one is the threshold or more."""
    if threshold <= 0 or len(vectors) < 2:
        return list(range(len(vectors)))
    kept: list[int] = []
    units: list[np.ndarray] = []
    for i, v in enumerate(vectors):
        v = np.zeros(0) if v is None else np.asarray(v, np.float64)
        length = float(np.sqrt((v * v).sum()))
        unit = v / length if length else np.zeros_like(v)
        if len(v) and any(len(u) == len(unit) and float((u * unit).sum()) >= threshold for u in units):
            continue
        kept.append(i)
        units.append(unit)
    return kept


def dedup(results: DataFrame, threshold: float, scope: list[str]) -> DataFrame:
    """results (id, score, embedding, ...) without near duplicates of better ones in each scope.

    A scope holds what top-k selection left, so a group is as small as k times its buckets.
    """
    keys = scope or ["scope"]
    rows = results if scope else results.withColumn("scope", F.lit(0))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        return t.iloc[keep_distinct(list(t.embedding), threshold)]

    found = rows.groupBy(*keys).applyInPandas(run, rows.schema)
    return found if scope else found.drop("scope")
