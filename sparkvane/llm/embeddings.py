"""Exact cosine range join by pivots.

Vectors of one direction in memory, equal ones taken once, go to the cell of their nearest pivot by angle. A vector y
within r of some vector of cell q has an angle to q's pivot of at most its angle to its own pivot plus 2 r, and of at
most the cell's radius plus r (triangle inequality); where both hold it is copied to q. Each cell then finds all
links of its own vectors without any other. A cell is cut into blocks of own vectors and blocks of members, so a task
holds two blocks whatever the cell's size; it returns sums of links and a star for each local component, not pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage
from .graph import components

THRESHOLD = 0.95
BLOCK = 8192
#: Vectors of one length for each pivot at least, and sampled vectors for each pivot to choose from.
VECTORS_A_PIVOT, SAMPLED_A_PIVOT = 4096, 32


def band(width: int) -> float:
    """Similarities of unit vectors in single precision are surely right when they are farther than this from a threshold:
    twice the bound of a sum's rounding errors. Nearer ones are computed again in double precision."""
    return 2 * (width + 4) * 2.0**-24


def _unit(values: np.ndarray) -> np.ndarray:
    """Unit vectors; by the largest component first, as the square of a large or small one would leave its range."""
    values = values / np.abs(values).max(axis=1, keepdims=True, initial=0)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def pivots_for(n: int) -> int:
    """A pivot for each VECTORS_A_PIVOT vectors, later with the square root of their number, so that finding the nearest
    pivot stays cheaper than joining a cell, and no number of vectors stops cells from getting more."""
    return max(1, min(n // VECTORS_A_PIVOT, math.isqrt(n) // 8))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first from the first vector."""
    picked, near = [0], sample @ sample[0]
    while len(picked) < min(count, len(sample)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[picked[-1]])
    return sample[picked]


def local_links(a: np.ndarray, b: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray, weight: np.ndarray, threshold: float):
    """Sums of weight over each a's links, and stars (node, centre) of the components of the links between a and b."""
    mask = np.empty((len(a), len(b)), bool)
    a32, b32, near = a.astype(np.float32), b.astype(np.float32).T, band(a.shape[1])
    for i in range(0, len(a), 1024):
        s = a32[i : i + 1024] @ b32
        m = s >= threshold
        x, y = np.nonzero(np.abs(s - threshold) < near)
        for k in range(0, len(x), 65536):
            xs, ys = x[k : k + 65536], y[k : k + 65536]
            m[xs, ys] = np.einsum("ij,ij->i", a[i + xs], b[ys]) >= threshold
        m &= ids_a[i : i + 1024, None] != ids_b[None, :]
        mask[i : i + 1024] = m
    sums = np.concatenate([mask[i : i + 1024] @ weight for i in range(0, len(a), 1024)]) if len(a) else np.zeros(0, np.int64)
    ra, rb = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    sub, la, lb = mask[np.ix_(ra, rb)], ids_a[ra].copy(), ids_b[rb].copy()
    big = np.iinfo(np.int64).max
    while len(ra):
        na = np.concatenate([np.where(sub[i : i + 512], lb, big).min(axis=1) for i in range(0, len(ra), 512)])
        na = np.minimum(la, na)
        nb = np.minimum(lb, np.concatenate([np.where(sub[:, j : j + 512], na[:, None], big).min(axis=0) for j in range(0, len(rb), 512)]))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    return sums, np.concatenate([ids_a[ra], ids_b[rb]]), np.concatenate([la, lb])


def range_join(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero, or hold null or non-finite components are alone, as are those whose length no
    other has. Equal vectors link, and rows that repeat a vec_id count as vectors of their own. Rows without vec_id are
    left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).filter("vec_id is not null")
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    is_sound = F.coalesce(F.col("e").isNotNull() & (F.size("e") > 0) & finite & F.exists("e", lambda x: x != 0), F.lit(False))
    keyed = rows.filter(is_sound).select("vec_id", "e", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2"))
    # rep stands for a vector, not for a vec_id: different vectors may have one vec_id.
    reps = keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e"))
    reps = stage(reps.withColumn("rep", F.monotonically_increasing_id()), "vectors")
    member = keyed.select("vec_id", "k1", "k2").join(reps.select("k1", "k2", "rep", "copies"), ["k1", "k2"]).select("vec_id", "rep", "copies")

    found_links, found_sums = _links(spark, reps, threshold, block)
    named = reps.select("rep", "least").join(components(found_links).withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("rep", "least", F.coalesce("component", "rep").alias("component"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(first, "component").select("rep", "component_id")
    whole = member.join(found_sums.groupBy("rep").agg(F.sum("n").alias("n")), "rep", "left").join(named, "rep")
    linked = whole.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    lone = rows.filter(~is_sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _links(spark, reps: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(a, b) links that keep the components, and (rep, n) sums of links.

    Vectors of another length never meet: a cell is named by length and pivot. Lengths with too few vectors for two
    pivots are one cell each, however many such lengths there are.
    """
    radius = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    reps = reps.withColumn("width", F.size("e"))
    large = {r["width"]: r["n"] for r in reps.groupBy("width").agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * VECTORS_A_PIVOT).collect()}
    pivots = {}
    if large:
        part = F.create_map(*[F.lit(x) for w, n in large.items() for x in (w, int(1_000_000 * min(1.0, SAMPLED_A_PIVOT * pivots_for(n) / n)) + 1)])
        sample = reps.filter(F.pmod("k1", F.lit(1_000_000)) < F.coalesce(F.element_at(part, F.col("width")), F.lit(0))).select("k1", "k2", "width", "e").collect()
        for w, n in large.items():
            rows = sorted((r["k1"], r["k2"], r["e"]) for r in sample if r["width"] == w)
            pivots[w] = choose_pivots(_unit(np.array([r[2] for r in rows], np.float64)), pivots_for(n)) if rows else None
    held = spark.sparkContext.broadcast({w: p for w, p in pivots.items() if p is not None})

    def angles(b: pa.RecordBatch):
        """(width, rows, angles to its pivots or None) for each length in a batch."""
        width = b.column("width").to_numpy()
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            of = held.value.get(w)
            if of is None:
                yield w, rows, None
                continue
            x = _unit(_matrix(b.column("e").take(pa.array(rows)), w))
            yield w, rows, np.arccos(np.clip(x @ of.T, -1, 1))

    def own_cells(batches):
        for b in batches:
            for w, rows, angle in angles(b):
                cell, least = (np.zeros(len(rows), np.int64), np.zeros(len(rows))) if angle is None else (angle.argmin(axis=1), angle.min(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), w), pa.int32()), pa.array(cell, pa.int64()), pa.array(least)], ["width", "cell", "angle"])

    some = reps.filter(F.col("width").isin(*held.value)) if held.value else reps.limit(0)
    wide: dict[tuple[int, int], float] = {
        (r["width"], r["cell"]): r["radius"] for r in some.select("width", "e").mapInArrow(own_cells, "width int, cell long, angle double").groupBy("width", "cell").agg(F.max("angle").alias("radius")).collect()
    }

    def to_cells(batches):
        for b in batches:
            for w, rows, angle in angles(b):
                if angle is None:
                    v, c, home = np.arange(len(rows)), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
                else:
                    reach = np.array([wide.get((w, q), -10.0) for q in range(angle.shape[1])])
                    home, own = angle.argmin(axis=1), angle.min(axis=1)
                    goes = (angle <= own[:, None] + 2 * radius) & (angle <= reach[None, :] + radius)
                    goes[np.arange(len(home)), home] = True
                    v, c = np.nonzero(goes)
                yield pa.RecordBatch.from_arrays([b.column("rep").take(pa.array(rows[v])), pa.array(np.full(len(v), w), pa.int32()), pa.array(c, pa.int64()), pa.array(home[v] == c)], ["rep", "width", "cell", "home"])

    placed = stage(reps.select("rep", "width", "e").mapInArrow(to_cells, "rep long, width int, cell long, home boolean"), "cells")
    key = ["width", "cell"]
    counts = placed.groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("own"), F.count("*").alias("members"))
    counts = counts.select(*key, F.greatest(F.ceil(F.col("own") / block), F.lit(1)).alias("rows"), F.ceil(F.col("members") / block).alias("across"))
    sized = placed.join(counts, key)
    slot = lambda k: F.pmod(F.xxhash64("rep"), F.col(k))
    upto = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    mine = sized.filter("home").select("rep", *key, slot("rows").alias("i"), upto("across").alias("j"), F.lit(True).alias("own"))
    theirs = sized.select("rep", *key, upto("rows").alias("i"), slot("across").alias("j"), F.lit(False).alias("own"))
    dealt = mine.union(theirs).join(reps.select("rep", "copies", "e"), "rep")

    def join_blocks(key, t):
        t, width = t.combine_chunks(), key[0].as_py()
        own = t.column("own").to_numpy(zero_copy_only=False).astype(bool)
        ids, weight = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        x = _unit(_matrix(t.column("e").chunk(0), width)) if t.num_rows else np.zeros((0, width))
        sums, nodes, centres = local_links(x[own], x[~own], ids[own], ids[~own], weight[~own], threshold)
        some = np.flatnonzero(sums)
        out = pd.DataFrame({
            "a": np.concatenate([ids[own][some], nodes]), "b": np.concatenate([np.full(len(some), -1), centres]),
            "n": np.concatenate([sums[some], np.zeros(len(nodes), np.int64)]), "link": np.r_[np.zeros(len(some), bool), np.ones(len(nodes), bool)],
        }).astype({"a": "int64", "b": "int64", "n": "int64", "link": "bool"})
        return pa.Table.from_pandas(out, preserve_index=False)

    joined = stage(dealt.groupBy(*key, "i", "j").applyInArrow(join_blocks, "a long, b long, n long, link boolean"), "cell-links")
    drop_stage(placed)
    return joined.filter("link").select("a", "b"), joined.filter("not link").select(F.col("a").alias("rep"), "n")
