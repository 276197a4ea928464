"""A catalog of files as a DataFrame."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CATALOG = "file_path string, node_id string, file_size long, modified_time long, created_time long, metadata string, last_scanned_time long"
# Folders that a scan passes by. Give a database's own data folder with `exclude` too.
EXCLUDED = (".git", "$RECYCLE.BIN", "System Volume Information")
BATCH = 10_000


def scan(spark: SparkSession, root: str, node_id: str = "local", exclude: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Every file below a local root, hidden ones and excluded folders left out; entries that can't be read are skipped.

    The top folders are listed on the driver, the trees below them in tasks.
    """
    root = os.path.abspath(root)
    skip = lambda name: name.startswith(".") or name in exclude
    with os.scandir(root) as entries:
        tops = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in entries if not skip(e.name))
    now = int(time.time() * 1000)

    def rows_of(top: str, is_dir: bool):
        def one(path: str):
            try:
                s = os.stat(path)
            except OSError:
                return None
            name, parent = os.path.basename(path), os.path.dirname(path)
            meta = json.dumps({"name": name, "extension": os.path.splitext(name)[1], "size": s.st_size, "lastModified": int(s.st_mtime * 1000), "parentDir": parent})
            return (path, node_id, s.st_size, int(s.st_mtime * 1000), int(s.st_ctime * 1000), meta, now)

        start = os.path.join(root, top)
        if not is_dir:
            return [x for x in [one(start)] if x]
        found = []
        for folder, folders, names in os.walk(start, onerror=lambda _: None):
            folders[:] = [f for f in folders if not skip(f)]
            found += [x for n in names if not skip(n) and (x := one(os.path.join(folder, n)))]
        return found

    def run(batches):
        import pandas as pd

        for b in batches:
            for top, is_dir in zip(b["top"], b["is_dir"], strict=True):
                got = rows_of(top, is_dir)
                for at in range(0, len(got), BATCH):
                    yield pd.DataFrame(got[at : at + BATCH], columns=[x.split()[0] for x in CATALOG.split(", ")])

    if not tops:
        return spark.createDataFrame([], CATALOG)
    return spark.createDataFrame(tops, "top string, is_dir boolean").repartition(min(len(tops), 64)).mapInPandas(run, CATALOG)


def upsert(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """The catalog with files put in or replaced by (file_path, node_id)."""
    newest = files.dropDuplicates(["file_path", "node_id"])
    return catalog.join(newest, ["file_path", "node_id"], "left_anti").unionByName(newest)


def remove(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    return catalog.join(gone.select("file_path", "node_id"), ["file_path", "node_id"], "left_anti")


def update_metadata(catalog: DataFrame, path: str, node_id: str, metadata: str) -> DataFrame:
    here = (F.col("file_path") == path) & (F.col("node_id") == node_id)
    return catalog.withColumn("metadata", F.when(here, F.lit(metadata)).otherwise(F.col("metadata")))


def by_path(catalog: DataFrame, part: str, path: str = "file_path", node: str = "node_id") -> DataFrame:
    """Paths LIKE %part%, whatever the case, by node and path; % and _ in part are wild."""
    return catalog.filter(F.col(path).ilike(f"%{part}%")).orderBy(node, path)


def by_node(catalog: DataFrame, node_id: str) -> DataFrame:
    return catalog.filter(F.col("node_id") == node_id).orderBy("file_path")


def build_index(catalog: DataFrame) -> DataFrame:
    """(file_id, file_path): ordinals by path, from sorted ranges and their sizes rather than in one task."""
    sorted_rows = catalog.select("file_path").distinct().withColumn("head", F.substring("file_path", 1, 48))
    sizes = sorted_rows.groupBy("head").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(W.partitionBy("head").orderBy("file_path")) - 1
    return sorted_rows.withColumn("i", within).join(sizes.select("head", before.alias("before")), "head").select((F.col("before") + F.col("i")).alias("file_id"), "file_path")


def query_index(index: DataFrame, part: str) -> DataFrame:
    return index.filter(F.contains("file_path", F.lit(part))).select("file_id")


def name_matches(path: Column, patterns: list[str]) -> Column:
    """Whether a file's name begins with a match of any pattern, whatever the case."""
    name = F.element_at(F.split(path, "/"), -1)
    return name.rlike("(?i)^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")") if patterns else F.lit(True)
