"""The databases: FlatDB, one set of vectors, and PartitionedDB, vectors by time, tag and capacity in a folder of Parquet."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import threading
import time
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.timebucket import bucket_name
from .operators import labels as _labels
from .operators import search as _search
from .operators.grouping import group_by_centroids, grouped_ids, resolve_vectors
from .operators.tracker import Scene
from .plans import catalog
from .plans.config import DEFAULT_TAG, DbConfig, checked_prefix
from .sources import wal


def _rows(ids, vectors, dimension: int, chunks) -> pd.DataFrame:
    """What add_vectors was given as one row per vector."""
    if isinstance(vectors, (list, tuple)) and vectors and isinstance(vectors[0], (list, tuple, np.ndarray)):
        flat = np.concatenate([np.asarray(v, np.float32).ravel() for v in vectors])
    else:
        flat = np.asarray(vectors, np.float32).ravel()
    if not flat.size or flat.size % dimension:
        raise ValueError(f"{flat.size} numbers are no vectors of {dimension}")
    n = flat.size // dimension
    if isinstance(ids, (int, np.integer)):
        ids = range(int(ids), int(ids) + n)
    ids = [int(i) for i in ids]
    if len(ids) != n or min(ids) < 0:
        raise ValueError(f"{n} vectors need {n} ids of 0 or more, not {len(ids)}")
    if chunks is None or isinstance(chunks, (str, dict)):
        chunks = [chunks or ""] * n
    chunks = [c.get("chunk", "") if isinstance(c, dict) else str(c) for c in chunks]
    if len(chunks) != n:
        raise ValueError(f"{n} vectors need {n} chunks, not {len(chunks)}")
    return pd.DataFrame({"id": ids, "embedding": list(flat.reshape(n, dimension)), "chunk": chunks})


def _frame(spark: SparkSession, rows: pd.DataFrame) -> DataFrame:
    """The rows as a DataFrame, by Arrow."""
    vectors = pa.array([v.tolist() for v in rows["embedding"]], pa.list_(pa.float32()))
    text = lambda name: pa.array(rows[name].tolist(), pa.string())
    number = lambda name: pa.array(rows[name].tolist(), pa.int64())
    return spark.createDataFrame(pa.table({"id": number("id"), "embedding": vectors, "chunk": text("chunk"), "ts_ms": number("ts_ms"), "tag": text("tag"), "seq": number("seq")}))


class FlatDB:
    def __init__(self, spark: SparkSession, dimension: int = 1024, max_elements: int = 1_000_000, space: str = "l2"):
        self.spark, self.config = spark, DbConfig(dimension=dimension, max_elements=max_elements, space=space)
        self.vectors: DataFrame | None = None
        self.size = 0

    def add_vectors(self, ids, vectors, chunks=None, num_threads: int = -1) -> int:
        """Adds vectors and gives the last id; an int for ids numbers on from it."""
        rows = _rows(ids, vectors, self.config.dimension, chunks)
        if self.size + len(rows) > self.config.max_elements:
            raise ValueError("the database is full")
        rows = rows.assign(ts_ms=0, tag=DEFAULT_TAG, seq=range(self.size, self.size + len(rows)))
        new = _frame(self.spark, rows)
        self.vectors = new if self.vectors is None else self.vectors.union(new)
        self.size += len(rows)
        return int(rows["id"].iloc[-1])

    def lookup(self, query: Sequence[float], k: int = 1) -> list[list]:
        """[id, score, chunk] by distance."""
        query = _search.checked_query(query, self.config.dimension, k)
        if self.vectors is None:
            return []
        newest = _labels.first_vector_last_label(self.vectors).select("id", F.col("chunk").alias("newest"))
        found = _search.flat_knn(self.vectors, query, k, self.config.space).join(newest, "id").orderBy("distance", "id")
        return [[r["id"], r["score"], r["newest"]] for r in found.collect()]

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, path: str) -> None:
        """Writes beside the path, then swaps, so that a loaded table may be saved over itself and a crash loses nothing."""
        if self.vectors is None:
            return
        path = path.rstrip("/")
        self.vectors.write.mode("overwrite").parquet(f"{path}.new")
        (fs, here), (_, new), (_, old) = self._path(path), self._path(f"{path}.new"), self._path(f"{path}.old")
        fs.delete(old, True)
        if fs.exists(here):
            fs.rename(here, old)
        fs.rename(new, here)
        self.load(path)
        fs.delete(old, True)

    def load(self, path: str) -> FlatDB:
        """Reads what was saved; after a crash between the steps of a swap, the table that was there before."""
        path = path.rstrip("/")
        (fs, here), (_, old) = self._path(path), self._path(f"{path}.old")
        if not fs.exists(here) and fs.exists(old):
            fs.rename(old, here)
        self.vectors = self.spark.read.parquet(path)
        self.size = self.vectors.count()
        return self


_OPEN: dict[tuple[str, str], PartitionedDB] = {}
_LOCKS: dict[str, threading.Lock] = defaultdict(threading.Lock)


def partitioned_db(spark: SparkSession, path: str = ".", prefix: str = "vdb", **options) -> PartitionedDB:
    """The open database of a folder and name, or a new one."""
    key = (path if "://" in path else os.path.abspath(path), prefix)
    if key not in _OPEN:
        _OPEN[key] = PartitionedDB(spark, path, prefix, **options)
    return _OPEN[key]


class PartitionedDB:
    """Vectors in `<path>/<prefix>/vectors`, one folder a batch, so that a batch written again replaces itself.

    Beside them `manifest` has a row for each bucket of a batch: bounds, size and last arrival. Bounds, listings and what a
    new batch must know come from there, so storing a batch reads no stored vector. A batch is visible once its manifest
    is written; one process writes at a time, under a lock that a process which died leaves for LOCK_MS at most.
    """

    LOCK_MS = 600_000

    def __init__(self, spark: SparkSession, path: str = ".", prefix: str = "vdb", **options):
        self.spark, self.base, self.prefix = spark, path, checked_prefix(prefix)
        self.root = f"{path.rstrip('/')}/{prefix}"
        self.config = DbConfig.merged(self._read("config"), options)
        self._write("config", self.config.to_dict())
        self.closed = False
        self.error: str | None = None
        self.recover()

    # Small state as text files through Spark's file systems.
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, name: str):
        fs, p = self._fs(f"{self.root}/{name}.json")
        if not fs.exists(p):
            return None
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/{name}.json", wholetext=True).collect()))

    def _write(self, name: str, value) -> None:
        fs, p = self._fs(f"{self.root}/{name}.json")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _opened(self) -> None:
        if self.closed:
            raise RuntimeError("the database is closed")
        if self.error:
            raise RuntimeError(self.error)

    @property
    def tags(self) -> DataFrame:
        rows = self._read("tags") or [[0, DEFAULT_TAG]]
        return self.spark.createDataFrame([tuple(r) for r in rows], "custom_index int, tag string")

    def _batches(self, kind: str) -> list[str]:
        """Names of the batches whose `vectors` or `manifest` are written to the end."""
        fs, p = self._fs(f"{self.root}/{kind}")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        done = [n for n in names if n.startswith("batch=") and fs.exists(self._fs(f"{self.root}/{kind}/{n}/_SUCCESS")[1])]
        return sorted(n.removeprefix("batch=") for n in done)

    def recover(self) -> list[str]:
        """Ends a compaction that was cut short and writes the manifests of batches that were stored but not entered, as
        after a crash; gives their names."""
        self._end_compaction()
        missing = sorted(set(self._batches("vectors")) - set(self._batches("manifest")))
        for batch in missing:
            self._enter(batch)
        return missing

    def _enter(self, batch: str) -> None:
        rows = self.spark.read.schema(self.STORED).parquet(f"{self.root}/vectors/batch={batch}")
        rows = catalog.manifest(rows, F.max("seq").alias("last_seq"))
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")

    @contextlib.contextmanager
    def _writing(self):
        """The only writer of this folder meanwhile; other threads of this process wait, other processes are refused."""
        with _LOCKS[self.root]:
            with self._locked():
                yield

    @contextlib.contextmanager
    def _locked(self):
        fs, p = self._fs(f"{self.root}/writer.lock")
        if not fs.createNewFile(p):
            if time.time() * 1000 - fs.getFileStatus(p).getModificationTime() < self.LOCK_MS:
                raise BlockingIOError(f"another process writes to {self.root}")
            fs.delete(p, False)
            if not fs.createNewFile(p):
                raise BlockingIOError(f"another process writes to {self.root}")
        try:
            yield
        finally:
            fs.delete(p, False)

    STORED = "id long, embedding array<float>, chunk string, ts_ms long, tag string, seq long, partition_key string, ts_partition string, custom_index int, bucket_number int"

    @property
    def routed(self) -> DataFrame | None:
        """The stored vectors; filters on ts_partition, custom_index and bucket_number choose folders."""
        names = self._batches("manifest")
        if not names:
            return None
        read = self.spark.read.option("basePath", f"{self.root}/vectors").schema(self.STORED + ", batch string")
        return read.parquet(*[f"{self.root}/vectors/batch={n}" for n in names])

    @property
    def entered(self) -> DataFrame | None:
        """The manifest's rows by batch."""
        if not self._batches("manifest"):
            return None
        return self.spark.read.schema(
            "partition_key string, ts_partition string, custom_index int, bucket_number int, ts_start long, ts_end long, element_count long, last_seq long, batch string"
        ).parquet(f"{self.root}/manifest")

    @property
    def manifest(self) -> DataFrame | None:
        rows = self.entered
        return None if rows is None else rows.groupBy("partition_key", "ts_partition", "custom_index", "bucket_number").agg(
            F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"), F.sum("element_count").alias("element_count")
        )

    def add_batch(self, rows: DataFrame, batch: str) -> int:
        """Stores rows (id, embedding, chunk, ts_ms, tag and, if any, seq) under a batch's name, replacing what it held.

        Only the manifest is read of what is stored. A batch of bad rows raises and stores nothing.
        """
        self._opened()
        try:
            with self._writing():
                return self._add(rows, batch)
        except (ValueError, BlockingIOError):
            raise
        except Exception as e:
            self.error = str(e)
            raise

    def clear_error(self) -> None:
        """Lets a database be used again after an engine error; batches half written are not entered, so not seen."""
        self.error = None
        self.recover()

    def _add(self, rows: DataFrame, batch: str) -> int:
        entered = self.entered
        others = None if entered is None else entered.filter(F.col("batch") != batch)
        offset = 0 if others is None else others.agg(F.coalesce(F.max("last_seq") + 1, F.lit(0))).first()[0]
        seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
        plain = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"), F.coalesce("chunk", F.lit("")).alias("chunk"), F.coalesce("ts_ms", F.lit(0)).cast("long").alias("ts_ms"), F.coalesce("tag", F.lit(DEFAULT_TAG)).alias("tag"), (seq + F.lit(offset)).alias("seq"))
        plain = plain.persist()
        try:
            wrong = F.coalesce((F.size("embedding") != self.config.dimension) | (F.col("id") < 0), F.lit(True))
            told = plain.agg(F.count("*").alias("n"), F.count_if(wrong).alias("wrong")).first()
            if told["wrong"]:
                raise ValueError(f"a row's vector isn't of {self.config.dimension} components, or its id is below 0")
            tags = catalog.with_new_tags(self.tags, plain)
            self._write("tags", sorted([r[0], r[1]] for r in tags.select("custom_index", "tag").collect()))
            filled = None if others is None else others.groupBy("ts_partition", "custom_index").agg(F.sum("element_count").alias("held"))
            routed = catalog.route(plain, self.tags, self.config.granularity, self.config.max_elements, filled)
            fs, p = self._fs(f"{self.root}/manifest/batch={batch}")
            fs.delete(p, True)
            routed.repartition("ts_partition", "custom_index", "bucket_number").write.mode("overwrite").partitionBy("ts_partition", "custom_index", "bucket_number").parquet(f"{self.root}/vectors/batch={batch}")
            self._enter(batch)
            return told["n"]
        finally:
            plain.unpersist()

    def import_logs(self, path: str) -> int:
        """Stores the records of all logs below a path as one batch and removes the logs; 0 without any.

        The batch is named by the logs' names, so a run that died before it removed them replaces its rows. A log that ends
        early raises, and all logs stay.
        """
        found = wal.read(self.spark, path, self.config.dimension)
        names = [r[0] for r in found.select("log").distinct().orderBy("log").collect()]
        if not names:
            return 0
        starts, at = {}, 0
        for r in found.groupBy("log").agg(F.count("*").alias("n")).orderBy("log").collect():
            starts[r["log"]], at = at, at + r["n"]
        begin = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("log"))
        rows = found.withColumn("seq", (begin + F.col("place")).cast("long"))
        n = self.add_batch(rows, "logs-" + hashlib.sha256("\n".join(names).encode()).hexdigest()[:16])
        fs, _ = self._fs(path)
        for r in found.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect():
            fs.delete(self._fs(r["path"])[1], False)
        return n

    def expire(self, now_ms: int | None = None) -> int:
        """Removes the buckets whose newest row is older than the time to live; rows without time stay. Gives their rows."""
        self._opened()
        if self.config.ttl_minutes <= 0 or self.entered is None:
            return 0
        least = int(time.time() * 1000 if now_ms is None else now_ms) - self.config.ttl_minutes * 60_000
        with self._writing():
            old = self.manifest.filter((F.col("ts_end") > 0) & (F.col("ts_end") < least)).select("partition_key")
            gone = self.entered.join(old, "partition_key", "left_semi").collect()
            for r in gone:
                fs, p = self._fs(f"{self.root}/vectors/batch={r['batch']}/ts_partition={r['ts_partition']}/custom_index={r['custom_index']}/bucket_number={r['bucket_number']}")
                fs.delete(p, True)
            for batch in {r["batch"] for r in gone}:
                self._enter(batch)
        return sum(r["element_count"] for r in gone)

    def compact(self, name: str | None = None) -> int:
        """Writes all batches' rows as one batch with a file for each bucket; gives how many batches went."""
        self._opened()
        before = self._batches("manifest")
        if len(before) < 2:
            return 0
        with self._writing():
            name = name or f"compact-{int(time.time() * 1000):015d}"
            keys = ["ts_partition", "custom_index", "bucket_number"]
            self.routed.drop("batch").repartition(*keys).sortWithinPartitions(*keys, "seq").write.partitionBy(*keys).parquet(f"{self.root}/new/batch={name}")
            self._write("compacting", {"new": name, "old": before})
            self._end_compaction()
        return len(before)

    def _end_compaction(self) -> None:
        """Puts a finished new batch in the place of the old ones. Each step may be done again after a crash, and the old
        batches are no longer entered when the new one comes, so no row is seen twice."""
        plan = self._read("compacting")
        if not plan:
            return
        at = lambda name: self._fs(f"{self.root}/{name}")[1]
        fs, new = self._fs(f"{self.root}/new/batch={plan['new']}")
        for b in plan["old"]:
            fs.delete(at(f"manifest/batch={b}"), True)
        if fs.exists(new):
            fs.rename(new, at(f"vectors/batch={plan['new']}"))
        for b in plan["old"]:
            fs.delete(at(f"vectors/batch={b}"), True)
        self._enter(plan["new"])
        fs.delete(at("compacting.json"), False)

    def add_vectors(self, ids, vectors, timestamp: int = 0, partition: str = DEFAULT_TAG, chunks=None, num_threads: int = -1) -> int:
        """Adds vectors of one time and tag and gives the last id."""
        self._opened()
        rows = _rows(ids, vectors, self.config.dimension, chunks).assign(ts_ms=int(timestamp), tag=partition)
        rows["seq"] = range(len(rows))
        with self._writing():
            number = (self._read("batches") or 0) + 1
            self._write("batches", number)
        self.add_batch(_frame(self.spark, rows), f"call-{number:012d}")
        return int(rows["id"].iloc[-1])

    def lookup(self, query: Sequence[float], k: int = 1, *, partition: str | None = None, partitions: Sequence[str] = (), ts_start: int = 0, ts_end: int = 0, dedup: float = 0.0, mode: str = "exact", dedup_scope: str = "bucket", compat_unknown_tag: bool = False) -> DataFrame | None:
        """(id, score, chunk, partition_key, ts_ms) by score; None for a query of another dimension."""
        self._opened()
        if k <= 0:
            raise ValueError("k must be above 0")
        if len(query) != self.config.dimension:
            return None
        rows = self.routed
        if rows is None:
            return self.spark.createDataFrame([], "id long, score double, chunk string, partition_key string, ts_ms long")
        wanted = [*([partition] if partition else []), *([partitions] if isinstance(partitions, str) else partitions)]
        indexes = _search.resolve_tags(self.tags, wanted, compat_unknown_tag)
        return _search.partitioned_lookup(rows, query, k, space=self.config.space, indexes=indexes, ts_start=ts_start, ts_end=ts_end, dedup_threshold=dedup, dedup_scope=dedup_scope, mode=mode, granularity=self.config.granularity)

    def add_partition_tag(self, index: int, tag: str) -> bool:
        """Names an index once more; False if there is no such index or the tag is taken."""
        rows = [tuple(r) for r in self.tags.collect()]
        if index not in {i for i, _ in rows} or tag in {t for _, t in rows}:
            return False
        self._write("tags", [list(r) for r in rows] + [[index, tag]])
        return True

    def get_partition_info(self, tag: str) -> dict | None:
        row = catalog.partition_info(self.tags, tag).first()
        return None if row is None else {"custom_index": row["custom_index"], "tags": row["tags"].split(",")}

    def list_partitions(self) -> DataFrame:
        return catalog.list_partitions(self.manifest, self.tags).orderBy("partition_key")

    def query_label_by_id(self, id: int, partition: str | None = None, timestamp: int = 0) -> str | None:
        rows = self.routed
        indexes = _search.resolve_tags(self.tags, [partition] if partition else None)
        row = None if rows is None else _labels.label_by_id(rows, id, indexes=indexes, ts_ms=timestamp, granularity=self.config.granularity).first()
        return None if row is None else row["chunk"]

    def vector_by_id(self, id: int) -> list[float] | None:
        rows = self.routed
        row = None if rows is None else rows.filter(F.col("id") == id).orderBy("seq").select("embedding").first()
        return None if row is None else list(row[0])

    def grouping(self, items: DataFrame, threshold: float, id_key: str = "image_id", partition_key: str = "device_id", timestamp_key: str = "timestamp", full_partition_key: str = "") -> DataFrame:
        """(group_id, ids): items' vectors around running centroids."""
        timed = items.withColumn("time_bucket", bucket_name(F.col(timestamp_key).cast("long"), self.config.granularity)) if timestamp_key in items.columns else items
        return grouped_ids(group_by_centroids(resolve_vectors(timed, self.routed, id_key, partition_key, "time_bucket", full_partition_key, self.tags), threshold))

    def total_records(self) -> int:
        return self.get_health()["total_records"]

    def perform_full_scan(self) -> dict:
        rows = self.routed
        return {"vectors": 0, "buckets": 0, "partitions": 0, "wal_files": 0} if rows is None else catalog.full_scan(rows).first().asDict()

    def get_health(self) -> dict:
        """State and sizes, from the manifest. Batches are stored before a call returns, so nothing is ever pending."""
        m = self.manifest
        scan = {"n": 0, "buckets": 0, "times": 0} if m is None else m.agg(F.coalesce(F.sum("element_count"), F.lit(0)).alias("n"), F.count("*").alias("buckets"), F.countDistinct("ts_partition").alias("times")).first().asDict()
        return {
            "is_open": not self.closed, "has_error": self.error is not None, "error": self.error or "", "pending_tasks": 0, "pending_wals": 0, "wal_files": 0, "loaded_partitions": 0,
            "total_buckets": scan["buckets"], "total_partitions": scan["times"], "total_records": scan["n"], "max_elements": self.config.max_elements,
            "dimension": self.config.dimension, "granularity": self.config.granularity, "ttl_minutes": self.config.ttl_minutes,
        }

    def metrics(self) -> dict:
        return {k: v for k, v in self.get_health().items() if isinstance(v, int) and not isinstance(v, bool)}

    def set_ttl(self, minutes: int) -> None:
        self.config.ttl_minutes = int(minutes)
        self._write("config", self.config.to_dict())

    def create_tracker(self, threshold: float = 0.85, method: str = "window", window_size: int = 15, tracker_id: str = "") -> SceneTracker:
        return SceneTracker(self, threshold, method, window_size, tracker_id)

    def load(self, path: str) -> None:
        self.base, self.root = path, f"{path.rstrip('/')}/{self.prefix}"

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            for key in [k for k, v in _OPEN.items() if v is self]:
                del _OPEN[key]
            if self.error:
                raise RuntimeError(self.error)

    def save(self, _: str = "") -> None:
        self.close()


class SceneTracker:
    """Frames one by one, with the state saved on a cut, each 150 frames, on reset and on save."""

    EVERY = 150

    def __init__(self, db: PartitionedDB, threshold: float, method: str, window_size: int, tracker_id: str = ""):
        self.db, self.id = db, tracker_id
        self.make = lambda: Scene(threshold, method, max(1, window_size))
        self.scene = self.make()
        stored = db._read(f"tracker-{tracker_id}") if tracker_id else None
        if stored:
            self.scene.load(tuple(stored))

    def append(self, id: int, timestamp: int = 0, partition_tag: str | None = None, score: float = 0.0, embedding=None) -> dict:
        if embedding is None:
            rows = self.db.routed
            indexes = _search.resolve_tags(self.db.tags, [partition_tag] if partition_tag else None)
            rows = rows.filter(F.col("id") == id) if indexes is None else rows.filter((F.col("id") == id) & F.col("custom_index").isin(*indexes))
            row = rows.orderBy("seq").select("embedding").first()
            if row is None:
                raise KeyError(f"no vector of id {id}")
            embedding = row[0]
        keys = ("scene_id", "is_new_scene", "similarity", "scene_frame_count", "scene_start_ts", "scene_end_ts", "best_image_id", "best_score", "completed_scene")
        out = dict(zip(keys, self.scene.append(int(id), int(timestamp), float(score), embedding), strict=True))
        if out["completed_scene"]:
            out["completed_scene"] = dict(zip(("scene_id", "best_image_id", "best_score", "frame_count", "start_ts", "end_ts"), out["completed_scene"], strict=True))
        if out["is_new_scene"] or self.scene.count % self.EVERY == 0:
            self.save()
        return out

    def save(self) -> None:
        if self.id:
            self.db._write(f"tracker-{self.id}", list(self.scene.saved()))

    def reset(self) -> None:
        self.scene.reset()
        self.save()

    def get_state(self) -> dict:
        s = self.scene
        return {"scene_id": s.scene_id, "frame_count": s.count, "start_ts": s.start_ts, "end_ts": s.end_ts, "best_image_id": s.best_id, "best_score": s.best_score}
