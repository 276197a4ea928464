"""What a database folder keeps: manifest, recovery, compaction, expiry, logs, locks; and folders and streams as sources."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane import queries
from sparkvane.db import FlatDB, PartitionedDB
from sparkvane.functions.embed import default_registry
from sparkvane.operators.grouping import resolve_vectors
from sparkvane.plans import catalog
from sparkvane.sources import wal
from sparkvane.sources.documents import index_folder

HOUR = 3_600_000
BASE = 1_700_000_000_000 // HOUR * HOUR


def filled(spark, path, batches=3):
    db = PartitionedDB(spark, str(path), "kept", dimension=2, max_elements=1000)
    for b in range(batches):
        db.add_vectors([10 * b + i for i in range(10)], [[b, i] for i in range(10)], BASE + b * HOUR, f"tag{b % 2}", [f"c{b}-{i}" for i in range(10)])
    return db


def rows_of(db):
    return sorted((r["id"], r["partition_key"], tuple(r["embedding"]), r["chunk"], r["seq"]) for r in db.routed.collect())


def test_manifest_is_stored(spark, tmp_path):
    db = filled(spark, tmp_path)
    want = sorted(tuple(r) for r in catalog.manifest(db.routed).collect())
    assert sorted(tuple(r) for r in db.manifest.select("partition_key", "ts_partition", "custom_index", "bucket_number", "ts_start", "ts_end", "element_count").collect()) == want
    assert db.get_health()["total_records"] == 30 and db.metrics()["total_buckets"] == 3
    assert [r[4] for r in rows_of(db)] == list(range(30))
    plan = db.routed.filter("custom_index = 1 and ts_partition = 'x'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "custom_index" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_recovery_enters_what_a_crash_left(spark, tmp_path):
    db = filled(spark, tmp_path)
    before = rows_of(db)
    fs, p = db._fs(f"{db.root}/manifest/batch=call-000000000002")
    fs.delete(p, True)
    assert db.total_records() == 20 and len(rows_of(db)) == 20
    again = PartitionedDB(spark, str(tmp_path), "kept")
    assert rows_of(again) == before and again.total_records() == 30


def test_compaction_and_its_recovery(spark, tmp_path):
    db = filled(spark, tmp_path)
    before, buckets = rows_of(db), sorted(tuple(r) for r in db.manifest.collect())
    assert db.compact("one") == 3 and db._batches("vectors") == ["one"]
    assert rows_of(db) == before and sorted(tuple(r) for r in db.manifest.collect()) == buckets and db.compact() == 0
    # Cut short after the plan was written: the next opening ends it.
    db.add_vectors([99], [1, 1], BASE, "tag0")
    db.routed.drop("batch").write.partitionBy("ts_partition", "custom_index", "bucket_number").parquet(f"{db.root}/new/batch=two")
    before = rows_of(db)
    db._write("compacting", {"new": "two", "old": db._batches("manifest")})
    again = PartitionedDB(spark, str(tmp_path), "kept")
    assert again._batches("vectors") == ["two"] and rows_of(again) == before


def test_expiry_by_time_to_live(spark, tmp_path):
    db = filled(spark, tmp_path)
    db.add_vectors([77], [5, 5], 0, "tag0")
    db.set_ttl(0)
    assert db.expire(BASE + 10 * HOUR) == 0
    db.set_ttl(60)
    assert db.expire(BASE + 2 * HOUR) == 10 and db.total_records() == 21
    assert {r[0] for r in rows_of(db)} == {*range(10, 30), 77}


def test_logs_become_a_batch_and_go(spark, tmp_path):
    db = PartitionedDB(spark, str(tmp_path), "kept", dimension=2)
    logs = tmp_path / "logs"
    logs.mkdir()
    for k in range(3):
        (logs / f"{k}.wal").write_bytes(b"".join(wal.pack_record(10 * k + i, BASE + k, np.array([k, i]), f"t{k}{i}") for i in range(4)))
    (logs / "9.wal").write_bytes(b"truncated")
    with pytest.raises(Exception):
        db.import_logs(str(logs))
    assert len(list(logs.iterdir())) == 4 + sum(x.name.startswith(".") for x in logs.iterdir())
    (logs / "9.wal").unlink()
    db.clear_error()
    assert db.import_logs(str(logs)) == 12 and db.import_logs(str(logs)) == 0
    assert [(r[0], r[3], r[4]) for r in rows_of(db)] == [(10 * k + i, f"t{k}{i}", 4 * k + i) for k in range(3) for i in range(4)]


def test_another_writer_is_refused(spark, tmp_path):
    db = filled(spark, tmp_path, 1)
    (tmp_path / "kept" / "writer.lock").write_bytes(b"")
    with pytest.raises(BlockingIOError):
        db.add_vectors([5], [1, 1])
    assert db.error is None
    db.LOCK_MS = 0
    time.sleep(0.01)
    db.add_vectors([5], [1, 1])
    assert not (tmp_path / "kept" / "writer.lock").exists() and db.total_records() == 11


def test_bad_rows_store_nothing(spark, tmp_path):
    db = filled(spark, tmp_path, 1)
    for bad in ([(1, None)], [(None, [1.0, 1.0])], [(1, [1.0])], [(-1, [1.0, 1.0])]):
        rows = spark.createDataFrame([(*r, "c", BASE, "t") for r in bad], "id long, embedding array<float>, chunk string, ts_ms long, tag string")
        with pytest.raises(ValueError):
            db.add_batch(rows, "bad")
    assert db.total_records() == 10 and db.error is None


def test_flat_database_saved_over_itself(spark, tmp_path):
    path = str(tmp_path / "flat")
    db = FlatDB(spark, dimension=2)
    db.add_vectors(1, [[0, 1], [1, 0]])
    db.save(path)
    db.add_vectors(3, [[1, 1]])
    db.save(path)
    assert FlatDB(spark, dimension=2).load(path).size == 3 and not (tmp_path / "flat.old").exists()
    (tmp_path / "flat").rename(tmp_path / "flat.old")
    assert FlatDB(spark, dimension=2).load(path).size == 3


def test_items_point_at_their_own_tag(spark):
    rows = [(1, "a", 1, 0), (1, "b", 2, 0), (2, "b", 2, 0), (2, "b", 2, 1), (3, "default", 0, 0), (3, "a", 1, 0)]
    stored = spark.createDataFrame([(i, [float(c), float(b)], k, f"2024_{c}_000{b}", t, "2024", c) for k, (i, t, c, b) in enumerate(rows)], "id long, embedding array<float>, seq long, partition_key string, tag string, ts_partition string, custom_index int")
    tags = spark.createDataFrame([(0, "default"), (1, "a"), (2, "b"), (2, "alias")], "custom_index int, tag string")

    def got(items):
        made = spark.createDataFrame(items, "image_id long, device_id string, ts_partition string, full string")
        return sorted((r["id"], tuple(r["embedding"])) for r in resolve_vectors(made, stored, full_partition_key="full", tags=tags).collect())

    assert got([(1, "b", "2024", None)]) == [(1, (2.0, 0.0))]
    assert got([(2, "a", "2024", None)]) == []  # a known tag is not left, though another has the id
    assert got([(2, "nobody", "2024", None)]) == [(2, (2.0, 0.0))]
    assert got([(2, "alias", "2024", None)]) == [(2, (2.0, 0.0))]
    assert got([(2, None, None, "2024_2_0001")]) == [(2, (2.0, 1.0))] and got([(1, None, None, "2024_2_0007")]) == [(1, (2.0, 0.0))]
    assert got([(1, None, None, "2024_0_0000")]) == [] and got([(1, None, None, "odd")]) == []
    assert got([(3, None, "2024", None)]) == [(3, (0.0, 0.0))] and got([(3, "a", None, None)]) == []
    assert got([(1, "a", "2024", None), (1, "b", "2024", None), (1, "b", "2024", None)]) == [(1, (1.0, 0.0))]


def test_folder_to_index_to_question(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.txt").write_text("the needle lies here")
    (docs / "b.py").write_text("".join(f"line {i} = {i}\n" for i in range(12)))
    db = PartitionedDB(spark, str(tmp_path), "index", dimension=64)
    registry = default_registry()
    assert index_folder(spark, str(docs), db, registry) == 4 and index_folder(spark, str(docs), db, registry) == 4
    question = spark.createDataFrame([("the needle lies here",)], "q string").select(registry.column(F.col("q"), "hashing")).first()[0]
    best = db.lookup(list(question), 1).first()
    assert best["chunk"] == "the needle lies here" and db.total_records() == 4


def test_queries_that_must_find_rows(spark):
    for name in ("lookup_time_range", "lookup_tags_time", "prune_buckets", "partitioned_lookup_reference_mode", "grouping_resolve", "stored_lookup_tags_time"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
