"""The library against hand-made cases and plain Python versions."""

import math
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvane.db import FlatDB, PartitionedDB, partitioned_db
from sparkvane.functions import embed, text, timebucket, vectors
from sparkvane.operators import ann, search
from sparkvane.operators.dedup import keep_distinct
from sparkvane.operators.grouping import Centroids, group_by_centroids
from sparkvane.operators.tracker import Scene
from sparkvane.plans import catalog
from sparkvane.plans.config import DbConfig, checked_prefix, max_elements
from sparkvane.sources import documents, files, wal


def test_sizing_and_config():
    assert max_elements(1.0, 512, 16) == 441_505 and max_elements(1e-6, 4, 16) == 1000
    with pytest.raises(ValueError):
        DbConfig(space="dot")
    kept = DbConfig.merged({"dimension": 4, "max_elements": 1000}, {"max_elements": 5, "dim": 8})
    assert (kept.max_elements, kept.dimension) == (1000, 8)
    for bad in ("", ".", "a/b", "a:b"):
        with pytest.raises(ValueError):
            checked_prefix(bad)


def test_bucket_names_and_ranges(spark):
    day, rows = datetime(1999, 12, 25, 5, tzinfo=UTC), []
    while day < datetime(2031, 1, 10, tzinfo=UTC):
        rows.append((int(day.timestamp() * 1000),))
        day += timedelta(days=3, hours=7)
    table = spark.createDataFrame([*rows, (0,), (-5,)], "ms long")
    for g in timebucket.GRANULARITIES:
        named = table.select("ms", timebucket.bucket_name(F.col("ms"), g).alias("name"))
        for r in named.select("*", timebucket.bucket_start(F.col("name")).alias("a"), timebucket.bucket_end(F.col("name")).alias("b")).collect():
            assert r["name"] == timebucket.name_of(r["ms"], g)
            assert timebucket.range_of(r["name"]) == ((r["a"], r["b"]) if r["a"] is not None else None)
            assert r["name"] == "default" or r["a"] <= r["ms"] < r["b"]
    assert timebucket.name_of(1703980800000, "weekly") == "2023-W52" and timebucket.name_of(1704067200000, "weekly") == "2024-W01"
    assert timebucket.name_of(1704067200000, "odd") == "2024"


def test_flat_search(spark):
    db = FlatDB(spark, dimension=3)
    assert db.add_vectors(10, [[1, 0, 0], [0, 1, 0], [0, 0, 1]], ["x", "y", "z"]) == 12
    got = db.lookup([0, 1, 0], 3)
    assert got[0] == [11, 1.0, "y"] and [round(r[1], 6) for r in got[1:]] == [0.333333] * 2
    for bad in (lambda: db.add_vectors(1, [1.0, 2.0]), lambda: db.lookup([0, 1, 0], -1), lambda: db.add_vectors([1], [[1, 2, 3], [1, 2, 3]]), lambda: db.add_vectors(1, ["a", "b", "c"]), lambda: db.add_vectors(-1, [1, 2, 3])):
        with pytest.raises(ValueError):
            bad()


def test_flat_cosine_and_last_label(spark, tmp_path):
    db = FlatDB(spark, dimension=3, space="cosine")
    db.add_vectors([20, 21, 22], [[0, 2, 0], [2, 0, 0], [0, 0, 2]])
    db.add_vectors([20], [[0, 0, 5]], [{"chunk": "newest"}])
    (one,) = db.lookup([0, 7, 0], 1)
    assert one[0] == 20 and abs(one[1] - 1) < 1e-6 and one[2] == "newest"
    db.save(str(tmp_path / "flat"))
    assert FlatDB(spark, 3, space="cosine").load(str(tmp_path / "flat")).lookup([0, 0, 7], 1)[0][0] in (20, 22)


def test_scores(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (-0.5,), (math.nan,), (math.inf,)], "d double")
    assert [r[0] for r in d.select(vectors.score(F.col("d"))).collect()] == [1.0, 0.5, 0.0, 0.0, 0.0]
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1, 2])], "a array<float>, z array<float>, i array<int>")
    got = row.select(vectors.normalise(F.col("a")), vectors.normalise(F.col("z")), vectors.cosine_similarity(F.col("a"), F.col("z")), vectors.squared_l2_integers(F.col("i"), F.array(F.lit(4), F.lit(6)))).first()
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0] and got[2] == 0 and got[3] == 25
    assert row.select(vectors.reshape(F.array(*[F.lit(float(i)) for i in range(6)]), 2)).first()[0] == [[0, 1], [2, 3], [4, 5]]


def test_batch_knn_and_ties(spark):
    rng = np.random.default_rng(0)
    x = np.repeat(rng.normal(size=(40, 8)), 3, axis=0)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    for space in vectors.SPACES:
        queries = [(q, x[q].tolist()) for q in (0, 7, 50)]
        got = {}
        for r in search.batch_knn(table, queries, 5, space).collect():
            got.setdefault(r["query_id"], []).append((r["place"], r["id"]))
        x32 = x.astype(np.float32).astype(float)
        for q, v in queries:
            d = vectors.distances(space, x32, np.array([v]))[:, 0]
            want = sorted(range(len(x)), key=lambda i: (round(d[i], 9), i))[:5]
            assert [i for _, i in sorted(got[q])] == want


def test_dedup_keeps_ends_of_a_chain():
    at = lambda deg: [math.cos(math.radians(deg)), math.sin(math.radians(deg))]
    assert keep_distinct([at(0), at(20), at(40)], 0.9) == [0, 2]
    assert keep_distinct([at(0), at(0)], 0) == [0, 1] and keep_distinct([at(0), None, []], 0.5) == [0, 1, 2]


def test_grouping(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 5))
    x[7] = 0
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {r["id"]: r["group_id"] for r in group_by_centroids(table.repartition(4), 0.5).collect()}
    centres, sizes, want = [], [], {}
    for i, v in enumerate(x):
        if not v.any():
            continue
        u = v / np.sqrt((v * v).sum())
        s = [float(c @ u) for c in centres]
        if s and max(s) >= 0.5:
            g = s.index(max(s))
            c = centres[g] * sizes[g] + u
            centres[g] = c / np.sqrt((c * c).sum())
            sizes[g] += 1
        else:
            g = len(centres)
            centres.append(u)
            sizes.append(1)
        want[i] = g
    assert got == want
    assert Centroids(0.5).add(np.zeros(3)) is None


def test_tracker():
    s = Scene(0.85, "window", 3)
    rows = [s.append(1001, 1000, 1.0, [1, 0, 0, 0]), s.append(1002, 2000, 0.9, [0.9, 0.1, 0, 0]), s.append(1003, 3000, 0.95, [0, 1, 0, 0])]
    assert [r[1] for r in rows] == [False, False, True] and rows[1][3] == 2 and rows[2][3] == 1
    assert abs(rows[1][2] - 0.993884) < 1e-5 and abs(rows[2][2] - 0.0553) < 1e-4 and rows[2][8][1] == 1001 and s.scene_id == 1
    again = Scene(0.85, "window", 3).load(s.saved())
    assert again.append(1, 4000, 0.1, [0, 1, 0, 0])[0] == 1
    with pytest.raises(ValueError):
        again.append(2, 5000, 0.1, [1, 0])
    c = Scene(0.8, "centroid")
    rows = [c.append(101, 0, 0, [1, 0, 0]), c.append(102, 1000, 0, [1, 0.01, 0]), c.append(103, 2000, 0, [0, 1, 0])]
    assert rows[1][3] == 2 and abs(rows[1][2] - 0.99995) < 1e-5 and rows[2][8][3] == 2 and abs(rows[2][2] - 0.005) < 1e-3


def test_partitioned_database(spark, tmp_path):
    db = partitioned_db(spark, str(tmp_path), "one", dimension=3)
    assert partitioned_db(spark, str(tmp_path), "one") is db
    ts = 1700000000000
    assert db.add_vectors([101, 102], [[1, 0, 0], [0, 1, 0]], ts, "camera-a", ["one", "two"]) == 102
    got = db.lookup([1, 0, 0], 2).collect()
    assert got[0]["id"] == 101 and got[0]["partition_key"] == "2023-11-14-22_1_0000" and db.total_records() == 2
    assert db.query_label_by_id(101) == "one" and db.query_label_by_id(102, "camera-a", ts) == "two" and db.query_label_by_id(101, "nobody") is None
    assert db.add_partition_tag(1, "alias-a") and not db.add_partition_tag(1, "alias-a") and not db.add_partition_tag(9, "z")
    assert db.query_label_by_id(101, "alias-a") == "one" and db.get_partition_info("alias-a") == {"custom_index": 1, "tags": ["alias-a", "camera-a"]}
    items = spark.createDataFrame([(102, "camera-a", ts), (101, "camera-a", ts), (5, "camera-a", ts)], "image_id long, device_id string, timestamp long")
    assert [r["ids"] for r in db.grouping(items, 0.9).orderBy("group_id").collect()] == [[101], [102]]
    with pytest.raises(ValueError):
        db.grouping(items, 0.9, id_key="nothing")
    assert db.lookup([1, 0], 1) is None and db.vector_by_id(102) == [0, 1, 0]
    tracker = db.create_tracker(0.8, "centroid", tracker_id="t")
    assert tracker.append(101, ts, "camera-a")["scene_id"] == 0 and tracker.append(102, ts + 1, "camera-a")["is_new_scene"]
    assert db.create_tracker(0.8, "centroid", tracker_id="t").get_state()["scene_id"] == 1
    db.set_ttl(9)
    db.close()
    db.close()
    with pytest.raises(RuntimeError):
        db.lookup([1, 0, 0], 1)
    again = PartitionedDB(spark, str(tmp_path), "one")
    assert again.config.ttl_minutes == 9 and again.total_records() == 2 and again.get_health()["total_buckets"] == 1
    assert again.list_partitions().first()["tags"] == "alias-a,camera-a"


def test_capacity_time_and_dedup(spark, tmp_path):
    db = PartitionedDB(spark, str(tmp_path), "two", dimension=4, max_elements=1000)
    base = 1700000000000
    for b in range(3):
        db.add_vectors([b * 1000 + i for i in range(700)], [[b, 1, 0, i / 1000] for i in range(700)], base + b * 10000, "CAM_1")
    sizes = [r["element_count"] for r in db.manifest.orderBy("partition_key").collect()]
    assert sizes == [1000, 1000, 100]
    got = [(r["id"], round(r["score"], 9)) for r in db.lookup([2, 1, 0, 0], 5, ts_start=base + 9000, ts_end=base + 11000).collect()]
    assert got == [(1000 + i, round(1 / (2 + (i / 1000) ** 2), 9)) for i in range(5)]
    assert [r["id"] for r in db.lookup([2, 1, 0, 0], 5).collect()] == [2000 + i for i in range(5)]
    assert db.lookup([2, 1, 0, 0], 5, partition="none").count() == 0 and db.lookup([2, 1, 0, 0], 5, partition="none", compat_unknown_tag=True).count() == 5
    assert len(db.lookup([2, 1, 0, 0], 5, ts_start=base, ts_end=base + 1000, mode="reference").collect()) < 5
    assert db.lookup([2, 1, 0, 0], 5, dedup=0.999, dedup_scope="global").count() < 5
    before = db.total_records()
    rows = spark.createDataFrame([(1, [0.0] * 4, "a", base, "x")], "id long, embedding array<float>, chunk string, ts_ms long, tag string")
    db.add_batch(rows, "same")
    db.add_batch(rows, "same")
    assert db.total_records() == before + 1
    with pytest.raises(ValueError):
        db.add_batch(rows.withColumn("embedding", F.array(F.lit(1.0))), "bad")


def test_prune_and_pending(spark):
    buckets = spark.createDataFrame([("2024_0_0000", "2024", 0, 0, 100, 200, 1), ("2024_1_0000", "2024", 1, 0, 0, 0, 1)], "partition_key string, ts_partition string, custom_index int, bucket_number int, ts_start long, ts_end long, element_count long")
    assert catalog.prune(buckets, 200, 300).count() == 2 and catalog.prune(buckets, 201, 300).count() == 1 and catalog.prune(buckets, indexes=[]).count() == 0
    pending = spark.createDataFrame([("2024-01-02_3_0001",), ("2024_0_0000",)], "partition_key string")
    both = catalog.with_pending(buckets, pending).collect()
    assert len(both) == 3 and max(r["ts_end"] for r in both) == 1704239999999


def test_chunkers(spark):
    for size, overlap in ((10, 3), (5, 0)):
        for n in (0, 1, size, size + 1, 37, 38, 39, 40):
            body = "".join(chr(97 + i % 26) for i in range(n))
            want, at = [], 0
            while at < n:
                end = min(at + size, n)
                want.append((body[at:end], at, end))
                if end == n:
                    break
                at += size - overlap
            table = spark.createDataFrame([(body,)], "t string")
            assert [tuple(x) for x in table.select(text.text_chunks(F.col("t"), size, overlap)).first()[0]] == want
    odd = "a\nb\r\nc\rd\x0be f\n\n"
    table = spark.createDataFrame([(odd,)], "t string")
    assert table.select(text.lines(F.col("t"))).first()[0] == odd.splitlines(keepends=True)
    assert table.select(text.paragraph_chunks(F.lit("x" * 51 + "\nshort"))).first()[0] == ["x" * 51]
    assert table.select(text.window_chunks(F.lit("y" * 170))).first()[0] == ["y" * 100, "y" * 90, "y" * 10]
    with pytest.raises(ValueError):
        text.text_chunks(F.col("t"), 5, 5)
    docs = spark.createDataFrame([("a.py", "1\n2\n3\n4\n5\n6\n"), ("b.txt", "z" * 600)], "path string, text string")
    assert {(r["path"], r["from"], r["to"]) for r in text.split_documents(docs).collect()} == {("a.py", 0, 5), ("a.py", 4, 6), ("b.txt", 0, 500), ("b.txt", 450, 600)}


def test_strings(spark):
    row = spark.createDataFrame([("/a/b.c/Notes.TXT",)], "p string")
    p = F.col("p")
    got = row.select(text.file_extension(p), text.is_absolute_path(p), text.wildcard(p, "*/N?tes.*"), text.wildcard(p, "*.tx"), text.uid_to_hex(F.lit(1), F.lit(255)), text.bytes_to_number(F.unhex(F.lit("0100"))), text.html_text(F.lit("<p>a &amp; b</p><script>x</script>"))).first()
    assert tuple(got) == ("txt", True, True, False, "0000000000000001" + "00000000000000ff", 256, "a & b")


def test_files(spark, tmp_path):
    for name in ("needle.txt", "sub/page.html", "sub/.hidden", ".git/x", "sub/_kept", "data.json"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_text({"sub/page.html": "<b>hi</b> <i>you</i>", "data.json": '{"a":1}'}.get(name, "text"))
    found = files.scan(spark, str(tmp_path))
    assert sorted(r[0].split("/")[-1] for r in found.select("file_path").collect()) == ["_kept", "data.json", "needle.txt", "page.html"]
    index = files.build_index(found)
    assert files.query_index(index, "needle").count() == 1 and sorted(r[0] for r in index.select("file_id").collect()) == [0, 1, 2, 3]
    assert files.by_path(found, "NEED%txt").count() == 1 and files.by_node(found, "local").count() == 4
    assert files.upsert(found, found.limit(1)).count() == 4 and files.remove(found, found.limit(1)).count() == 3
    assert found.filter(files.name_matches(F.col("file_path"), ["need", r".*\.json"])).count() == 2
    texts = {r["path"].split("/")[-1]: r["text"] for r in documents.load(spark, str(tmp_path)).collect()}
    assert texts["page.html"] == "hi you" and texts["data.json"] == '{\n  "a": 1\n}'


def test_logs(spark, tmp_path):
    (tmp_path / "a.wal").write_bytes(wal.pack_record(1, 5, [1, 2], "é") + wal.pack_record(2, 6, [3, 4], ""))
    got = wal.read(spark, str(tmp_path), 2).orderBy("place").collect()
    assert [(r["id"], r["ts_ms"], list(r["embedding"]), r["chunk"]) for r in got] == [(1, 5, [1, 2], "é"), (2, 6, [3, 4], "")]
    with pytest.raises(ValueError):
        wal.unpack(b"truncated", 2)


def test_embedding_registry(spark):
    r = embed.EmbeddingRegistry()
    r.add_model("a", "hashing", dimension=8)
    r.add_model("b", "hashing", dimension=4)
    assert r.active == "a" and r.list_models() == ["a", "b"] and len(r.embed_text("x y")) == 8
    r.set_active_model("b")
    assert r.embed_chunks(["x", ""]).shape == (2, 4)
    with pytest.raises(KeyError):
        r.set_active_model("none")
    table = spark.createDataFrame([("x y z " * 90,), (None,)], "t string")
    long, empty = [row[0] for row in table.select(r.column(F.col("t"), chunk_chars=200)).collect()]
    assert abs(np.linalg.norm(long) - 1) < 1e-9 and not any(empty)
    tokens, mask = np.arange(12.0).reshape(1, 3, 4), np.array([[1, 1, 0]])
    assert embed.pool(tokens, mask).tolist() == [[2, 3, 4, 5]] and embed.pool(tokens, mask, "max").tolist() == [[4, 5, 6, 7]] and embed.pool(tokens, mask, "cls").tolist() == [[0, 1, 2, 3]]


def test_inverted_lists(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=8) * 4 + rng.normal(size=(50, 8)) for _ in range(6)])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    centres = ann.fit_centres(table, lists=12)
    queries = [(i, x[i].tolist()) for i in range(0, 300, 50)]
    row = ann.recall(ann.index(table, centres), centres, queries, search.batch_knn(table, queries, 10).select("query_id", "id"), 10, probes=5).first()
    assert row["wanted"] == 60 and row["recall"] >= 0.9


def test_entry_imports_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    real = importlib.import_module
    for name in [m for m in sys.modules if m.startswith("sparkvane.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sparkvane.llm", None)
    monkeypatch.delattr("sparkvane.llm", raising=False)
    entry = importlib.reload(__spark_entry__)
    assert not any(n.startswith("op") or n == "pipeline" for n in entry.queries()) and len(entry.queries()) > 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert real and random
