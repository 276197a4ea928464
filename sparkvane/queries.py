"""The registered queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it.

Vectors are `embeddings` joined with `events` of the same number: id, embedding, ts_ms, tag (event type), chunk (props),
stream (label) and seq (id). Routing is by day, tag and buckets of CAPACITY rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import timebucket, vectors
from .functions.embed import default_registry
from .operators import ann, search
from .operators import labels as by_id
from .operators.grouping import group_by_centroids, resolve_vectors
from .operators.tracker import track
from .plans import catalog
from .plans.scratch import scratch_path
from .sources import files
from .streaming.ingest import bucketed_counts, windowed_counts
from .streaming.tracker import track_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CAPACITY = 5
K = 10
SIMILAR = 0.2
FROM_MS, TO_MS = 1704088800000, 1704132000000  # 2024-01-01, from 6 to 18 h: some vectors of every table lie in it, others don't
TAGS = ["click", "view"]

VIEW = """v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e, epoch_us(ts) // 1000 AS ts_ms, event_type AS tag, props AS chunk, label::BIGINT AS stream, value
  FROM embeddings JOIN events ON vec_id = event_id
)"""
ROUTED = (
    VIEW
    + f""", tags AS (
  SELECT tag, row_number() OVER (ORDER BY min(id), tag) AS custom_index FROM v GROUP BY tag
), timed AS (
  SELECT v.*, custom_index, CASE WHEN ts_ms <= 0 THEN 'default' ELSE strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') END AS ts_partition FROM v JOIN tags USING (tag)
), numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY ts_partition, custom_index ORDER BY id) - 1) // {CAPACITY} AS bucket_number FROM timed
), routed AS (
  SELECT *, ts_partition || '_' || custom_index || '_' || lpad(bucket_number::VARCHAR, 4, '0') AS partition_key FROM numbered
), buckets AS (
  SELECT partition_key, ts_partition, custom_index, bucket_number, min(ts_ms) AS ts_start, max(ts_ms) AS ts_end, count(*) AS element_count FROM routed GROUP BY ALL
)"""
)
L2 = "list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i])))"
UNIT = "list_transform({v}, lambda x: x / sqrt(list_dot_product({v}, {v})))"
ASKED = "q AS (SELECT embedding::DOUBLE[] AS qe FROM embeddings WHERE vec_id = 0)"


def query(oracle: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors."""
    e, v = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "events")
    joined = e.join(v, e["vec_id"] == v["event_id"])
    return joined.select(
        F.col("vec_id").alias("id"), "embedding", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("tag"), F.col("props").alias("chunk"),
        F.col("label").cast("long").alias("stream"), "value", F.col("vec_id").alias("seq"),
    )


def tags_of(rows: DataFrame) -> DataFrame:
    return catalog.with_new_tags(catalog.no_tags(rows.sparkSession), rows)


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir)
    return catalog.route(rows, tags_of(rows), "daily", CAPACITY)


def asked(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _flat(space: str, distance: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return rounded(search.flat_knn(rows, asked(spark, sf_dir), K, space).select("id", "distance", "score"), "distance", "score")

    run.__name__ = f"flat_knn_{space}"
    query(f"""WITH {ASKED}, d AS (SELECT vec_id AS id, {distance} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q)
SELECT id, round(d, 6) AS distance, round(CASE WHEN d < 0 THEN 0 ELSE 1 / (1 + d) END, 6) AS score FROM d ORDER BY d, id LIMIT {K}""")(run)


_COSINE = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-30)"
_flat("l2", L2.format(a="e", b="qe"))
_flat("ip", "1 - list_dot_product(e, qe)")
_flat("cosine", f"CASE WHEN {_COSINE.format(a='e', b='qe')} BETWEEN -1e-6 AND 0 THEN 0 ELSE {_COSINE.format(a='e', b='qe')} END")


def _lookup(name: str, where: str, after: str, **options) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        wanted = options.get("tags")
        rows = routed(spark, sf_dir)
        given = {k: v for k, v in options.items() if k != "tags"}
        if wanted is not None:
            given["indexes"] = search.resolve_tags(tags_of(stored(spark, sf_dir)), wanted)
        return rounded(search.partitioned_lookup(rows, asked(spark, sf_dir), K, granularity="daily", **given), "score")

    run.__name__ = name
    query(f"""WITH {ROUTED}, {ASKED}, d AS (
  SELECT id, chunk, partition_key, ts_ms, {L2.format(a="e", b="qe")} AS d FROM routed, q WHERE {where}
), near AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY partition_key ORDER BY d, id) <= {K})
SELECT id, round(1 / (1 + d), 6) AS score, chunk, partition_key, ts_ms FROM near WHERE {after} ORDER BY d, id LIMIT {K}""")(run)


_IN_TIME = f"(ts_ms = 0 OR ts_ms BETWEEN {FROM_MS} AND {TO_MS})"
_lookup("partitioned_lookup_exact", "true", "true")
_lookup("partitioned_lookup_reference_mode", f"strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') = '2024-01-01'", _IN_TIME, mode="reference", ts_start=FROM_MS, ts_end=TO_MS)
_lookup("lookup_time_range", _IN_TIME, "true", ts_start=FROM_MS, ts_end=TO_MS)
_lookup("lookup_tag", "tag = 'click'", "true", tags=["click"])
_lookup("lookup_tags_time", f"tag IN ('click', 'view') AND {_IN_TIME}", "true", tags=TAGS, ts_start=FROM_MS, ts_end=TO_MS)
_lookup("lookup_unknown_tag", "false", "true", tags=["nowhere"])


@query(f"""WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), d AS (
  SELECT a.id AS query_id, b.id, {L2.format(a="a.e", b="b.e")} AS d FROM v a, v b WHERE a.id % 50 = 0
) SELECT query_id, id, round(d, 6) AS distance, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM d) WHERE place <= {K}""")
def batch_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    queries = [(r[0], r[1]) for r in rows.filter("id % 50 = 0").collect()]
    found = search.batch_knn(rows, queries, K)
    return rounded(found.withColumn("place", F.col("place").cast("long")), "distance")


@query(f"""WITH {ASKED}, d AS (SELECT vec_id AS id, {L2.format(a="e", b="qe")} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q)
SELECT id, round(d, 6) AS distance FROM d WHERE d <= 1.6""")
def range_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rounded(search.range_search(rows, asked(spark, sf_dir), 1.6), "distance")


@query(f"""WITH {ASKED}, d AS (SELECT vec_id AS id, label::BIGINT AS doc_id, {L2.format(a="e", b="qe")} AS d FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q),
docs AS (SELECT doc_id, min(d) AS dd FROM d GROUP BY doc_id ORDER BY dd, doc_id LIMIT 3)
SELECT doc_id, id, round(d, 6) AS distance, round(dd, 6) AS doc_distance FROM d JOIN docs USING (doc_id) WHERE d <= (SELECT max(dd) FROM docs)""")
def multivector_doc_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("doc_id"))
    return rounded(search.multivector_search(rows, asked(spark, sf_dir), 3), "distance", "doc_distance")


@query(f"""WITH {ASKED}, d AS (SELECT vec_id AS id, {L2.format(a="e", b="qe")} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IN (1, 2, 3)), q)
SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT {K}""")
def filtered_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return rounded(search.flat_knn(rows, asked(spark, sf_dir), K, where=F.col("label").isin(1, 2, 3)).select("id", "distance"), "distance")


@query(f"""WITH {ASKED}, d AS (SELECT vec_id AS id, {L2.format(a="e", b="qe")} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q
WHERE vec_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error'))
SELECT id, round(d, 6) AS distance FROM d ORDER BY d, id LIMIT {K}""")
def knn_with_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    gone = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.col("event_id").alias("id"))
    return rounded(search.flat_knn(search.without_deleted(rows, gone), asked(spark, sf_dir), K).select("id", "distance"), "distance")


def _greedy(scope: str) -> str:
    """Walks the per-bucket nearest in order, carrying the unit vectors kept."""
    return f"""WITH RECURSIVE {ROUTED}, {ASKED}, d AS (SELECT id, partition_key, tag AS scope_tag, {UNIT.format(v="e")} AS u, {L2.format(a="e", b="qe")} AS d FROM routed, q),
near AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY d, id) AS rn FROM (SELECT *, {scope} AS s FROM d QUALIFY row_number() OVER (PARTITION BY partition_key ORDER BY d, id) <= {K})),
walk(s, rn, id, kept, units) AS (
  SELECT s, rn, id, true, [u] FROM near WHERE rn = 1
  UNION ALL
  SELECT n.s, n.rn, n.id, len(list_filter(w.units, lambda x: list_dot_product(x, n.u) >= {SIMILAR})) = 0,
    CASE WHEN len(list_filter(w.units, lambda x: list_dot_product(x, n.u) >= {SIMILAR})) = 0 THEN list_append(w.units, n.u) ELSE w.units END
  FROM walk w JOIN near n ON n.s = w.s AND n.rn = w.rn + 1
)
SELECT w.id, near.partition_key, round(1 / (1 + near.d), 6) AS score FROM walk w JOIN near ON near.s = w.s AND near.rn = w.rn WHERE w.kept ORDER BY near.d, w.id LIMIT {K}"""


@query(_greedy("partition_key"))
def dedup_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.partitioned_lookup(routed(spark, sf_dir), asked(spark, sf_dir), K, dedup_threshold=SIMILAR)
    return rounded(found.select("id", "partition_key", "score"), "score")


@query(_greedy("0"))
def dedup_lookup_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.partitioned_lookup(routed(spark, sf_dir), asked(spark, sf_dir), K, dedup_threshold=SIMILAR, dedup_scope="global")
    return rounded(found.select("id", "partition_key", "score"), "score")


@query(f"""WITH RECURSIVE f AS (
  SELECT id, {UNIT.format(v="e")} AS u, row_number() OVER (ORDER BY id) AS rn FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings)
), t(rn, id, g, cs, ns) AS (
  SELECT rn, id, 1::BIGINT, [u], [1::BIGINT] FROM f WHERE rn = 1
  UNION ALL
  SELECT rn, id, g, CASE WHEN g > len(cs) THEN list_append(cs, u) ELSE list_concat(list_append(cs[1:g - 1], list_transform(joined, lambda x: x / sqrt(list_dot_product(joined, joined)))), cs[g + 1:]) END,
    CASE WHEN g > len(cs) THEN list_append(ns, 1) ELSE list_concat(list_append(ns[1:g - 1], ns[g] + 1), ns[g + 1:]) END
  FROM (
    SELECT f.rn, f.id, f.u, t.cs, t.ns, s.g, CASE WHEN s.g > len(t.cs) THEN f.u ELSE list_transform(range(1, 65), lambda i: t.cs[s.g][i] * t.ns[s.g] + f.u[i]) END AS joined
    FROM t JOIN f ON f.rn = t.rn + 1, LATERAL (SELECT list_transform(t.cs, lambda c: list_dot_product(c, f.u)) AS sims) z,
      LATERAL (SELECT CASE WHEN list_max(z.sims) >= {SIMILAR} THEN list_position(z.sims, list_max(z.sims))::BIGINT ELSE len(t.cs) + 1 END AS g) s
  )
) SELECT g - 1 AS group_id, id FROM t""")
def centroid_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_by_centroids(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id"), SIMILAR)


_POINTS = """CASE WHEN id % 4 = 0 THEN regexp_replace(partition_key, '_[0-9]+$', '_0000') END AS w_key,
    CASE id % 4 WHEN 1 THEN 'click' WHEN 2 THEN 'nowhere' END AS w_tag, ts_partition AS w_time"""


@query(f"""WITH {ROUTED}, known AS (SELECT tag, custom_index FROM tags UNION ALL SELECT 'default', 0), items AS (SELECT id, {_POINTS} FROM routed), pointed AS (
  SELECT id, coalesce(w_key, w_time || '_' || coalesce(custom_index, 0) || '_0000') AS named,
    CASE WHEN w_key IS NOT NULL THEN regexp_replace(w_key, '[0-9]+$', '') WHEN custom_index IS NULL THEN w_time || '_' ELSE w_time || '_' || custom_index || '_' END AS wider
  FROM items LEFT JOIN known ON known.tag = coalesce(w_tag, 'default')
), hits AS (
  SELECT id, e, row_number() OVER (PARTITION BY id ORDER BY partition_key <> named, partition_key, id) AS place
  FROM pointed JOIN routed USING (id) WHERE partition_key = named OR starts_with(partition_key, wider)
) SELECT id, round(e[1], 6) AS first_component FROM hits WHERE place = 1""")
def grouping_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of items that point by a full key, by a known tag that may be another row's, by an unknown tag, or by none."""
    rows = routed(spark, sf_dir)
    items = rows.select(
        F.col("id").alias("image_id"), F.when(F.col("id") % 4 == 0, F.regexp_replace("partition_key", "_[0-9]+$", "_0000")).alias("bucket"),
        F.when(F.col("id") % 4 == 1, F.lit("click")).when(F.col("id") % 4 == 2, F.lit("nowhere")).alias("device_id"), "ts_partition",
    )
    found = resolve_vectors(items, rows, full_partition_key="bucket", tags=tags_of(stored(spark, sf_dir)))
    return found.select("id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first_component"))


THRESHOLD = 0.1
_STEP = {
    # The centre after a frame joined: direction of the running sum, or of the last frames' mean.
    "centroid": ("list_transform(range(1, 65), lambda i: t.c[i] * t.n + f.u[i])", "[]::DOUBLE[][]"),
    "window": ("list_transform(range(1, 65), lambda i: list_sum(list_transform(list_append(t.win, f.u)[-15:], lambda w: w[i])))", "list_append(t.win, f.u)[-15:]"),
}


def _tracked(method: str) -> str:
    joined, window = _STEP[method]
    first = "[]::DOUBLE[][]" if method == "centroid" else "[u]"
    later = "[]::DOUBLE[][]" if method == "centroid" else "[f.u]"
    return f"""WITH RECURSIVE {VIEW}, f AS (
  SELECT stream, id, ts_ms, value, {UNIT.format(v="e")} AS u, row_number() OVER (PARTITION BY stream ORDER BY ts_ms, id) AS rn FROM v
), t(stream, rn, id, scene, new, sim, n, start_ts, end_ts, best, best_id, c, win) AS (
  SELECT stream, rn, id, 0, false, 1.0::DOUBLE, 1, ts_ms, ts_ms, value, id, u, {first} FROM f WHERE rn = 1
  UNION ALL
  SELECT stream, rn, id, scene, new, sim, n, start_ts, end_ts, best, best_id, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))), win FROM (
    SELECT f.stream, f.rn, f.id, t.scene + CASE WHEN s.cut THEN 1 ELSE 0 END AS scene, s.cut AS new, s.sim AS sim, CASE WHEN s.cut THEN 1 ELSE t.n + 1 END AS n,
      CASE WHEN s.cut THEN f.ts_ms ELSE t.start_ts END AS start_ts, f.ts_ms AS end_ts, CASE WHEN s.cut OR f.value > t.best THEN f.value ELSE t.best END AS best,
      CASE WHEN s.cut OR f.value > t.best THEN f.id ELSE t.best_id END AS best_id, CASE WHEN s.cut THEN f.u ELSE {joined} END AS c, CASE WHEN s.cut THEN {later} ELSE {window} END AS win
    FROM t JOIN f ON f.stream = t.stream AND f.rn = t.rn + 1, LATERAL (SELECT list_dot_product(f.u, t.c) AS sim, list_dot_product(f.u, t.c) < {THRESHOLD} AS cut) s
  )
)"""


_FRAME_ROWS = "SELECT stream, id AS image_id, scene::BIGINT AS scene_id, new AS is_new_scene, round(sim, 6) AS similarity, n::BIGINT AS scene_frame_count, start_ts AS scene_start_ts, end_ts AS scene_end_ts, best_id AS best_image_id FROM t"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select(F.col("stream").cast("string").alias("stream"), F.col("id").alias("image_id"), "ts_ms", F.col("value").alias("score"), "embedding")


def told(found: DataFrame) -> DataFrame:
    rows = found.select(
        F.col("stream").cast("long").alias("stream"), "image_id", F.col("scene_id").cast("long").alias("scene_id"), "is_new_scene", "similarity",
        F.col("scene_frame_count").cast("long").alias("scene_frame_count"), "scene_start_ts", "scene_end_ts", "best_image_id",
    )
    return rounded(rows, "similarity")


@query(_tracked("centroid") + _FRAME_ROWS)
def scene_tracker_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(track(frames(spark, sf_dir), THRESHOLD, "centroid"))


@query(_tracked("window") + _FRAME_ROWS)
def scene_tracker_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(track(frames(spark, sf_dir), THRESHOLD, "window", 15))


@query(_tracked("centroid") + "SELECT stream, scene::BIGINT AS scene_id, max(n)::BIGINT AS n_frames, min(start_ts) AS start_ts, max(end_ts) AS end_ts, arg_max(best_id, n) AS best_image_id FROM t GROUP BY ALL")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = track(frames(spark, sf_dir), THRESHOLD, "centroid")
    return found.groupBy(F.col("stream").cast("long").alias("stream"), F.col("scene_id").cast("long").alias("scene_id")).agg(
        F.max("scene_frame_count").cast("long").alias("n_frames"), F.min("scene_start_ts").alias("start_ts"), F.max("scene_end_ts").alias("end_ts"),
        F.max_by("best_image_id", "scene_frame_count").alias("best_image_id"),
    )


def _bucket(granularity: str, form: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
        return bucketed_counts(rows, granularity)

    run.__name__ = f"time_bucket_{granularity}"
    query(f"SELECT strftime(ts, '{form}') AS ts_partition, count(*) AS n FROM events GROUP BY ALL")(run)


for _g, _f in (("hourly", "%Y-%m-%d-%H"), ("daily", "%Y-%m-%d"), ("weekly", "%Y-W%W"), ("monthly", "%Y-%m"), ("yearly", "%Y")):
    _bucket(_g, _f)


@query("""SELECT strftime(ts, '%Y-%m-%d-%H') AS name, epoch_ms(date_trunc('hour', ts)) AS start_ms, epoch_ms(date_trunc('hour', ts)) + 3600000 AS end_ms FROM events GROUP BY ALL
UNION ALL SELECT strftime(ts, '%Y-%m-%d'), epoch_ms(date_trunc('day', ts)), epoch_ms(date_trunc('day', ts)) + 86400000 FROM events GROUP BY ALL
UNION ALL SELECT strftime(ts, '%Y-W%W'), greatest(epoch_ms(date_trunc('week', ts)), epoch_ms(date_trunc('year', ts))), least(epoch_ms(date_trunc('week', ts)) + 604800000, epoch_ms(date_trunc('year', ts) + INTERVAL 1 YEAR)) FROM events GROUP BY ALL
UNION ALL SELECT strftime(ts, '%Y-%m'), epoch_ms(date_trunc('month', ts)), epoch_ms(date_trunc('month', ts) + INTERVAL 1 MONTH) FROM events GROUP BY ALL
UNION ALL SELECT strftime(ts, '%Y'), epoch_ms(date_trunc('year', ts)), epoch_ms(date_trunc('year', ts) + INTERVAL 1 YEAR) FROM events GROUP BY ALL""")
def bucket_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = table(spark, sf_dir, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    names = F.array(*[timebucket.bucket_name(F.col("ms"), g) for g in timebucket.GRANULARITIES])
    found = ms.select(F.explode(names).alias("name")).distinct()
    return found.select("name", timebucket.bucket_start(F.col("name")).alias("start_ms"), timebucket.bucket_end(F.col("name")).alias("end_ms"))


@query(f"WITH {ROUTED} SELECT id, ts_partition, custom_index, bucket_number, partition_key FROM routed")
def capacity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select("id", "ts_partition", F.col("custom_index").cast("long").alias("custom_index"), F.col("bucket_number").cast("long").alias("bucket_number"), "partition_key")


@query(f"WITH {ROUTED} SELECT partition_key, ts_start, ts_end, element_count FROM buckets")
def manifest_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest(routed(spark, sf_dir)).select("partition_key", "ts_start", "ts_end", "element_count")


@query(f"WITH {ROUTED} SELECT ts_partition, custom_index, max(bucket_number) AS bucket_number FROM buckets GROUP BY ALL")
def highest_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.highest_bucket(catalog.manifest(routed(spark, sf_dir))).select("ts_partition", F.col("custom_index").cast("long").alias("custom_index"), F.col("bucket_number").cast("long").alias("bucket_number"))


@query(f"WITH {ROUTED} SELECT partition_key, ts_start, ts_end FROM buckets JOIN tags USING (custom_index) WHERE ts_end >= {FROM_MS} AND ts_start <= {TO_MS} AND tag IN ('click', 'view')")
def prune_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = search.resolve_tags(tags_of(stored(spark, sf_dir)), TAGS)
    return catalog.prune(catalog.manifest(routed(spark, sf_dir)), FROM_MS, TO_MS, indexes).select("partition_key", "ts_start", "ts_end")


@query(f"WITH {ROUTED} SELECT partition_key, ts_partition, custom_index, bucket_number, tag AS tags, false AS loaded, element_count FROM buckets JOIN tags USING (custom_index)")
def list_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.list_partitions(catalog.manifest(routed(spark, sf_dir)), tags_of(stored(spark, sf_dir)))
    return found.withColumns({c: F.col(c).cast("long") for c in ("custom_index", "bucket_number")})


@query(f"WITH {ROUTED} SELECT custom_index, tag || ',clicks' AS tags FROM tags WHERE tag = 'click'")
def partition_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = tags_of(stored(spark, sf_dir))
    alias = tags.filter("tag = 'click'").select("custom_index", F.lit("clicks").alias("tag"))
    return catalog.partition_info(tags.unionByName(alias), "clicks").select(F.col("custom_index").cast("long").alias("custom_index"), "tags")


@query(f"""WITH {ROUTED}, one AS (SELECT * FROM routed WHERE id = 7)
SELECT m AS mode, id, chunk, partition_key FROM one, (SELECT unnest(['all', 'tag', 'time', 'time and tag']) AS m)""")
def label_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = routed(spark, sf_dir)
    one = stored(spark, sf_dir).filter("id = 7").select("ts_ms", "tag").first()
    indexes = search.resolve_tags(tags_of(stored(spark, sf_dir)), [one["tag"]])
    out = None
    for mode, given in (("all", {}), ("tag", {"indexes": indexes}), ("time", {"ts_ms": one["ts_ms"]}), ("time and tag", {"indexes": indexes, "ts_ms": one["ts_ms"]})):
        found = by_id.label_by_id(rows, 7, granularity="daily", **given).select(F.lit(mode).alias("mode"), "id", "chunk", "partition_key")
        out = found if out is None else out.union(found)
    return out


@query(f"""WITH {VIEW}, twice AS (SELECT id, id AS seq, e, chunk, ts_ms FROM v UNION ALL SELECT id, id + 100000, list_transform(e, lambda x: 2 * x), 'again ' || chunk, ts_ms + 1 FROM v WHERE id % 2 = 0)
SELECT id, arg_max(chunk, seq) AS chunk, max(ts_ms) AS ts_ms, count(*) AS copies, round(arg_min(e[1], seq), 6) AS first_component FROM twice GROUP BY id""")
def first_vector_last_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(spark, sf_dir).select("id", "seq", "embedding", "chunk", "ts_ms")
    again = rows.filter("id % 2 = 0").select("id", F.col("seq") + 100000, F.transform("embedding", lambda x: x * 2).cast("array<float>"), F.concat(F.lit("again "), "chunk"), F.col("ts_ms") + 1)
    found = by_id.first_vector_last_label(rows.union(again))
    return found.select("id", "chunk", "ts_ms", "copies", F.round(F.get("embedding", 0).cast("double"), 6).alias("first_component"))


@query(f"WITH {ROUTED} SELECT count(*) AS vectors, count(DISTINCT partition_key) AS buckets, count(DISTINCT ts_partition) AS partitions, 0::BIGINT AS wal_files FROM routed")
def full_scan_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.full_scan(routed(spark, sf_dir))


@query("SELECT label::BIGINT AS label, i::BIGINT AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL")
def vector_mean_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = by_id.vector_mean(table(spark, sf_dir, "embeddings"), "label")
    found = means.select(F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("i", "mean"))
    return rounded(found.withColumn("i", F.col("i").cast("long")), "mean")


@query(f"WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), d AS (SELECT {L2.format(a='a.e', b='b.e')} AS d FROM e a JOIN e b ON a.id < b.id) SELECT round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance FROM d")
def pairwise_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(search.pairwise_extremes(table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")), "min_distance", "max_distance")


@query(f"""WITH {ASKED} SELECT vec_id AS id, round(list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))), 6) AS cosine,
round(sqrt(list_dot_product(e, e)), 6) AS length, round((3 * e[1]) / (3 * sqrt(list_dot_product(e, e))), 6) AS unit_first,
list_sum(list_transform(range(1, 65), lambda i: (floor(abs(e[i]) * 255)::BIGINT - floor(abs(qe[i]) * 255)::BIGINT) ** 2))::BIGINT AS integer_l2
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q""")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(*[F.lit(x) for x in asked(spark, sf_dir)])
    e = F.col("embedding")
    small = lambda v: F.transform(v, lambda x: F.floor(F.abs(x.cast("double")) * 255).cast("int"))
    unit = vectors.normalise(F.transform(vectors.doubles(e), lambda x: x * 3))
    found = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), vectors.cosine_similarity(e, q).alias("cosine"), vectors.norm(e).alias("length"), F.get(unit, 0).alias("unit_first"),
        vectors.squared_l2_integers(small(e), small(q)).cast("long").alias("integer_l2"),
    )
    return rounded(found, "cosine", "length", "unit_first")


_STARTS = "unnest(range(0, (ceil(greatest(length(text) - 500, 0) / 450.0) * 450)::BIGINT + 1, 450))"


@query(f"SELECT doc_id, s // 450 AS chunk_no, s AS start, least(s + 500, length(text)) AS \"end\", md5(substring(text, (s + 1)::BIGINT, 500)) AS chunk FROM (SELECT doc_id, text, {_STARTS} AS s FROM documents WHERE length(text) > 0)")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.text_chunks(F.col("text"))).alias("chunk_no", "x"))
    return found.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("x.start").cast("long").alias("start"), F.col("x.end").cast("long").alias("end"), F.md5("x.chunk").alias("chunk"))


_LINES = r"(SELECT doc_id, list_filter(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i < len(p) THEN chr(10) ELSE '' END), lambda x: x <> '') AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


@query(f"""SELECT doc_id, s // 4 AS chunk_no, s AS start_line, least(s + 5, len(l)) AS end_line, md5(array_to_string(l[s + 1:s + 5], '')) AS chunk
FROM (SELECT doc_id, l, unnest(range(0, (ceil(greatest(len(l) - 5, 0) / 4.0) * 4)::BIGINT + 1, 4)) AS s FROM {_LINES} WHERE len(l) > 0)""")
def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.line_chunks(F.col("text"), 5, 1)).alias("chunk_no", "x"))
    return found.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("x.start_line").cast("long").alias("start_line"), F.col("x.end_line").cast("long").alias("end_line"), F.md5("x.chunk").alias("chunk"))


@query("SELECT doc_id, md5(p) AS paragraph FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE length(p) > 50")
def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.paragraph_chunks(F.col("text"))).alias("p")).select("doc_id", F.md5("p").alias("paragraph"))


@query("SELECT doc_id, s // 80 AS chunk_no, md5(substring(text, (s + 1)::BIGINT, 100)) AS chunk FROM (SELECT doc_id, text, unnest(range(0, length(text), 80)) AS s FROM documents WHERE length(text) > 0)")
def window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.window_chunks(F.col("text"))).alias("chunk_no", "c"))
    return found.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5("c").alias("chunk"))


@query("SELECT page_id, url FROM pages WHERE url ILIKE '%exam_le%'")
def url_catalog_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("n").alias("node_id"))
    return files.by_path(pages, "exam_le", "url").select("page_id", "url")


@query("SELECT page_id, url LIKE 'http%//%.%/%' AS matches FROM pages")
def wildcard_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.wildcard(F.col("url"), "http*//*.*/*").alias("matches"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '\.([^./\\]+)$', 1)) AS extension, string_split(url, '/')[3] AS host, replace(url, '/', '|') AS piped, starts_with(url, '/') AS absolute,
lpad(lower(to_hex(page_id)), 32, '0') AS uid, page_id % 1000003 AS low FROM pages""")
def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, uid = F.col("url"), T.uid_to_hex(F.lit(0).cast("long"), F.col("page_id"))
    return table(spark, sf_dir, "pages").select(
        "page_id", T.file_extension(u).alias("extension"), F.get(T.split_text(u, "/"), 2).alias("host"), T.replace_all(u, "/", "|").alias("piped"), T.is_absolute_path(u).alias("absolute"),
        uid.alias("uid"), (T.bytes_to_number(F.unhex(F.substring(uid, 17, 16))).cast("long") % 1000003).alias("low"),
    )


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'))) AS text FROM pages""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text"))


@query()
def hash_embed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    embedded = default_registry().column(F.col("text"), "hashing", chunk_chars=200)
    return table(spark, sf_dir, "documents").select("doc_id", embedded.alias("embedding"))


@query("SELECT event_type, epoch_ms(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_ms, count(*) AS n FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windowed_counts(table(spark, sf_dir, "events"), "ts", "6 hours", "1 day", "event_type")
    return found.select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")


def _streamed(spark: SparkSession, rows: DataFrame, name: str, order: str, then: DataFrame | None = None) -> DataFrame:
    """rows as a stream of one file a micro-batch, written one after the other in order, so that state crosses batches;
    then others that come last."""
    path = scratch_path(spark, name)
    ends = [float("-inf"), *rows.approxQuantile(order, [0.25, 0.5, 0.75], 0.0), float("inf")]
    for low, high in zip(ends, ends[1:], strict=False):
        rows.filter((F.col(order) > low) & (F.col(order) <= high)).coalesce(1).sortWithinPartitions(order).write.mode("append").parquet(path)
    if then is not None:
        then.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", "1").parquet(path)


@query(f"WITH {ROUTED} SELECT partition_key, ts_start, ts_end, element_count FROM buckets")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .db import PartitionedDB
    from .streaming.ingest import write_stream

    rows = stored(spark, sf_dir).select("id", "embedding", "chunk", "ts_ms", "tag", "seq")
    db = PartitionedDB(spark, scratch_path(spark, "db"), "vdb", dimension=64, granularity="daily", max_elements=CAPACITY)
    write_stream(_streamed(spark, rows, "ingest", "seq"), db, scratch_path(spark, "ingest-state")).awaitTermination()
    return db.manifest.select("partition_key", "ts_start", "ts_end", "element_count")


@query(_tracked("centroid") + _FRAME_ROWS)
def streaming_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames arrive in order of time, a quarter of them in each micro-batch, and go through the stateful operator."""
    out = scratch_path(spark, "tracked")
    rows = frames(spark, sf_dir)
    found = track_stream(_streamed(spark, rows, "frames", "ts_ms"), THRESHOLD, "centroid")
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    found.writeStream.foreachBatch(write).option("checkpointLocation", scratch_path(spark, "tracker-state")).trigger(availableNow=True).start().awaitTermination()
    return told(spark.read.parquet(out))


def _stored_db(spark: SparkSession, sf_dir: str):
    """A database folder with the vectors, the earlier half and the later half as batches of their own."""
    from .db import PartitionedDB

    rows = stored(spark, sf_dir).select("id", "embedding", "chunk", "ts_ms", "tag", "seq")
    middle = rows.approxQuantile("seq", [0.5], 0.0)[0]
    db = PartitionedDB(spark, scratch_path(spark, "db"), "vdb", dimension=64, granularity="daily", max_elements=CAPACITY)
    db.add_batch(rows.filter(F.col("seq") <= middle), "first")
    # Arrival numbers go on from the first batch, so those of the second begin at 0 again.
    db.add_batch(rows.filter(F.col("seq") > middle).withColumn("seq", F.col("seq") - int(middle) - 1), "second")
    return db


@query(ORACLES["lookup_tags_time"])
def stored_lookup_tags_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lookup on a database in a folder: time and tags choose the folders that are read."""
    db = _stored_db(spark, sf_dir)
    indexes = search.resolve_tags(db.tags, TAGS)
    found = search.partitioned_lookup(db.routed, asked(spark, sf_dir), K, indexes=indexes, ts_start=FROM_MS, ts_end=TO_MS, granularity="daily")
    return rounded(found, "score")


@query(f"WITH {ROUTED} SELECT partition_key, ts_start, ts_end, element_count FROM buckets")
def stored_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds and sizes that the database keeps, from two batches that were then made one."""
    db = _stored_db(spark, sf_dir)
    db.compact("all")
    return db.manifest.select("partition_key", "ts_start", "ts_end", "element_count")


@query(f"WITH {ROUTED}, now AS (SELECT max(ts_ms) - 6 * 3600000 AS least FROM v) SELECT partition_key, element_count FROM buckets, now WHERE ts_end >= least")
def stored_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a time to live of six hours before the newest vector leaves."""
    db = _stored_db(spark, sf_dir)
    db.set_ttl(360)
    db.expire(stored(spark, sf_dir).agg(F.max("ts_ms")).first()[0])
    return db.manifest.select("partition_key", "element_count")


@query(f"""SELECT doc_id, s // 4 AS chunk_no, s AS "from", least(s + 5, len(l)) AS "to", md5(array_to_string(l[s + 1:s + 5], '')) AS chunk
FROM (SELECT doc_id, l, unnest(range(0, (ceil(greatest(len(l) - 5, 0) / 4.0) * 4)::BIGINT + 1, 4)) AS s FROM {_LINES} WHERE len(l) > 0 AND doc_id % 2 = 0)
UNION ALL SELECT doc_id, s // 450, s, least(s + 500, length(text)), md5(substring(text, (s + 1)::BIGINT, 500)) FROM (SELECT doc_id, text, {_STARTS} AS s FROM documents WHERE length(text) > 0 AND doc_id % 2 = 1)""")
def split_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids taken for code and cut by lines, the others by characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".py").otherwise(".txt")).alias("path"))
    found = T.split_documents(docs)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("chunk_no", "from", "to")], F.md5("chunk").alias("chunk"))


@query("SELECT row_number() OVER (ORDER BY url) - 1 AS file_id, url AS file_path FROM (SELECT DISTINCT url FROM pages) QUALIFY contains(url, 'e')")
def path_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = files.build_index(table(spark, sf_dir, "pages").select(F.col("url").alias("file_path")))
    return index.join(files.query_index(index, "e"), "file_id", "left_semi")


@query("SELECT page_id FROM pages WHERE regexp_matches(string_split(url, '/')[-1], '(?i)^(?:(?:[a-m])|(?:.*[02468]$))')")
def names_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(files.name_matches(F.col("url"), ["[a-m]", ".*[02468]$"])).select("page_id")


@query("""SELECT url AS file_path, 'n' || page_id % 3 AS node_id, CASE WHEN page_id % 2 = 0 THEN 1 ELSE length(html) END::BIGINT AS file_size, CASE WHEN page_id % 3 = 1 THEN 'seen' ELSE '{}' END AS metadata
FROM (SELECT url, min(page_id) AS page_id, first(html ORDER BY page_id) AS html FROM pages GROUP BY url) WHERE page_id % 5 <> 0 AND page_id % 3 <> 2""")
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of files: rows put in, replaced, removed, and given metadata; then two nodes' rows."""
    pages = table(spark, sf_dir, "pages").groupBy("url").agg(F.min("page_id").alias("page_id"), F.min_by("html", "page_id").alias("html"))
    node = F.concat(F.lit("n"), (F.col("page_id") % 3).cast("string"))
    zero = F.lit(0).cast("long")
    rows = pages.select(F.col("url").alias("file_path"), node.alias("node_id"), F.length("html").cast("long").alias("file_size"), zero.alias("modified_time"), zero.alias("created_time"), F.lit("{}").alias("metadata"), zero.alias("last_scanned_time"), "page_id")
    plain = [c for c in rows.columns if c != "page_id"]
    catalog_rows = files.upsert(rows.limit(0).select(plain), rows.select(plain))
    catalog_rows = files.upsert(catalog_rows, rows.filter("page_id % 2 = 0").withColumn("file_size", F.lit(1).cast("long")).select(plain))
    catalog_rows = files.remove(catalog_rows, rows.filter("page_id % 5 = 0"))
    seen = catalog_rows.withColumn("metadata", F.when(F.col("node_id") == "n1", F.lit("seen")).otherwise(F.col("metadata")))
    nodes = files.by_node(seen, "n0").unionByName(files.by_node(seen, "n1"))
    return nodes.select("file_path", "node_id", "file_size", "metadata")


@query("""SELECT event_type, epoch_ms(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01')) AS start_ms, count(*) AS n FROM events
WHERE time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY ALL""")
def late_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream in order of time, then those of the first days once more: too late, so they don't count again."""
    rows = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = scratch_path(spark, "late-counts")
    stream = _streamed(spark, rows, "late", "at", rows.filter("ts < timestamp'2024-01-05'"))
    counts = windowed_counts(stream, "ts", "6 hours", "1 day", "event_type").select("event_type", F.unix_millis("window.start").alias("start_ms"), "n")
    counts.writeStream.format("parquet").option("checkpointLocation", scratch_path(spark, "late-state")).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


@query(ORACLES["batch_knn_join"])
def streaming_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of batch_knn_join as a stream that is answered micro-batch by micro-batch."""
    from .streaming.search import search_stream

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    wanted = rows.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding")
    out = scratch_path(spark, "answers")
    search_stream(_streamed(spark, wanted, "queries", "query_id"), rows, K, out, scratch_path(spark, "search-state")).awaitTermination()
    found = spark.read.schema("query_id long, id long, distance double, place int").parquet(out)
    return rounded(found.select("query_id", "id", "distance", F.col("place").cast("long").alias("place")), "distance")


@query()
def ann_ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at 10 of inverted lists against the exact search, and the part of all vectors that a query reads for it, for
    every query whose id is divisible by 50. These vectors lie evenly in 64 dimensions, so a high recall takes most lists."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    centres = ann.fit_centres(rows, lists=16)
    queries = [(r[0], r[1]) for r in rows.filter("id % 50 = 0").collect()]
    indexed = ann.index(rows, centres)
    exact = search.batch_knn(rows, queries, K).select("query_id", "id")
    return ann.recall(indexed, centres, queries, exact, K, probes=12)
