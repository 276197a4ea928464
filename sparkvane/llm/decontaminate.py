"""Benchmark decontamination by MinHash containment with a size bound, in DataFrame functions only.

A document that holds a part T of an item's n shingles lacks at most n - ceil(T n) of them, so it holds one at least of
the item's n - ceil(T n) + 1 smallest shingle hashes, its MinHash signature. Each size of item has a signature of that
length, and all of them are in one index; a document is looked up with all its shingles, and items that it is too small
to contain are dropped by their size. Candidates are then verified by exact containment. No item in a document is missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .licenses import grams, words

WORDS = 5
THRESHOLD_PERCENT = 80
#: Index rows (8 byte hash, item and size) up to which an index is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _shingled(table: DataFrame, key: str) -> DataFrame:
    """(key, text_key, shingles, n): distinct shingle hashes; a text of fewer words is one shingle, one without none."""
    w = table.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).select(key, F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("w"))
    rolled = (
        F.when(F.size("w") >= WORDS, grams(F.col("w"), WORDS))
        .when(F.size("w") > 0, F.array(F.xxhash64(F.lit("short"), F.array_join("w", " "))))
        .otherwise(F.array().cast("array<bigint>"))
    )
    # Take them apart with explode_outer: what is inferred from explode would split a text again for every shingle.
    return w.select(key, "text_key", rolled.alias("shingles"))


def _sized(index: DataFrame) -> DataFrame:
    """Broadcast only under the checked bound."""
    return F.broadcast(index) if index.count() <= BROADCAST_ROWS else index.hint("merge")


def contained(docs: DataFrame, items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): items of which a document holds `percent` of the distinct shingles or more.

    Items and documents without words match nothing, as do null texts; an item of fewer than five words matches a
    document of just these words. Rows without an id are left out; of repeated rows, and of rows with equal ids, the
    largest n_found counts.
    """
    sets = _shingled(items, "item_id").select("item_id", "text_key", F.array_sort(F.array_distinct("shingles")).alias("s"))
    sets = stage(sets.withColumn("n", F.size("s")).filter("n > 0").dropDuplicates(["item_id", "text_key"]).withColumnRenamed("text_key", "item_key"), "items")
    need = F.col("n") * percent
    signature = F.slice("s", F.lit(1), F.col("n") - F.ceil(need / 100).cast("int") + 1)
    keys = stage(sets.select("item_id", "item_key", "n", F.explode(signature).alias("h")), "item-keys")
    whole = stage(sets.select("item_id", "item_key", "n", F.explode("s").alias("h")), "item-shingles")

    rolled = _shingled(docs, "doc_id")
    looked = rolled.select("doc_id", "text_key", F.size("shingles").alias("m"), F.explode_outer("shingles").alias("h"))
    candidates = looked.join(_sized(keys), "h").filter(F.col("m") * 100 >= need).select("doc_id", "text_key", "item_id", "item_key").distinct()
    candidates = stage(candidates, "candidates")

    few = candidates.select(F.col("doc_id").alias("wanted")).distinct()
    chosen = docs.join(few, docs["doc_id"] == few["wanted"], "left_semi").select("doc_id", "text")
    again = _shingled(chosen, "doc_id").select("doc_id", "text_key", F.explode_outer(F.array_distinct("shingles")).alias("h"))
    hits = again.join(_sized(whole), "h").groupBy("doc_id", "text_key", "item_id", "item_key", "n").agg(F.size(F.collect_set("h")).alias("found"))
    verified = hits.join(candidates, ["doc_id", "text_key", "item_id", "item_key"], "left_semi").filter(F.col("found") * 100 >= need)
    return verified.groupBy("doc_id", "item_id").agg(
        F.max_by("n", "found").cast("long").alias("n_shingles"), F.max("found").cast("long").alias("n_found")
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item; rows without doc_id go, and rows that share a doc_id go together."""
    bad = contained(docs, items).select("doc_id").distinct()
    return docs.filter(F.col("doc_id").isNotNull()).join(bad, "doc_id", "left_anti")
