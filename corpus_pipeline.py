"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvane.llm import decontaminate, jaccard, packing, pii, quality
from sparkvane.llm.common import drop_path, new_path, stage


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality classifier takes for good, each by its own text; a null text is an empty one.

    Rows without doc_id go, as no operator scores or packs them; of rows that repeat, all stay or none. Empty tables: of
    documents, no rows; of labels, every row scores the same and stays.
    """
    return quality.keep(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    Rows that repeat its doc_id and text are exact copies, of which one stays; rows with its doc_id and another text stay.
    Rows without doc_id go; texts that are null or have no words are nobody's copies and stay. The texts are shuffled once,
    and once more only where doc_ids repeat.
    """
    others = jaccard.link_components(docs).select("doc_id", (F.col("doc_id") == F.col("component_id")).alias("first"))
    state = others.groupBy("doc_id").agg(F.min("first").alias("first"), F.count("*").alias("rows"))
    state = stage(state.filter("not first or rows > 1"), "copies")
    rest = docs.filter("doc_id is not null").join(state.select("doc_id").hint("shuffle_hash"), "doc_id", "left_anti")
    repeated = state.filter("first").select("doc_id")
    if repeated.isEmpty():
        return rest
    return rest.unionByName(docs.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    A null or empty text holds none; rows without doc_id go; rows that share a doc_id go together.
    """
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the new text. Null texts stay null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 1024 ids, with the ids; a null or empty text is its end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0, with_ids=True)


STAGES = [
    ("quality", keep_good),
    ("near_copies", keep_first_copies),
    ("benchmark", drop_benchmark),
    ("personal_data", mask_personal),
    ("packing", pack_windows),
]

#: The classifier, the tokenizer and the rewriting of disguised data are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result goes to the shared folder, and goes when the next one is there."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        f(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
