"""Session helpers shared by the operators of this package."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a new local one where that is unset and Spark is local, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stage_path = path
    return found


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a folder of the shared folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def drop_stage(df: DataFrame) -> None:
    """Removes the files of a stage that nothing reads any more."""
    drop_path(df.sparkSession, df._stage_path)


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id and text, whatever else a table has; a null text is an empty one, a row without doc_id goes."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).filter(F.col("doc_id").isNotNull())


def partition_totals(df: DataFrame, part: str, amount: str) -> tuple[list[int], list[int]]:
    """Exclusive prefix sums of a number by partition: the partitions and where each begins. A few bytes a partition."""
    rows = df.groupBy(part).agg(F.sum(amount).alias("total")).orderBy(part).collect()
    at, starts = 0, []
    for r in rows:
        starts.append(at)
        at += r["total"] or 0
    return [r[part] for r in rows], starts


def one_thread() -> None:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
