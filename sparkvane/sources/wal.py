"""Packed record logs: u64 id, u64 ms, u32 text length, f32 components, text; little-endian, one after another."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

HEAD = struct.Struct("<QQI")


def pack_record(id: int, ts_ms: int, vector, text: str) -> bytes:
    body = text.encode()
    return HEAD.pack(id, ts_ms, len(body)) + np.asarray(vector, "<f4").tobytes() + body


def unpack(data: bytes, dimension: int) -> list[tuple]:
    """(id, ts_ms, vector, text) of each record; one that ends early is an error."""
    out, at = [], 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError("a record's head ends early")
        id, ts, size = HEAD.unpack_from(data, at)
        at += HEAD.size
        end = at + 4 * dimension + size
        if end > len(data):
            raise ValueError("a record ends early")
        vector = np.frombuffer(data, "<f4", dimension, at)
        out.append((id, ts, vector, data[at + 4 * dimension : end].decode("utf-8", "replace")))
        at = end
    return out


def read(spark: SparkSession, path: str, dimension: int, tag: str = "default") -> DataFrame:
    """The records of all logs below a path as vectors; seq goes by file name, then place. A broken log fails the query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, data in zip(b["path"], b["content"], strict=True):
                rows = unpack(data, dimension)
                yield pd.DataFrame({
                    "id": [r[0] for r in rows], "embedding": [r[2] for r in rows], "chunk": [r[3] for r in rows], "ts_ms": [r[1] for r in rows],
                    "tag": tag, "log": name.rsplit("/", 1)[-1], "place": range(len(rows)),
                }).astype({"id": "int64", "ts_ms": "int64", "place": "int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "id long, embedding array<float>, chunk string, ts_ms long, tag string, log string, place long")
