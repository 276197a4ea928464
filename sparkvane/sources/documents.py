"""Texts of files by their kind."""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import split_documents


def _pdf(data: bytes) -> str:
    import pypdf

    return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)


def _docx(data: bytes) -> str:
    import docx

    return "\n".join(p.text for p in docx.Document(io.BytesIO(data)).paragraphs)


def _sheets(data: bytes) -> str:
    sheets = pd.read_excel(io.BytesIO(data), sheet_name=None)
    return "\n".join(f"--- Sheet: {name} ---\n{t.to_string(index=False)}" for name, t in sheets.items())


def _html(data: bytes) -> str:
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style")

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style") and self.hidden > 0

        def handle_data(self, text):
            if not self.hidden and text.strip():
                self.parts.append(text.strip())

    r = Reader()
    r.feed(data.decode("utf-8", "replace"))
    return " ".join(r.parts)


def _json(data: bytes) -> str:
    return json.dumps(json.loads(data.decode("utf-8", "replace")), indent=2, ensure_ascii=False)


READERS = {"pdf": _pdf, "docx": _docx, "xls": _sheets, "xlsx": _sheets, "html": _html, "htm": _html, "json": _json}


def read_bytes(path: str, data: bytes) -> str:
    """A file's text; one that its reader, or a package it needs, can't take is read as plain text."""
    plain = lambda: data.decode("utf-8", "replace")
    reader = READERS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "")
    if reader is None:
        return plain()
    try:
        return reader(data)
    except Exception:
        return plain()


def load(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [read_bytes(p, c) for p, c in zip(b["path"], b["content"], strict=True)]})

    return reader.load(path).select("path", "content").mapInPandas(run, "path string, text string")


def load_chunks(spark: SparkSession, path: str, glob: str | None = None, **sizes) -> DataFrame:
    """Files as chunks, ready to embed and store."""
    return split_documents(load(spark, path, glob), **sizes)


def index_folder(spark: SparkSession, path: str, database, registry, model: str = "hashing", tag: str = "default", ts_ms: int = 0, glob: str | None = None, **sizes) -> int:
    """Files below a path as chunks, embedded and stored in a PartitionedDB as one batch named by the path; gives their number.

    A chunk's text is its label. Search with the same model's embedding of the question.
    """
    chunks = load_chunks(spark, path, glob, **sizes).filter(F.trim("chunk") != "")
    rows = chunks.select(F.pmod(F.xxhash64("path", "chunk_no"), F.lit(2**62)).alias("id"), registry.column(F.col("chunk"), model).alias("embedding"), "chunk", F.lit(ts_ms).cast("long").alias("ts_ms"), F.lit(tag).alias("tag"))
    return database.add_batch(rows, "folder-" + hashlib.sha256(path.encode()).hexdigest()[:16])
