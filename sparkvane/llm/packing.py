"""Concatenate and cut: documents in a row, cut into fixed windows.

Pass one encodes each document once and writes the ids with each document's offset within its partition. The totals of
the partitions, summed up in order, are where each partition begins; with them pass two knows every id's place and cuts
at the multiples of the window without moving a row. A window that two partitions share gets pieces from both: the
boundary records, marked `boundary`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, partition_totals, stage
from .tokens import encoder

STAGED = "part int, at long, doc_id long, n long, ids binary"
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"
)


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows (part, at, doc_id, n, ids): the ids of each text with end_id behind, and its place in its partition."""

    def run(batches):
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for b in batches:
            names = b.column("doc_id").to_pylist()
            texts = b.column("text")
            for k in range(0, len(names), 512):
                ids = [x + end for x in enc.encode(texts[k : k + 512].to_pylist())]
                n = np.array([len(x) // enc.width for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(names[k : k + 512], pa.int64()), pa.array(n), pa.array(ids, pa.binary())],
                    ["part", "at", "doc_id", "n", "ids"],
                )

    return narrow(docs).mapInArrow(run, STAGED)


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document in a window of `window` ids.

    Documents follow one another as they are read. A null or empty text is the end id alone; repeated rows and equal
    doc_ids are documents of their own; an empty table gives no rows; rows without doc_id are left out. Every window
    is full but the last. with_ids: the pieces hold their ids, else null.
    """
    spark = docs.sparkSession
    staged = stage(encode_documents(docs, tokenizer, end_id), "pack-ids")
    parts, starts = partition_totals(staged, "part", "n")
    begins = spark.sparkContext.broadcast(dict(zip(parts, starts, strict=True)))
    edges = spark.sparkContext.broadcast(frozenset(s // window for s in starts if s % window))

    def run(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for part, at, doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("part", "at", "doc_id", "n", "ids")), strict=True):
                got = np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4")
                g, i = begins.value[part] + at, 0
                while i < n:
                    seq, off = divmod(g + i, window)
                    k = min(window - off, n - i)
                    piece = got[i : i + k].tobytes()
                    for c, v in zip(cols, (doc, i, k, zlib.crc32(piece), n, seq, off, seq in edges.value, piece if with_ids else None), strict=True):
                        c.append(v)
                    i += k
            kinds = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary", "ids"],
            )

    return staged.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame, window: int = 1024, pad_id: int = 0) -> DataFrame:
    """The windows themselves, (sequence_id, ids as unsigned 32-bit, n_ids), from pieces that hold ids.

    At most `window` pieces meet in a group. A last window is padded with pad_id unless its size is a power of two. Pieces
    without ids, as pack gives them by default, are an error; no pieces give no rows.
    """

    def fill(parts: pa.Array) -> pa.Array:
        out = []
        for row in parts.to_pylist():
            ids = b"".join(row)
            n = len(ids) // 4
            out.append(ids if n & (n - 1) == 0 else ids + np.full(window - n, pad_id, "<u4").tobytes())
        return pa.array(out, pa.binary())

    joined = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_ids"))
    return joined.select("sequence_id", F.arrow_udf(fill, "binary")(F.col("p.ids")).alias("ids"), "n_ids")
