"""Token ids as canonical length-limited Huffman codes.

A file set is a folder with `codebook` (one row: the code length of every id) and `blocks`. A block holds whole
documents in ascending doc_id order and decodes by itself:

    magic "HB01", documents u32, ids u32, step u32, doc_id i64 each, ids u32 each, bit offset u32 of every step-th id, bits

Counting is one aggregation over all ids; lengths come from package-merge over the counted ids, which the vocabulary
bounds. Ids within a block are decoded many at a time: one lane for each bit offset, all lanes through one table.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stage, new_path, partition_totals, stage
from .packing import encode_documents

MAGIC = b"HB01"
BLOCK_IDS = 1 << 18
#: Ids that a writing task gets, about.
PARTITION_IDS = 1 << 22
STEP = 128


def limited_lengths(counts: np.ndarray, limit: int = 16) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits by package-merge; 0 for an id that never occurs."""
    used = np.flatnonzero(counts)
    n = len(used)
    lengths = np.zeros(len(counts), np.uint8)
    if n <= 1:
        lengths[used] = 1
        return lengths
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.int64)
    levels, row = [], leaves
    levels.append(np.ones(n, bool))
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        row = both[order]
        levels.append(order < n)
    take, deep = 2 * n - 2, np.zeros(n, np.int64)
    for leaf in reversed(levels):
        k = int(leaf[:take].sum())
        deep[:k] += 1
        take = 2 * (take - k)
    lengths[used] = deep
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size.max())
        step = np.int64(1) << (top - size)
        codes[order] = ((np.cumsum(step) - step) >> (top - size)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and length for each value of the next `bits` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    bits = int(lengths.max(initial=1))
    reps = 1 << (bits - lengths[order].astype(np.int64))
    ids = np.zeros(1 << bits, np.uint32)
    size = np.ones(1 << bits, np.int64)
    n = int(reps.sum())
    ids[:n], size[:n] = np.repeat(order, reps), np.repeat(lengths[order], reps)
    return ids, size, bits


def encode_block(names: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> bytes:
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, bit = at >> 6, at & 63
        shift = 64 - bit - size
        code = codes[ids]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        high = np.where(shift >= 0, code << np.maximum(shift, 0).astype(np.uint64), code >> np.maximum(-shift, 0).astype(np.uint64))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
    head = struct.pack("<4sIII", MAGIC, len(names), len(ids), STEP)
    return b"".join((head, names.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), at[::STEP].astype("<u4").tobytes(), words.astype(">u8").tobytes()))


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids)."""
    magic, docs, n, step = struct.unpack_from("<4sIII", block)
    if magic != MAGIC:
        raise ValueError("not a block of Huffman codes")
    at = 16
    names = np.frombuffer(block, "<i8", docs, at)
    sizes = np.frombuffer(block, "<u4", docs, at := at + 8 * docs)
    lanes = -(-n // step)
    pos = np.frombuffer(block, "<u4", lanes, at := at + 4 * docs).astype(np.int64)
    data = np.frombuffer(block, ">u4", -1, at + 4 * lanes).astype(np.uint64)
    pairs = (data[:-1] << np.uint64(32)) | data[1:]
    value, size, bits = table
    out = np.empty((step, lanes), np.uint32)
    for k in range(step):
        live = lanes if k < n - (lanes - 1) * step else lanes - 1
        p = pos[:live]
        peek = (pairs[p >> 5] >> (64 - bits - (p & 31)).astype(np.uint64)).astype(np.int64) & ((1 << bits) - 1)
        out[k, :live] = value[peek]
        p += size[peek]
    return names, sizes, out.T.reshape(-1)[:n]


def count_ids(staged: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all rows; each task adds up its own first."""

    def run(batches):
        counts = np.zeros(vocabulary, np.int64)
        for b in batches:
            for ids, n in zip(b.column("ids"), b.column("n").to_numpy(), strict=True):
                raw = ids.as_buffer()
                got = np.bincount(np.frombuffer(raw, f"<u{raw.size // n}"), minlength=0)
                counts[: len(got)] += got
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = staged.select("ids", "n").mapInArrow(run, "id long, n long").groupBy("id").sum("n").collect()
    counts = np.zeros(vocabulary, np.int64)
    for i, n in rows:
        counts[i] = n
    return counts


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, limit: int = 16) -> None:
    """Encodes documents with a tokenizer and writes them to `path` in ascending doc_id order.

    A null or empty text is the end id alone. Rows with equal doc_id are all kept, ordered by size, first eight ids and
    place in the table, and may be dealt to several tasks; an empty table gives an empty file set. A block takes a
    document of any length whole, so it holds more than BLOCK_IDS ids only where one document does.
    """
    from .tokens import encoder

    spark = docs.sparkSession
    vocabulary = encoder(tokenizer).tokenizer.get_vocab_size() + 1
    staged = stage(encode_documents(docs, tokenizer, end_id), "huffman-ids")
    counts = count_ids(staged, max(vocabulary, end_id + 1))
    lengths = limited_lengths(counts, limit)
    book = spark.sparkContext.broadcast(lengths)

    def run(batches):
        codes, part = canonical_codes(book.value), TaskContext.get().partitionId()
        names, sizes, ids, held, block, at = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, sizes, ids, held, block, at
            joined = np.concatenate(ids)
            row = pa.RecordBatch.from_pylist(
                [{"part": part, "block": block, "at": at, "n": held, "data": encode_block(np.array(names), np.array(sizes), joined, book.value, codes)}],
                schema=pa.schema([("part", pa.int32()), ("block", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())]),
            )
            names, sizes, ids, at, held, block = [], [], [], at + held, 0, block + 1
            return row

        for b in batches:
            for doc, n, x in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if held and held + n > BLOCK_IDS:
                    yield flush()
                names.append(doc)
                sizes.append(n)
                ids.append(np.frombuffer(x, f"<u{len(x) // n}"))
                held += n
        if held:
            yield flush()

    order = ["doc_id", "n", "first", "part", "at"]
    ordered = staged.withColumn("first", F.substring("ids", 1, 16)).repartitionByRange(int(counts.sum()) // PARTITION_IDS + 1, *order).sortWithinPartitions(*order)
    ordered.select("doc_id", "n", "ids").mapInArrow(run, "part int, block long, at long, n long, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    drop_stage(staged)


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, ids (unsigned 32-bit, or null)."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codebook").first()[0], np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts, starts = partition_totals(blocks, "part", "n")
    book = spark.sparkContext.broadcast((lengths, dict(zip(parts, starts, strict=True))))

    def run(batches):
        lengths, begins = book.value
        table = decoding_table(lengths)
        for b in batches:
            for part, at, data in zip(b.column("part").to_pylist(), b.column("at").to_pylist(), b.column("data"), strict=True):
                names, sizes, ids = decode_block(data.as_buffer(), table)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = [ids[e - s : e].tobytes() for s, e in zip(sizes.astype(np.int64), ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names), pa.array(begins[part] + at + ends - sizes), pa.array(sizes.astype(np.int64)), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if with_ids else [None] * len(raw), pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the documents' ids into the shared folder and reads them back from there."""
    path = new_path(docs.sparkSession, "huffman")
    write_ids(docs, tokenizer, path, end_id)
    return read_ids(docs.sparkSession, path, with_ids=False)
