"""Exact Jaccard self-join on word shingles by a grouped prefix join.

Two sets of which one holds n shingles and whose Jaccard similarity is T or more share one of the first
n - ceil(T n) + 1 shingles of each in any fixed order of all shingles: the prefix. The order here is: first the shingles
whose hash lies below a bound, rarest first by their document count over the whole table, then the others, rarest first
among the documents that come so far, and last the common ones of either kind. So a document with enough shingles of its
own has a prefix that nothing else can meet, whatever passages it shares, and most have enough below the bound.

1. Equal sets become one class. 2. Documents with the same prefix and size become one group. 3. Groups that share a
prefix shingle and whose sizes allow T are pairs: first each with the smallest of its shingle and size band, then those
that the first links left in different components. 4. Pairs of groups expand to members, and every pair is verified
by exact set sizes. Pairs already connected are not looked at again, so a group of n near copies takes about n checks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import drop_stage, narrow, stage
from .graph import components

WORDS = 5
PERCENT = 80
#: The part of all hashes below the bound. It must exceed 1 - T by enough that few documents need others as well.
LOW_PART = 0.26
BOUND = np.uint64(int(LOW_PART * 2**64))
#: Document count above which a shingle is common and stands last.
FREQUENT = 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text in bytes starts, and a 64-bit hash of it: a polynomial in an odd base over its bytes."""
    space = _SPACES[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return start, out
    length = end - start
    order = np.argsort(-length, kind="stable")
    at, sizes = start[order], length[order]
    for k in range(min(int(sizes[0]), 32)):
        live = np.searchsorted(-sizes, -k, side="left")
        out[:live] = (out[:live] + data[at[:live] + k] + np.uint64(1)) * _MULTIPLIER
    hashed = np.empty_like(out)
    hashed[order] = out
    for i in np.flatnonzero(length > 32):
        hashed[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    return start, _mix(hashed)


def shingle_sets(texts: list[str], k: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles; texts are hashed about a megabyte at a time."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    first, size = 0, 0
    for last, x in enumerate(raw):
        size += len(x) + 1
        if size < 1 << 20 and last + 1 < len(raw):
            continue
        part = raw[first : last + 1]
        start, words = _word_hashes(np.frombuffer(b" ".join(part).translate(_SMALL), np.uint8))
        ends = np.searchsorted(start, np.cumsum([len(x) + 1 for x in part]))
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            w = words[a:b]
            if len(w) < k:
                if len(w):
                    w = np.pad(w, (0, k - len(w)), constant_values=np.uint64(len(w)))
                else:
                    yield w
                    continue
            out = w[: len(w) - k + 1]
            for j in range(1, k):
                out = _mix(out) + w[j : len(w) - k + 1 + j]
            yield np.unique(_mix(out))
        first, size = last + 1, 0


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-n * percent // 100) + 1


def _profiles(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, n, digest, p, low, keys: the `low` shingles below the bound."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, s in zip(b.column("doc_id").to_pylist(), shingle_sets(b.column("text").to_pylist()), strict=True):
                p = prefix_size(len(s), percent) if len(s) else 0
                low = int(np.searchsorted(s, BOUND))
                digest = int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((doc, len(s), digest, p, low, s[:low].view(np.int64)))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:5]), pa.array(list(c[5]), pa.list_(pa.int64()))], ["doc_id", "n", "digest", "p", "low", "keys"])

    return narrow(docs).mapInArrow(run, "doc_id long, n long, digest long, p long, low long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, s, bits): the whole sets of the wanted documents, and of each a parity bitmap.

    Every shingle flips one bit, so two bitmaps differ in no more bits than the sets differ in shingles.
    """

    def run(batches):
        for b in batches:
            raw, bits = [], []
            for s in shingle_sets(b.column("text").to_pylist()):
                raw.append(s.tobytes())
                odd = np.bincount((s >> np.uint64(55)).astype(np.int64), minlength=512) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary()), pa.array(bits, pa.list_(pa.int64()))], ["c", "s", "bits"])

    return narrow(docs).join(wanted, "doc_id", "left_semi").mapInArrow(run, "c long, s binary, bits array<long>")


def _high_keys(sets: DataFrame) -> DataFrame:
    """(c, k) of the shingles at or above the bound."""

    def run(batches):
        for b in batches:
            for c, s in zip(b.column("c").to_pylist(), b.column("s"), strict=True):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                k = x[np.searchsorted(x, BOUND) :].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), c, np.int64)), pa.array(k)], ["c", "k"])

    return sets.mapInArrow(run, "c long, k long")


def _none():
    return F.array().cast("array<struct<df:bigint,k:bigint>>")


def _rare(x):
    return x["df"] <= FREQUENT


def _met(occurring: DataFrame) -> DataFrame:
    """(c, met): of (c, k), the shingles that others have as well, with their document counts."""
    shared = occurring.withColumn("df", F.count("*").over(W.partitionBy("k"))).filter("df > 1")
    return shared.groupBy("c").agg(F.collect_list(F.struct("df", "k")).alias("met"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("s"), b.column("t"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("c").alias("a"), "s"), sets.select(F.col("c").alias("b"), F.col("s").alias("t"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def link_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id that links reach).

    Null and empty texts, and texts of white space, have no shingles and are alone. Rows that repeat a doc_id count as one
    document with all their links. Rows without doc_id are left out; an empty table gives no rows.
    """
    profiles = stage(_profiles(docs, percent), "profiles")
    # Written first: a join right behind the grouping could not split a text that a third of all rows repeat.
    classes = stage(profiles.filter("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("c"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "classes")
    copies = profiles.filter("n > 0").select("doc_id", "n", "digest").join(classes, ["n", "digest"]).select("doc_id", "c")
    copies = stage(copies.filter("doc_id <> c").distinct(), "copies")

    own = profiles.filter("n > 0").join(copies.select("doc_id"), "doc_id", "left_anti")
    sized = own.select(F.col("doc_id").alias("c"), "n", "p", "low")
    # Below the bound: shingles of one document only stand first, then the rarest shared ones up to FREQUENT documents.
    low = _met(own.select(F.col("doc_id").alias("c"), F.explode("keys").alias("k")))
    first_level = sized.join(low, "c", "left").select("c", "n", "p", "low", F.coalesce("met", _none()).alias("met"))
    first_level = first_level.withColumn("slots", F.col("p") - F.col("low") + F.size("met")).filter("slots > 0")
    first_level = first_level.withColumn("rare", F.filter("met", _rare)).withColumn("common", F.filter("met", lambda x: ~_rare(x)))
    first_level = stage(first_level.drop("met"), "first-level")
    sets = stage(_sets(docs, first_level.select(F.col("c").alias("doc_id"))), "sets")
    # Those that lack shingles for their prefix go on above the bound; common shingles stand last of all.
    unfilled = first_level.filter(F.size("rare") < F.col("slots")).select("c")
    high = _met(_high_keys(sets.join(unfilled, "c", "left_semi")))
    levels = first_level.join(high.withColumnRenamed("met", "high"), "c", "left").withColumn("high", F.coalesce("high", _none()))
    alone = F.when(F.size("rare") < F.col("slots"), F.col("n") - F.col("low") - F.size("high")).otherwise(F.lit(0))
    levels = levels.withColumn("alone", alone).withColumn("rare", F.array_sort("rare"))
    left = F.greatest(F.col("slots") - F.size("rare") - F.col("alone"), F.lit(0)).cast("int")
    rest = F.concat(F.array_sort(F.filter("high", _rare)), F.array_sort("common"), F.array_sort(F.filter("high", lambda x: ~_rare(x))))
    chosen = F.concat(F.slice("rare", 1, F.least(F.col("slots"), F.size("rare")).cast("int")), F.slice(rest, 1, left))
    prefixed = levels.select("c", "n", "p", F.transform(chosen, lambda x: x["k"]).alias("keys")).filter(F.size("keys") > 0)
    prefixed = stage(prefixed.select("c", "n", "keys", F.when(F.size("keys") == F.col("p"), F.xxhash64("n", F.array_sort("keys"))).alias("prefix")), "prefixes")

    groups = prefixed.filter("prefix is not null").groupBy("n", "prefix").agg(F.min("c").alias("g"))
    member = prefixed.select("c", "n", "prefix").join(groups, ["n", "prefix"], "left").select("c", F.coalesce("g", "c").alias("g"))
    member = stage(member, "members")
    heads = prefixed.join(member.filter("c = g").select("c"), "c", "left_semi")
    keyed = stage(heads.select(F.col("c").alias("g"), "n", F.floor(F.log(F.col("n")) / math.log(100 / percent)).alias("band"), F.explode("keys").alias("k")), "keys")

    # First pairs: members with their group, groups with the smallest of a shingle and size band.
    least = keyed.groupBy("k", "band").agg(F.min("g").alias("m"), F.count("*").alias("size")).filter("size > 1")
    first = keyed.join(least, ["k", "band"]).filter("g <> m").select(F.col("m").alias("a"), F.col("g").alias("b"))
    first = stage(first.union(member.filter("c <> g").select(F.col("g").alias("a"), F.col("c").alias("b"))).distinct(), "pairs")
    links = stage(_verified(first, sets, percent), "links-first")
    found = stage(components(links), "components-first")

    # Second pairs: what shares a prefix shingle, may be similar by size and bitmap, and isn't connected yet.
    named = member.join(found.withColumnRenamed("node", "c"), "c", "left").select("c", "g", F.coalesce("component", "c").alias("component"))
    spread = named.join(keyed, "g").select("k", "n", "c", "component")
    several = spread.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("k")
    spread = stage(spread.join(several, "k", "left_semi").join(sets.select("c", "bits").dropDuplicates(["c"]), "c"), "spread")
    apart = sum((F.bit_count(F.get("x.bits", i).bitwiseXOR(F.get("y.bits", i))) for i in range(8)), F.lit(0))
    may = (apart * (100 + percent) <= (F.col("x.n") + F.col("y.n")) * (100 - percent)) & (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    other = (F.col("x.component") < F.col("y.component")) & may
    x, y = spread.alias("x"), spread.alias("y")
    second = x.join(y, (F.col("x.k") == F.col("y.k")) & other).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"))
    grouped = named.join(prefixed.select("c", "n"), "c").join(sets.select("c", "bits").dropDuplicates(["c"]), "c")
    x, y = grouped.alias("x"), grouped.alias("y")
    second = second.union(x.join(y, (F.col("x.g") == F.col("y.g")) & other).select(F.col("x.c"), F.col("y.c")))
    more = stage(_verified(second.distinct(), sets, percent), "links-second")
    every = components(links.union(more).union(copies.select(F.col("c").alias("a"), F.col("doc_id").alias("b"))))
    joined = profiles.select("doc_id", F.col("n").alias("n_shingles")).join(every.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    result = joined.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    result = stage(result, "components")
    for s in (profiles, classes, copies, first_level, sets, prefixed, member, keyed, first, links, found, spread, more):
        drop_stage(s)
    return result
