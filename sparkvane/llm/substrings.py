"""Removal of long repeated byte strings with run-compressed indexes.

A corpus is too large for one index, so its 200-byte windows are first dealt out by content. The anchor of a window is
its leftmost smallest 32-byte hash; equal windows have equal anchors, so a window whose anchor stands nowhere else is
unique. Neighbouring windows with the same anchor occurrence form a segment, and every window lies in one segment.

1. Segments whose anchor hash occurs once are done. 2. A segment that occurs as a whole again is repeated throughout.
3. Where an anchor has different segments, one of each goes to the anchor's cell, where a run-length index is built:
the Burrows-Wheeler transform as runs, with common prefixes sampled at both ends of each run. Streaming the segments
through the runs gives every position's matching statistic, and those of 200 or more are long matches. An anchor with more different segments than a cell may hold, such as at the edge of a passage that a third
of all documents share, has its windows counted by hash instead, which needs no cell. 4. Marks go back to documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, narrow, stage

LENGTH = 200
GRAM = 32
#: Different segments of an anchor that a cell takes, and about how many bytes a cell holds.
SEGMENTS_A_CELL, CELL_BYTES = 2048, 1 << 20
_PLACE_BITS = 24
_PIECE = 1 << 18
_BYTES = np.random.default_rng(12345).integers(1, 2**63, (3, 256), dtype=np.uint64) | np.uint64(1)
#: Odd bases of the two polynomials behind a digest.
_BASES = (0xD1342543DE82EF95, 0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def _gram_hashes(x: np.ndarray) -> np.ndarray:
    h, base = _BYTES[0][x], 0x9E3779B97F4A7C15
    step = 1
    while step < GRAM:
        h = h[:-step] * np.uint64(base) + h[step:]
        base = base * base % 2**64
        step *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _windows_least(key: np.ndarray, width: int) -> np.ndarray:
    m, have = key, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(key) - width + 1], m[width - have :]) if width > have else m


def _digests(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, from the prefix sums of two polynomials over random values of the bytes."""
    if not _POWERS:
        _POWERS.extend(np.cumprod(np.r_[np.uint64(1), np.full(4 * _PIECE - 1, b, np.uint64)]) for b in _BASES)
    out = np.zeros(len(start), np.uint64)
    for values, powers in zip(_BYTES[1:], _POWERS, strict=True):
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(values[x] * powers[: len(x)], out=sums[1:])
        found = (sums[end] - sums[start]) * powers[len(powers) - 1 - start]
        found = (found ^ (found >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out = (out ^ (out << np.uint64(21))) + (found ^ (found >> np.uint64(32)))
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def _grouped(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, place, part): the parts of all texts in groups of about _PIECE bytes; a window lies in one part."""
    group, size = [], 0
    for i, data in enumerate(texts):
        for at in range(0, max(len(data) - length + 1, 0), _PIECE):
            group.append((i, at, data[at : at + _PIECE + length - 1]))
            size += len(group[-1][2])
            if size >= _PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def segments(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text, start, end, anchor, digest): segments, each the union of its windows, with the hash of its anchor and of its bytes."""
    out = [[np.zeros(0, np.int64)] * 5]
    for group in _grouped(texts, length):
        x = np.frombuffer(b"".join(p for *_, p in group), np.uint8)
        size = np.array([len(p) for *_, p in group])
        begin = np.cumsum(size) - size
        h = _gram_hashes(x)
        mask = np.uint64((1 << _PLACE_BITS) - 1)
        least = _windows_least((h & ~mask) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
        place = (least & mask).astype(np.int64)
        # A segment ends where the anchor changes and where the windows of a part end; windows across parts are dropped.
        stop = begin + size - length + 1
        new = np.r_[True, place[1:] != place[:-1]]
        new[begin] = True
        new[stop[stop < len(new)]] = True
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(place)] - 1
        part = np.searchsorted(begin, first, side="right") - 1
        own = first < stop[part]
        first, last, part = first[own], last[own], part[own]
        which, at = np.array([i for i, *_ in group]), np.array([a for _, a, _ in group])
        shift = at[part] - begin[part]
        out.append([which[part], first + shift, last + length + shift, h[place[first]].view(np.int64), _digests(x, first, last + length)])
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class RunIndex:
    """The Burrows-Wheeler transform of some strings as runs, with samples at run ends; nothing else is kept of the strings.

    A run is a symbol, its first row and the row that this one's text position is preceded at. Samples are kept of each
    run's two ends: what the suffix that is one longer has in common with its neighbour above, or below. Within a run that
    is one more than for the suffix before, as neighbours stay neighbours. So streaming a string from its end to its start
    through the runs gives each position's longest prefix that stands elsewhere too: its matching statistic.
    """

    def __init__(self, strings: list[bytes]):
        parts, self.starts, n = [], [], 0
        for i, s in enumerate(strings):
            body = np.frombuffer(s, np.uint8).astype(np.uint16) + np.uint16(1)
            parts += [body, np.array([0, i & 0xFF, i >> 8 & 0xFF, i >> 16 & 0xFF], np.uint16)]
            self.starts.append(n)
            n += len(s) + 4
        text = np.concatenate(parts) if parts else np.zeros(0, np.uint16)
        self.n, self.sizes = n, np.array([len(s) for s in strings], np.int64)
        if not n:
            self.symbols, self.begin, self.lengths = text, np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        ranks, order = self._sort(text)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        before = np.where(order > 0, text[order - 1], np.uint16(0xFFFF))
        self.begin = np.flatnonzero(np.r_[True, before[1:] != before[:-1]])
        self.symbols, self.lengths = before[self.begin], np.diff(np.r_[self.begin, n])
        last = self.begin + self.lengths - 1
        to_head, to_last = place[order[self.begin] - 1], place[order[last] - 1]
        self.to = to_head
        self.above, self.below = (self._common(text, ranks, order, r, r + d) for r, d in ((to_head, -1), (to_last, 1)))
        self.rows = place[np.array(self.starts) + self.sizes]
        self.up, self.down = (self._common(text, ranks, order, self.rows, self.rows + d) for d in (-1, 1))

    @staticmethod
    def _sort(text: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray]:
        """Ranks of all suffixes by their first 4, 8, ... symbols until all differ, and the suffix order."""
        n = len(text)
        if not n:
            return [], np.zeros(0, np.int64)
        wide = np.zeros(n + 4, np.uint64)
        wide[:n] = text
        key = (wide[:n] << np.uint64(48)) | (wide[1 : n + 1] << np.uint64(32)) | (wide[2 : n + 2] << np.uint64(16)) | wide[3 : n + 3]
        ranks, span = [], 4
        while True:
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int32)
            number = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            rank[order] = number
            ranks.append((span, rank))
            if number[-1] == n - 1 or span >= n:
                return ranks, order
            key = (rank.astype(np.uint64) + np.uint64(1)) * np.uint64(n + 2)
            key[: n - span] += rank[span:].astype(np.uint64) + np.uint64(1)
            span *= 2

    @staticmethod
    def _common(text, ranks, order, row, other) -> np.ndarray:
        """How many symbols the suffixes of two rows have in common; 0 where the other row isn't there."""
        common, n = np.zeros(len(row), np.int64), len(order)
        ok = np.flatnonzero((other >= 0) & (other < n))
        start = order[row[ok]]
        a, b = start.copy(), order[other[ok]].copy()
        for span, rank in [*reversed(ranks), *[(1, text)] * 3]:
            both = np.maximum(a, b) < n
            same = np.zeros(len(a), bool)
            same[both] = rank[a[both]] == rank[b[both]]
            a[same] += span
            b[same] += span
        common[ok] = a - start
        return common

    def matching_statistics(self) -> np.ndarray:
        """For each position, the longest prefix of its suffix that stands elsewhere too; all strings are streamed at once."""
        out = np.zeros(self.n, np.int64)
        if not self.n:
            return out
        live = np.argsort(-self.sizes, kind="stable")
        row, up, down = self.rows[live], self.up[live], self.down[live]
        at, sizes = np.array(self.starts)[live] + self.sizes[live], self.sizes[live]
        for step in range(1, int(sizes[0]) + 1 if len(sizes) else 1):
            k = int(np.searchsorted(-sizes, -step, side="right"))
            row, up, down = row[:k], up[:k], down[:k]
            run = np.searchsorted(self.begin, row, side="right") - 1
            inside = row - self.begin[run]
            up = np.where(inside == 0, self.above[run], up + 1)
            down = np.where(inside == self.lengths[run] - 1, self.below[run], down + 1)
            row = self.to[run] + inside
            out[at[:k] - step] = np.maximum(up, down)
        return out


def _ranges(flags: np.ndarray) -> bytes:
    """Runs of true flags as pairs of unsigned 16-bit numbers, end exclusive."""
    edge = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    return edge.astype("<u2").tobytes()


def long_matches(strings: list[bytes], length: int = LENGTH) -> list[bytes]:
    """For each string, the ranges of starts at which `length` bytes stand elsewhere too."""
    index = RunIndex(strings)
    m = index.matching_statistics()
    return [_ranges(m[a : a + len(s) - length + 1] >= length) for a, s in zip(index.starts, strings, strict=True)]


def _bytes_of(column) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def _slices(batches, rows: int = 2000):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, a name for each row: doc_id and a hash of the text; rows equal in both are one row with a count."""
    return narrow(docs).withColumn("tk", F.xxhash64("text"))


def _anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, h, s, n): how often each different segment stands in each row."""

    def run(batches):
        for b in _slices(batches):
            text, _, _, h, s = segments(_bytes_of(b.column("text")))
            order = np.lexsort((s, h, text))
            text, h, s = text[order], h[order], s[order]
            new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (h[1:] != h[:-1]) | (s[1:] != s[:-1])]) if len(text) else text
            n = np.diff(np.r_[new, len(text)])
            doc, tk = (b.column(c).to_numpy(zero_copy_only=False)[text[new]] for c in ("doc_id", "tk"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, tk, h[new], s[new], n)], ["doc_id", "tk", "h", "s", "n"])

    return docs.mapInArrow(run, "doc_id long, tk long, h long, s long, n long")


def _marked(b: pa.RecordBatch, column: str) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, data, start, end, anchor, mark) of each row with marks: its segments that are among them, and which mark each is."""
    marks = b.column(column)
    rows = np.flatnonzero(np.asarray(marks.is_valid()))
    texts = _bytes_of(b.column("text").take(pa.array(rows)))
    text, start, end, h, s = segments(texts)
    cuts, offsets = np.searchsorted(text, np.arange(len(rows) + 1)), marks.offsets.to_numpy()
    names = marks.values.field("s").to_numpy(zero_copy_only=False)
    for k, i in enumerate(rows.tolist()):
        own = slice(cuts[k], cuts[k + 1])
        low, high = offsets[i], offsets[i + 1]
        order = low + np.argsort(names[low:high], kind="stable")
        found = np.minimum(np.searchsorted(names[order], s[own]), len(order) - 1)
        hit = names[order[found]] == s[own] if len(order) else np.zeros(len(found), bool)
        yield i, texts[k], start[own][hit], end[own][hit], h[own][hit], order[found[hit]]


def _extract(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, s, hot, body) of the wanted (doc_id, tk, h, s, hot) segments."""
    lists = wanted.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("s", "hot")).alias("wanted"))
    few = docs.join(lists, ["doc_id", "tk"])

    def run(batches):
        for b in _slices(batches):
            out: list[list] = [[], [], [], []]
            s, hot = (b.column("wanted").values.field(c).to_numpy(zero_copy_only=False) for c in ("s", "hot"))
            for _, data, start, end, h, mark in _marked(b, "wanted"):
                _, once = np.unique(mark, return_index=True)
                for c, v in zip(out, (h[once], s[mark[once]], hot[mark[once]], [data[x:y] for x, y in zip(start[once].tolist(), end[once].tolist(), strict=True)]), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.bool_(), pa.binary()), strict=True)], ["h", "s", "hot", "body"])

    return few.select("text", "wanted").mapInArrow(run, "h long, s long, hot boolean, body binary").dropDuplicates(["h", "s"])


def _cells(bodies: DataFrame, cells: int) -> DataFrame:
    """(h, s, ranges) through a run-length index in each cell."""

    def run(_, t):
        found = long_matches(t.column("body").to_pylist())
        out = pa.table({"h": t.column("h"), "s": t.column("s"), "ranges": pa.array(found, pa.binary())})
        return out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))

    dealt = bodies.withColumn("cell", F.pmod("h", F.lit(cells)))
    return dealt.groupBy("cell").applyInArrow(run, "h long, s long, ranges binary")


def _counted(bodies: DataFrame) -> DataFrame:
    """(h, s, ranges) by counting the windows of anchors with too many segments for a cell."""

    def run(batches):
        for b in _slices(batches, 1000):
            bodies = b.column("body").to_pylist()
            size = np.array([len(x) for x in bodies])
            n = size - LENGTH + 1
            begin, row = np.cumsum(size) - size, np.repeat(np.arange(len(n)), n)
            i = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = begin[row] + i
            w = _digests(np.frombuffer(b"".join(bodies), np.uint8), start, start + LENGTH)
            h, s = (b.column(c).to_numpy(zero_copy_only=False)[row] for c in ("h", "s"))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (h, s, i, w)], ["h", "s", "i", "w"])

    windows = stage(bodies.select("h", "s", "body").mapInArrow(run, "h long, s long, i long, w long"), "windows")
    again = windows.groupBy("w").agg(F.count("*").alias("n")).filter("n > 1").select("w")
    starts = windows.join(again, "w", "left_semi").groupBy("h", "s").agg(F.sort_array(F.collect_set("i")).alias("at"))

    def ranges(batches):
        for b in batches:
            out = []
            for at in b.column("at").to_pylist():
                flags = np.zeros(max(at) + 1, bool)
                flags[at] = True
                out.append(_ranges(flags))
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("s"), pa.array(out, pa.binary())], ["h", "s", "ranges"])

    return starts.mapInArrow(ranges, "h long, s long, ranges binary")


def remove_repeats(docs: DataFrame, with_kept: bool = False) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256 and, with_kept, the bytes kept.

    A null or empty text, and any of fewer than 200 bytes, keeps all it has. Repeated rows are documents of their own,
    so their long strings repeat. Rows without doc_id are left out; an empty table gives no rows.
    """
    docs = _keyed(docs)
    anchors = stage(_anchors(docs), "anchors")
    twice = anchors.groupBy("h").agg(F.sum("n").alias("c")).filter("c > 1").select("h")
    common = stage(anchors.join(twice, "h", "left_semi"), "anchors-shared")
    drop_stage(anchors)
    kinds = common.groupBy("h", "s").agg(F.sum("n").alias("c"), F.min(F.struct("doc_id", "tk")).alias("at"))
    kinds = stage(kinds, "segments")
    by_anchor = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("c").alias("least"))
    open_anchors = by_anchor.filter("kinds > 1 and least = 1").select("h", (F.col("kinds") > SEGMENTS_A_CELL).alias("hot"))
    wanted = kinds.join(open_anchors, "h").select("at.doc_id", "at.tk", "h", "s", "hot")
    bodies = stage(_extract(docs, wanted), "segment-bytes")
    total = bodies.filter("not hot").agg(F.sum(F.length("body"))).first()[0] or 0
    found = _cells(bodies.filter("not hot"), total // CELL_BYTES + 1).union(_counted(bodies.filter("hot")))
    partly = stage(found, "matches")
    marks = kinds.select("h", "s", "c").join(partly, ["h", "s"], "left").filter("c > 1 or ranges is not null")
    marks = marks.select("h", "s", F.when(F.col("c") == 1, F.col("ranges")).alias("ranges"))
    by_doc = common.join(marks, ["h", "s"]).groupBy("doc_id", "tk").agg(F.collect_list(F.struct("s", "ranges")).alias("marks"))

    def run(batches):
        for b in _slices(batches):
            names, out = b.column("doc_id").to_pylist(), [None] * b.num_rows
            ranges = b.column("marks").values.field("ranges")

            def told(i, data, flags):
                kept = data if flags is None else np.frombuffer(data, np.uint8)[~flags].tobytes()
                spans = 0 if flags is None else int((np.diff(np.r_[False, flags].astype(np.int8)) == 1).sum())
                out[i] = (names[i], len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if with_kept else None)

            for i, data, start, end, _, mark in _marked(b, "marks"):
                part = np.asarray(ranges.take(pa.array(mark)).is_valid()) if len(mark) else np.zeros(0, bool)
                size = len(data) + 1
                pairs = [np.stack([start[~part], end[~part]], axis=1)]
                for at, m in zip(start[part].tolist(), mark[part].tolist(), strict=True):
                    pairs.append(at + np.frombuffer(ranges[m].as_py(), "<u2").reshape(-1, 2).astype(np.int64) + (0, LENGTH - 1))
                opened, closed = np.concatenate(pairs).T
                gone = np.bincount(opened, minlength=size) - np.bincount(closed, minlength=size)
                told(i, data, np.cumsum(gone[:-1]) > 0)
            rest = [i for i, x in enumerate(out) if x is None]
            for i, data in zip(rest, _bytes_of(b.column("text").take(pa.array(rest, pa.int64()))), strict=True):
                told(i, data, None)
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = docs.join(by_doc, ["doc_id", "tk"], "left").select("doc_id", "text", "marks")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
