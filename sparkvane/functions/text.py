"""Chunkers and string helpers as columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_EXTENSIONS = ("py", "js", "ts", "java", "c", "cc", "cpp", "h", "hpp", "cs", "go", "rs", "rb", "php", "sh", "sql", "scala", "kt", "swift", "x")
#: Where a line ends, as Python's splitlines has it.
_LINE_END = "(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ])"


def _checked(size: int, overlap: int) -> int:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("a chunk needs a size above its overlap, and an overlap of 0 or more")
    return size - overlap


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _parts(text: Column, size: int) -> Column:
    """A text cut every `size` characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def text_chunks(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Chunks of `size` characters as (chunk, start, end); the last one ends with the text."""
    step = _checked(size, overlap)
    n = F.length(text)

    def cut(x: Column) -> Column:
        last = F.ceil(F.greatest(x["n"] - size, F.lit(0)) / step).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                F.substring(F.array_join(F.slice(x["parts"], i + 1, F.lit(-(-size // step))), ""), 1, size).alias("chunk"),
                (i * step).alias("start"), F.least(i * step + size, x["n"]).alias("end"),
            ),
        )

    found = _bound(F.struct(_parts(text, step).alias("parts"), n.alias("n")), cut)
    return F.when(n > 0, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def lines(text: Column) -> Column:
    """A text's lines with their ends."""
    return F.filter(F.split(text, f"(?<=\n)|(?<=[\x0b\x0c\x1c-\x1e\x85  ])|(?<=\r)(?!\n)"), lambda x: x != "")


def line_chunks(text: Column, size: int = 50, overlap: int = 5) -> Column:
    """Chunks of `size` lines as (chunk, start_line, end_line)."""
    step = _checked(size, overlap)

    def cut(x: Column) -> Column:
        last = F.ceil(F.greatest(F.size(x) - size, F.lit(0)) / step).cast("int") * step
        return F.transform(
            F.sequence(F.lit(0), last, F.lit(step)),
            lambda s: F.struct(F.array_join(F.slice(x, s + 1, F.lit(size)), "").alias("chunk"), s.alias("start_line"), F.least(s + size, F.size(x)).alias("end_line")),
        )

    found = _bound(lines(text), cut)
    return F.when(F.length(text) > 0, found).otherwise(F.filter(found, lambda _: F.lit(False)))


def paragraph_chunks(text: Column, longer_than: int = 50) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(x) > longer_than)


def window_chunks(text: Column, size: int = 100, step: int = 80) -> Column:
    """Sliding windows, short ones at the end included."""
    each = F.lit(-(-size // step))

    def cut(x: Column) -> Column:
        return F.transform(x, lambda _, i: F.substring(F.array_join(F.slice(x, i + 1, each), ""), 1, size))

    return F.coalesce(_bound(_parts(text, step), cut), F.array().cast("array<string>"))


def split_documents(docs: DataFrame, text: str = "text", path: str = "path", size: int = 500, overlap: int = 50, n_lines: int = 5, line_overlap: int = 1) -> DataFrame:
    """Rows (chunk_no, chunk, from, to) of each document: lines for code by its extension, else characters."""
    code = file_extension(F.col(path)).isin(*CODE_EXTENSIONS)
    as_lines = F.transform(line_chunks(F.col(text), n_lines, line_overlap), lambda x: F.struct(x["chunk"].alias("chunk"), x["start_line"].alias("from"), x["end_line"].alias("to")))
    as_text = F.transform(text_chunks(F.col(text), size, overlap), lambda x: F.struct(x["chunk"].alias("chunk"), x["start"].alias("from"), x["end"].alias("to")))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.posexplode(F.when(code, as_lines).otherwise(as_text)).alias("chunk_no", "x")).select(*rest, "chunk_no", "x.*")


def wildcard(text: Column, pattern: str) -> Column:
    """Whether a whole text matches a pattern of * and ?; patterns count to their 255th character."""
    shape = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern[:255])
    return text.rlike(f"(?s)\\A{shape}\\z")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_absolute_path(path: Column) -> Column:
    return path.rlike(r"^(?:/|\\|[A-Za-z]:)")


def split_text(text: Column, separator: str) -> Column:
    return F.split(text, re.escape(separator))


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def uid_to_hex(high: Column, low: Column) -> Column:
    """A 128-bit id of two longs as 32 hexadecimal digits."""
    return F.concat(F.lpad(F.lower(F.hex(high)), 16, "0"), F.lpad(F.lower(F.hex(low)), 16, "0"))


def hex_to_uid(text: Column) -> tuple[Column, Column]:
    part = lambda at: F.conv(F.substring(text, at, 16), 16, -10).cast("long")
    return part(1), part(17)


def bytes_to_number(data: Column) -> Column:
    """Up to eight bytes, first one highest."""
    return F.conv(F.hex(F.substring(data, 1, 8)), 16, 10).cast("decimal(20,0)")


def html_text(html: Column) -> Column:
    """The text of a page: without scripts, styles, comments and tags, white space single, common entities read."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))
