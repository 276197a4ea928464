"""Personal data with source offsets, through disguises too.

The fixed patterns are searched in each text as it stands. Then a chain of transducers rewrites what may hide an
identifier: zero-width characters go, homoglyphs and foreign digits become ASCII, spelled digits become digits, and
disguised at and dot become signs. Each transducer keeps where every piece came from, so what is found in the rewritten
text is mapped back, step by step, to code points of the source: each digit word and each sign is a piece of its own, so
a span begins and ends with the words that it was read from. A span of the source pattern always stays; a rewritten find
is added where it overlaps no span of its kind.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns. Email is matched from its at sign, the other three from their first character.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Every ip and card lies within one such run.
NUMERIC = re.compile(r"[0-9][0-9. -]*")

# Characters that look like the Latin letters and signs below them.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТХасеорхуіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧονі․。｡",
    "ABEKMHOPCTXaceopxyijsdqwABEZHIKMNOPTYXovi...",
    strict=True,
))
# Names of the digits and of plus, at and dot, by language.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "plus": "+",
}
AT = ("at", "arroba", "arobase", "klammeraffe")
DOT = ("dot", "punkt", "point", "punto")
# Words that an at written as a bare word follows without an address, where the domain's dots are plain.
BEFORE_AT = frozenset("look looked looking arrive arrived be is are was were been me us it them you available found find see seen visit online live hosted host site page shop only sold meet stay located read more work works working here start started not and or".split())
# Domain endings that a dot written as a bare word may stand before; any may follow a dot in brackets.
DOMAIN_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "co", "de", "fr", "es", "eu", "uk", "at", "ch", "it", "us", "example", "test")

_ZERO_WIDTH = re.compile("[​-‍⁠﻿­]+")
_names, _at, _dot = ("|".join(sorted(x, key=len, reverse=True)) for x in (SPELLED, AT, DOT))
_SPELLED_RUN = re.compile(rf"\b(?:{_names})(?:[\s,-]+(?:{_names}|{_dot}|[0-9])\b){{2,}}[\s,-]+(?:{_names}|[0-9])\b", re.I)
#: What every spelled run holds; found faster, as it begins with a separator.
_SPELLED_HINT = re.compile(rf"[\s,-](?:{_names}|{_dot}|[0-9])(?:[\s,-]+(?:{_names}|{_dot}|[0-9])\b){{2}}", re.I)
_SPELLED_PART = re.compile(rf"({_names}|[0-9])|({_dot})|[\s,-]+", re.I)
#: A number of eight or more figures of which some are letters that look like them.
_FIGURES = re.compile(r"[0-9OoIl](?<![A-Za-z0-9].)(?:[ -]?[0-9OoIl]){7,22}(?![A-Za-z0-9])")
_DIGIT = re.compile("[0-9]")
_FIGURE = str.maketrans("OoIl", "0011")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DOT_BRACKET = rf"{_OPEN}(?:{_dot}|\.){_CLOSE}"
_DOT_MARK = rf"(?:{_DOT_BRACKET}|\s+(?:{_dot})\s+)"
_ends = "|".join(DOMAIN_ENDS)
_AT_DISGUISE = re.compile(
    rf"(?<=[A-Za-z0-9])(?:{_OPEN}(?:{_at}|@){_CLOSE}|\s+(?:{_at})\s+(?=[A-Za-z0-9-]+(?:{_DOT_MARK}[A-Za-z0-9-]+){{0,4}}?(?:{_DOT_MARK}(?:{_ends})|{_DOT_BRACKET}[A-Za-z]{{2,}})\b)|\s+@\s+)(?=[A-Za-z0-9])",
    re.I,
)
_AT_PLAIN = re.compile(rf"\s+at\s+(?=[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{_ends})\b)", re.I)
_DOT_DISGUISE = re.compile(
    rf"(?<=[A-Za-z0-9])(?:{_DOT_BRACKET}|\s+(?:{_dot})\s+(?=(?:[A-Za-z0-9-]+{_DOT_MARK}){{0,4}}(?:{_ends})\b)|(?<=[0-9])\s+(?:{_dot})\s+(?=[0-9]))(?=[A-Za-z0-9])",
    re.I,
)
#: What every disguised at or dot holds: an at sign, a bracket, or, for an at written as a bare word too, a dot's name.
_SIGN_HINT = re.compile(rf"[@\[({{<]|{_dot}", re.I)


def _glyphs() -> tuple[dict[int, str], re.Pattern]:
    """Lookalikes, full-width forms of ASCII and the decimal digits of other scripts, each to one character."""
    found = {ord(k): v for k, v in LOOKALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    for c in range(0x600, 0xFF00):
        if unicodedata.category(chr(c)) == "Nd":
            found[c] = str(unicodedata.digit(chr(c)))
    return found, re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(found)) + "]+")


_GLYPHS, _GLYPH_RUN = _glyphs()


Edits = Iterator[tuple[int, int, str]]


class Rewritten:
    """A rewritten text and where each piece of it stood. A piece of equal length maps code point by code point."""

    def __init__(self, text: str, edits: Edits):
        self.at, self.pieces, out, n, end = [], [], [], 0, 0

        def put(s: str, start: int, stop: int, same: bool) -> None:
            nonlocal n
            if s:
                self.at.append(n)
                self.pieces.append((start, stop, same))
                out.append(s)
                n += len(s)

        for start, stop, new in edits:
            put(text[end:start], end, start, True)
            put(new, start, stop, len(new) == stop - start)
            end = stop
        put(text[end:], end, len(text), True)
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a, _, same_a = self.pieces[i]
        b, b_end, same_b = self.pieces[j]
        return (a + start - self.at[i] if same_a else a), (b + end - self.at[j] if same_b else b_end)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap in each kind; matches that fail their check are dropped."""
    found = list(_emails(text))
    for run in NUMERIC.finditer(text):
        if run.end() - run.start() < 7:
            continue
        s, at = run[0], run.start()
        for m in IP.finditer(s):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                found.append(("ip", at + m.start(), at + m.end()))
        for m in CARD.finditer(s):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", at + m.start(), at + m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def _replaced(places: re.Pattern, to: Callable[[str], str]) -> Callable[[str], Edits]:
    return lambda text: ((m.start(), m.end(), to(m[0])) for m in places.finditer(text))


def _spelled(text: str) -> Edits:
    """Digit words and dots within a run one by one; what separates them goes."""
    for run in _SPELLED_RUN.finditer(text):
        for part in _SPELLED_PART.finditer(run[0]):
            new = "." if part[2] else SPELLED.get(part[1].lower(), part[1]) if part[1] else ""
            yield run.start() + part.start(), run.start() + part.end(), new


def _figures(text: str) -> Edits:
    for m in _FIGURES.finditer(text):
        letters = sum(c in "OoIl" for c in m[0])
        if 0 < letters <= sum("0" <= c <= "9" for c in m[0]):
            yield m.start(), m.end(), m[0].translate(_FIGURE)


def _plain_at(text: str) -> Edits:
    for m in _AT_PLAIN.finditer(text):
        local = re.search(r"[A-Za-z0-9._%+-]*\Z", text[max(0, m.start() - 64) : m.start()])[0]
        if local[-1:].isalnum() and local.lower() not in BEFORE_AT:
            yield m.start(), m.end(), "@"


def _chain(text: str) -> tuple[str, list[Rewritten]]:
    steps = []

    def step(edits: Callable[[str], Edits]) -> None:
        nonlocal text
        found = list(edits(text))
        if found:
            steps.append(Rewritten(text, iter(found)))
            text = steps[-1].text

    if not text.isascii():
        step(_replaced(_ZERO_WIDTH, lambda _: ""))
        step(_replaced(_GLYPH_RUN, lambda s: s.translate(_GLYPHS)))
    if _SPELLED_HINT.search(text):
        step(_spelled)
    if _DIGIT.search(text):
        step(_figures)
    if _SIGN_HINT.search(text):
        step(_replaced(_AT_DISGUISE, lambda _: "@"))
        step(_replaced(_DOT_DISGUISE, lambda _: "."))
    step(_plain_at)
    return text, steps


def hidden_spans(text: str, plain: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans found only in the rewritten text, as source offsets."""
    rewritten, steps = _chain(text)
    if not steps:
        return []
    taken = {k: sorted((a, b) for x, a, b in plain if x == k) for k in KINDS}
    found = []
    for kind, a, b in plain_spans(rewritten):
        for s in reversed(steps):
            a, b = s.back(a, b)
        own = taken[kind]
        i = bisect_right(own, (b, -1))
        if not (i and own[i - 1][1] > a):
            found.append((kind, a, b))
    return found


def _told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), *x[1:])))


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts of the fixed patterns by kind, their digest, all spans, and how many the rewriting added.

    Spans are kind:start:end in code points. A null or empty text has none; rows without doc_id are left out; repeated
    rows each get their row.
    """

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                plain = plain_spans(text)
                more = hidden_spans(text, plain)
                n = [sum(k == x for x, *_ in plain) for k in KINDS]
                rows.append((doc, *n, hashlib.sha256(_told(plain).encode()).hexdigest(), _told(plain + more), len(more)))
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names)

    return narrow(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def mask_text(text: str) -> str:
    plain = plain_spans(text)
    spans, out, end = sorted(((a, b, k) for k, a, b in plain + hidden_spans(text, plain)), key=lambda x: (x[0], -x[1], x[2])), [], 0
    for a, b, k in spans:
        if a >= end:
            out += [text[end:a], f"<{k.upper()}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def mask(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind, the longest where spans overlap from one start; null texts stay
    null, other columns and rows without doc_id stay as they are."""

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else mask_text(t))

    return docs.withColumn("text", masked(F.col("text").cast("string")))
