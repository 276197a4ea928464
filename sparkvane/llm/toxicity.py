"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Corpus side: the words and the character runs that toxic training rows hold far more often than others make two
lexicons; they are counted over all training rows, and the result is bounded. Then dense features of a bounded sample
of labelled rows go to the driver, where the trees are grown on histograms; a part of the sample that no tree saw
calibrates them. A row of the sample is looked up in lexicons that its own label and words didn't count for, so neither
trees nor calibration see features that are better than those of a new text. Scoring is one pass over the texts.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow

FOLDS, HELD = 4, 2
#: Labelled rows that trees and calibration are fitted on, at most.
SAMPLE_ROWS = 20_000
WORD_LEXICON, RUN_LEXICON, RUN = 400, 24, 4
#: Different words and runs that a counting task holds before it passes their counts on.
COUNTED_AT_ONCE = 500_000
#: Toxic rows that must hold a word or run before it is in a lexicon, and its least ratio of rates.
LEAST_ROWS, LEAST_RATIO = 8, 6.0

# Words that address the reader, by language.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros vuestro".split())
# Signs and digits put in place of letters.
DISGUISED = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"\w+")
_MIXED = re.compile(r"\b[^\W\d_]+[0-9@$!*]+[^\W\d_]+")
NAMES = (
    "word_density", "word_hits", "word_kinds", "word_weight", "hidden_density", "run_density", "run_hits", "run_kinds", "near_second", "second_density",
    "capital_rate", "capital_words", "punctuation_rate", "exclamation_rate", "obfuscation_rate", "symbol_rate", "digit_rate", "log_words",
)


def features(text: str, words_lex: dict[str, float], runs_lex: dict[str, float]) -> list[float]:
    """The dense features in NAMES; all zero for a text without words."""
    low = text.lower()
    words = _WORD.findall(low)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    hits = [i for i, w in enumerate(words) if w in words_lex]
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    mixed = _MIXED.findall(low) if not low.isalpha() else []
    hidden = sum(w.translate(DISGUISED) in words_lex for w in mixed)
    runs = {r: low.count(r) for r in runs_lex}
    run_hits = sum(runs.values())
    near = 0
    if hits and second:
        s = np.array(second)
        h = np.array(hits)
        i = np.searchsorted(s, h)
        gap = np.minimum(np.abs(s[np.minimum(i, len(s) - 1)] - h), np.abs(s[np.maximum(i - 1, 0)] - h))
        near = int((gap <= 5).sum())
    size = len(text)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    caps, small = int(raw[65:91].sum()), int(raw[97:123].sum())
    symbols = int(raw[list(b"#$%&*@^~|<>=+")].sum())
    weight = sum(words_lex[words[i]] for i in hits)
    return [
        len(hits) / n, float(len(hits)), float(len({words[i] for i in hits})), weight, hidden / n, run_hits / n, float(run_hits), float(sum(v > 0 for v in runs.values())),
        near / n, len(second) / n, caps / (caps + small + 1), caps / n, int(raw[list(b".,;:?!-'\"()")].sum()) / size, int(raw[33]) / n, len(mixed) / n,
        symbols / size, int(raw[48:58].sum()) / size, float(np.log(n)),
    ]


class Trees:
    """Boosted trees for the logistic loss, grown on histograms by gradient and curvature."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        p = np.clip(y.mean() if len(y) else 0.5, 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        if len(y) < 2 or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        f, width = np.full(len(y), self.base), b.shape[1]
        flat = b + np.arange(width) * self.bins
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = q - y, q * (1 - q)
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)
            at = np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                value[node] = -self.rate * gs / (hs + self.ridge)
                if node >= nodes // 2:
                    continue
                where = flat[rows].ravel()
                hist = [np.bincount(where, np.repeat(v[rows], width), self.bins * width).reshape(width, self.bins).cumsum(axis=1)[:, :-1] for v in (g, h)]
                left, right = hist[1], hs - hist[1]
                gain = np.where((left >= self.least) & (right >= self.least), hist[0] ** 2 / (left + self.ridge) + (gs - hist[0]) ** 2 / (right + self.ridge), -np.inf)
                j, k = divmod(int(gain.argmax()), self.bins - 1)
                if gain[j, k] > gs**2 / (hs + self.ridge) + 1e-6:
                    feature[node], cut[node] = j, k
                    at[rows] = 2 * node + 1 + (b[rows, j] > k)
            self.trees.append((feature, cut, value))
            f += value[at]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not self.trees or not len(x):
            return f
        b, rows = self._binned(x), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                j = feature[at]
                at = np.where(j >= 0, 2 * at + 1 + (b[rows, np.maximum(j, 0)] > cut[at]), at)
            f += value[at]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x by pooling neighbours; a little smoothed towards the mean."""
    at, place = np.unique(x, return_inverse=True)  # rows of one x are one block from the start
    blocks: list[list[float]] = []
    for xi, s, n in zip(at.tolist(), np.bincount(place, y, len(at)).tolist(), np.bincount(place, minlength=len(at)).tolist(), strict=True):
        blocks.append([s, n, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = hi
    mean = float(y.mean()) if len(y) else 0.5
    knots = [(v, (s + mean) / (n + 1)) for s, n, lo, hi in blocks for v in dict.fromkeys((lo, hi))]
    return np.array([k for k, _ in knots] or [0.0]), np.maximum.accumulate(np.array([v for _, v in knots] or [mean]))


def held_out(doc_id, folds: int = FOLDS, held: int = HELD):
    return F.crc32(doc_id.cast("string")) % folds == held


def training(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, y) of the labelled rows that may be learned from; one label per doc_id, the largest.

    Both sides are shuffled whatever their size: the labels have no bound, and texts need not be sorted.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.filter(~held_out(F.col("doc_id"), folds, held))
    return narrow(docs).join(known.hint("shuffle_hash"), "doc_id")


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, y, known, learn): every doc_id of the documents once, its largest label or null, whether the labels have
    it at all, and whether its label may be learned from. No text is read or moved."""
    given = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    joined = ids.join(given.withColumn("known", F.lit(True)), "doc_id", "left")
    return joined.select("doc_id", "y", F.coalesce("known", F.lit(False)).alias("known"), (F.col("y").isNotNull() & ~held_out(F.col("doc_id"), folds, held)).alias("learn"))


def sampled(ids: DataFrame, most: int, salt: str) -> DataFrame:
    """About `most` ids at the most, chosen by a hash of doc_id, whatever order they come in."""
    n = ids.count()
    if n <= most:
        return ids
    return ids.filter(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < int(1_000_000 * 0.98 * most / n))


def counted(train: DataFrame) -> tuple[list[list[tuple[str, int, int]]], int, int]:
    """Words and character runs that may be in a lexicon, each with its numbers of rows (text, no, yes), and all rows (no, yes).

    Counted over all rows given; at most WORD_LEXICON words and RUN_LEXICON runs come back.
    """

    def told(rows, words, runs):
        out = [("", 0, *rows)]
        for kind, (no, yes) in enumerate((words, runs)):
            out += [(w, kind, no[w], yes[w]) for w in no.keys() | yes.keys()]
        for at in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out[at : at + 50_000], strict=True)], ["w", "kind", "no", "yes"])

    def count(batches):
        rows, words, runs = [0, 0], [Counter(), Counter()], [Counter(), Counter()]
        for b in batches:
            for text, y in zip(b.column("text"), b.column("y").to_pylist(), strict=True):
                own = set(_WORD.findall(text.as_py().lower()))
                rows[y > 0] += 1
                words[y > 0].update(own)
                runs[y > 0].update({w[i : i + RUN] for w in own for i in range(len(w) - RUN + 1)})
                if sum(map(len, (*words, *runs))) > COUNTED_AT_ONCE:
                    yield from told(rows, words, runs)
                    rows, words, runs = [0, 0], [Counter(), Counter()], [Counter(), Counter()]
        yield from told(rows, words, runs)

    counted = train.select("text", "y").mapInArrow(count, "w string, kind long, no long, yes long").groupBy("w", "kind").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes"))
    found = counted.filter((F.col("yes") >= LEAST_ROWS) | (F.col("w") == "")).cache()
    total = found.filter("w = ''").first()
    if total is None or not total["yes"]:
        return [[], []], 0, 0
    # One row less against it, so that words which reach the least ratio without a row's own count are here as well.
    ratio = (F.col("yes") / total["yes"]) / (F.greatest("no", F.lit(1)) / (total["no"] + 1))
    good = found.filter("w <> ''").withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO)
    score = (F.col("yes") / total["yes"]) / ((F.col("no") + 1) / (total["no"] + 1)) * F.sqrt("yes")
    out = []
    for kind, most in ((0, WORD_LEXICON), (1, RUN_LEXICON)):
        rows = good.filter(F.col("kind") == kind).orderBy(F.desc(score), "w").limit(most).collect()
        out.append([(r["w"], r["no"], r["yes"]) for r in rows])
    found.unpersist()
    return out, total["no"], total["yes"]


def weighted(found: list[tuple[str, int, int]], no: int, yes: int, own: int | None = None) -> dict[str, float]:
    """The logarithm of each ratio that is large enough; own: as if a row with that label, which holds the word, weren't there."""
    out = {}
    for w, n, y in found:
        y, all_yes = (y - 1, yes - 1) if own == 1 else (y, yes)
        n, all_no = (n - 1, no - 1) if own == 0 else (n, no)
        if y >= LEAST_ROWS and all_yes > 0 and n >= 0:
            ratio = (y / all_yes) / ((n + 1) / (all_no + 1))
            if ratio >= LEAST_RATIO:
                out[w] = float(np.log(ratio))
    return out


def lexicons(train: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and character runs of toxic rows with the logarithm of their ratio; counted over all rows given."""
    (words, runs), no, yes = counted(train)
    return weighted(words, no, yes), weighted(runs, no, yes)


def featured(docs: DataFrame, ids: DataFrame, make, width: int) -> DataFrame:
    """(doc_id, y, x): the features make(text, y) of the documents with these (doc_id, y), a bounded number that is broadcast.

    Of rows that share a doc_id the smallest features count, which are found where the rows are.
    """

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                y = part.column("y").to_pylist()
                x = np.array([make(t.as_py(), v) for t, v in zip(part.column("text"), y, strict=True)], dtype=np.float64).reshape(-1, width)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), width).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), flat], ["doc_id", "y", "x"])

    rows = narrow(docs).join(F.broadcast(ids.select("doc_id", F.col("y").cast("int").alias("y"))), "doc_id").select("doc_id", "text", "y")
    return rows.mapInArrow(run, "doc_id long, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model: lexicons, trees and calibration. Without labels, or with one class only, every score is the same.

    Labels without doc_id or value count as none, and of several for one doc_id the largest counts; columns that both
    tables have don't meet. A null text is an empty one. The sample is chosen by doc_id, so ties and row order don't matter.
    """
    chosen = sampled(labelled_ids(docs, labels, "toxic", FOLDS, HELD).filter("learn").select("doc_id", "y"), sample_rows, "toxicity")
    (words, runs), no, yes = counted(training(docs, labels, "toxic", FOLDS, HELD))
    without = [(weighted(words, no, yes, own), weighted(runs, no, yes, own)) for own in (0, 1)]
    rows = featured(docs, chosen, lambda t, y: features(t, *without[int(y > 0)]), len(NAMES)).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x, y = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["y"] > 0 for r in rows], float)
    last = np.arange(len(rows)) % 4 == 3
    trees = Trees().fit(x[~last], y[~last])
    knots = isotonic(trees.raw(x[last]), y[last])
    return {"words": weighted(words, no, yes), "runs": weighted(runs, no, yes), "trees": trees, "knots": knots}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, score, predicted for every row with a doc_id; a null text is an empty one, an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x = np.array([features(t.as_py(), m["words"], m["runs"]) for t in part.column("text")]).reshape(-1, len(NAMES))
                got = np.clip(np.interp(m["trees"].raw(x), *m["knots"]), 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    found = narrow(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
