"""Quality by positive-unlabelled learning.

A small network over dense features is trained to minimise the non-negative unbiased risk (Kiryo et al., 2017): trusted
positives are training rows labelled 1, everything unlabelled is the web; labels 0 serve for nothing. Where the estimated
risk of the negatives falls below zero, the step goes the other way, so that the unlabelled rows aren't fitted as negatives.

The class prior comes from the same two samples (Garg et al., 2021): networks that tell positives from the web score rows
they weren't fitted on; the top of the ranking that is nearly all positive is where the part of the web above a score,
over the part of the positives above it, is least, and that ratio is the prior. The mean score of the positives gives a
second estimate (Elkan and Noto, 2008). Rows that can't be told apart raise both, so the lower one counts.
"""

from __future__ import annotations

import operator
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow
from .toxicity import featured, held_out, labelled_ids, sampled

FOLDS, HELD = 5, 0
#: Trusted positives, and unlabelled rows, that the network is fitted on, at most.
SAMPLE_ROWS = 20_000
PIECE_WORDS = 400
#: Steps that a network takes at least, however small the samples are.
LEAST_STEPS = 600
NAMES = (
    "log_words", "word_length", "long_words", "kinds", "repeats", "top_word", "capital_rate", "capital_start", "symbol_rate", "bar_rate", "exclamation_rate",
    "stop_rate", "comma_rate", "digit_rate", "mark_ends", "line_words", "line_repeats", "worst_repeats", "worst_symbols", "worst_capitals",
)
_SYMBOLS = list(b"#$%&*^~|<>=+_{}[]\\")


def _byte_rates(text: str) -> tuple[float, float, float, np.ndarray]:
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    caps, small = int(raw[65:91].sum()), int(raw[97:123].sum())
    size = max(1, int(raw.sum()))
    return caps / (caps + small + 1), int(raw[_SYMBOLS].sum()) / size, size, raw


def features(text: str) -> list[float]:
    """The dense features in NAMES; all zero for a text without words. The worst_ ones are over pieces of the text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    caps, symbols, size, raw = _byte_rates(text)
    counts = Counter(words)
    same = list(map(operator.eq, words, words[1:]))
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split("\n") if x]
    worst = [0.0, 0.0, 0.0]
    step = max(1, PIECE_WORDS)
    for at in range(0, n, step):
        piece = words[at : at + step]
        c, s, *_ = _byte_rates(" ".join(piece))
        worst = [max(worst[0], sum(same[at : at + step]) / len(piece)), max(worst[1], s), max(worst[2], c)]
    return [
        float(np.log(n)), float(lengths.mean()), float((lengths > 14).mean()), float(np.log(len(counts)) / np.log(n + 1)), sum(same) / n, max(counts.values()) / n,
        caps, sum(w[0].isupper() for w in words) / n, symbols, int(raw[124]) / n, int(raw[33]) / n,
        float((lengths <= 3).mean()), int(raw[44]) / n, int(raw[48:58].sum()) / size, sum(w[-1] in "#$%&*!|" for w in words) / n, float(np.log(n / max(1, len(lines)))),
        1 - len(set(lines)) / max(1, len(lines)), *worst,
    ]


class Network:
    """One hidden layer, trained by Adam on the non-negative risk with the sigmoid loss.

    Without a prior it is trained to tell the two samples apart instead, by the logistic loss.
    """

    def __init__(self, hidden: int = 24, epochs: int = 60, batch: int = 512, rate: float = 0.01, decay: float = 1e-4, seed: int = 7):
        self.hidden, self.epochs, self.batch, self.rate, self.decay, self.seed = hidden, epochs, batch, rate, decay, seed
        self.mean = self.scale = self.flat = None

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _forward(self, z: np.ndarray, w: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        a = np.tanh(z @ w[0] + w[1])
        return a, a @ w[2] + w[3]

    def _back(self, z: np.ndarray, a: np.ndarray, d: np.ndarray, w: list[np.ndarray]) -> list[np.ndarray]:
        da = np.outer(d, w[2]) * (1 - a**2)
        return [z.T @ da, da.sum(axis=0), a.T @ d, np.array(d.sum())]

    def fit(self, pos: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Network:
        both = np.concatenate([pos, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        rng = np.random.default_rng(self.seed)
        width = both.shape[1]
        w = [rng.normal(0, width**-0.5, (width, self.hidden)), np.zeros(self.hidden), rng.normal(0, self.hidden**-0.5, self.hidden), np.array(0.0)]
        m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
        zp, zu = self._z(pos), self._z(unlabelled)
        steps = max(1, len(zu) // self.batch)
        epochs = max(self.epochs, LEAST_STEPS // steps)
        for epoch in range(epochs):
            ip, iu = np.resize(rng.permutation(len(zp)), steps * self.batch), np.resize(rng.permutation(len(zu)), steps * self.batch)
            for k in range(steps):
                p, u = zp[ip[k * self.batch : (k + 1) * self.batch]], zu[iu[k * self.batch : (k + 1) * self.batch]]
                (ap, fp), (au, fu) = self._forward(p, w), self._forward(u, w)
                sp, su = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))  # the loss of taking a row for negative; of positive: 1 - s
                gp, gu = (prior or 0.0) * sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
                if prior is None:
                    parts = [(p, ap, (sp - 1) / len(sp)), (u, au, su / len(su))]
                elif su.mean() >= prior * sp.mean():
                    parts = [(p, ap, -gp - gp), (u, au, gu)]
                else:
                    parts = [(p, ap, gp), (u, au, -gu)]
                grad = [sum(x) for x in zip(*(self._back(*q, w) for q in parts), strict=True)]
                t += 1
                rate = self.rate * (1 - epoch / epochs) + 1e-4
                for j in range(4):
                    g = grad[j] + self.decay * w[j]
                    m[j] = 0.9 * m[j] + 0.1 * g
                    v[j] = 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.flat = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat is None:
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self._forward(self._z(x), self.flat)[1], -30, 30)))


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray, sure: float = 0.9, slack: float = 0.01) -> float:
    """The part of positives among unlabelled rows, from scores that neither sample was fitted on: at the score where the
    part of the unlabelled above it, over that of the positives, is surely least."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.04, 0.9, 87), method="nearest"))  # the last positives are no guide
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    p, u = above(positive), above(unlabelled)
    width = sum(np.sqrt(np.log(4 / (1 - sure)) / (2 * len(x))) for x in (positive, unlabelled))
    at = int(((u + (1 + slack) * width) / p).argmin())
    return float(np.clip(u[at] / p[at], 0.01, 0.99))


def estimated_prior(pos: np.ndarray, unlabelled: np.ndarray, folds: int = 3) -> float:
    """The class prior, from two samples' features; each row is scored by a network that hasn't seen it."""
    p, u = np.arange(len(pos)) % folds, np.arange(len(unlabelled)) % folds
    if min(len(pos), len(unlabelled)) < folds:
        return 0.5
    scores = [np.zeros(len(pos)), np.zeros(len(unlabelled))]
    for k in range(folds):
        model = Network(hidden=8, epochs=20, decay=0.01).fit(pos[p != k], unlabelled[u != k], None)
        scores[0][p == k], scores[1][u == k] = model.score(pos[p == k]), model.score(unlabelled[u == k])
    told = scores[0].mean()
    return float(np.clip(min(mixture_share(*scores), (1 - told) / max(told, 1e-6)), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Network:
    """The trained network; without positives or unlabelled rows, one that scores every row the same.

    Rows without a label are the unlabelled ones; where every row has one, the training rows serve, their labels unseen.
    Which rows are taken is settled on ids and labels alone; only the taken ones' texts are then read, with at most
    2 * sample_rows ids broadcast. Labels without doc_id or value count as none, of several for one doc_id the largest
    counts, and columns that both tables have don't meet. A null text is an empty one.
    """
    ids = labelled_ids(docs, labels, "quality", FOLDS, HELD)
    trusted = sampled(ids.filter("learn and y > 0").select("doc_id", F.lit(1).alias("y")), sample_rows, "trusted")
    web = ids.filter("not known")
    if web.isEmpty():
        web = ids.filter("learn")
    rows = featured(docs, trusted.union(sampled(web.select("doc_id", F.lit(0).alias("y")), sample_rows, "web")), lambda t, _: features(t), len(NAMES)).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["y"]))
    pos, unlabelled = (np.array([r["x"] for r in rows if r["y"] == y]).reshape(-1, len(NAMES)) for y in (1, 0))
    model = Network()
    return model.fit(pos, unlabelled, estimated_prior(pos, unlabelled)) if len(pos) and len(unlabelled) else model


def _scorer(docs: DataFrame, model: Network):
    held = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), 1000):
            x = np.array([features(t.as_py() or "") for t in texts.slice(at, 1000)]).reshape(-1, len(NAMES))
            out.append(held.value.score(x))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return of


def keep(docs: DataFrame, model: Network, least: float = 0.3) -> DataFrame:
    """The rows of documents that score `least` or more, with all their columns, in one pass; rows without doc_id go.

    Each row is judged by its own text, also where doc_ids repeat; a null text is an empty one.
    """
    good: Column = F.arrow_udf(_scorer(docs, model), "double")(F.col("text").cast("string"))
    return docs.filter(F.col("doc_id").isNotNull()).filter(good >= least)


def score(docs: DataFrame, model: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every row with a doc_id; a null text is an empty one, an empty table gives no rows."""
    of = _scorer(docs, model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), of(b.column("text"))], ["doc_id", "score"])

    found = narrow(docs).mapInArrow(run, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
