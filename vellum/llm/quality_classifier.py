"""Quality classifier by positive-unlabelled learning.

Trusted positives are training rows labelled good; all texts are the unlabelled set.  A
text's features are shares of kinds of bytes, how long and varied its words are, and
hashed counts of its words.  The class prior comes from positives and unlabelled texts
alone: a classifier of the one against the other ranks held-out texts, and above
any threshold the share of the unlabelled over that of the positives is at least the
prior; the smallest such quotient is taken.  A small network is then fitted by minimising the
non-negative unbiased risk: with loss l, prior p, positives P and unlabelled U,

    p * mean_P l(+)  +  max(0, mean_U l(-) - p * mean_P l(-))

and when the second part falls below zero the step goes against it.

The fit uses at most about `most_positives` labelled rows.  It begins on `most_start` unlabelled
ones, from which the prior is estimated too; from there tasks go on over all texts, each over its own
rows, and the mean of their weights is the model.  The features' means and deviations are
those of all texts.  Samples are chosen by a hash of identifier and text, so no identifier fills one.

Cases: null and empty texts get the score of a text without words; null
identifiers are scored, and unlabelled, but never positive; of conflicting labels of one
identifier the lowest counts; without any positive label every score is 0.5;
repeated rows are scored each; an empty table gives no rows; extra columns
are kept, and a clash with a result column raises ValueError.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import append_columns, batched

MOST_POSITIVES, MOST_START = 6000, 12_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 512, 0.01, 1e-4
#: Least steps of the classifier that the prior is estimated with.
RANKING_STEPS = 60
#: Texts that are ranked for it if few are there, and most halvings of them.
RANKED, MOST_HALVINGS = 8000, 8
#: Hashed words, and what their features are multiplied by.
BUCKETS, WORD_SCALE = 512, 3.0
_CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:?", "!", "\n", "()[]{}\"'-_/=+@~^`\\")
_CLASS = np.zeros((len(_CLASSES) + 1, 256), bool)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[_k, [ord(c) for c in _chars]] = True
_CLASS[-1, 128:] = True
N_DENSE = len(_CLASS) + 7
N_FEATURES = N_DENSE + BUCKETS


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    prior: float


def words_of(t: W.Texts) -> np.ndarray:
    """For each text and bucket, the root of the share of its words that hash there."""
    r = W.words(t, fold=True)
    n = W.counted(r.doc, len(t))
    at = r.doc * BUCKETS + (r.hash % np.uint64(BUCKETS)).astype(np.int64)
    counts = np.bincount(at, minlength=len(t) * BUCKETS).reshape(len(t), BUCKETS)
    return np.sqrt(counts / np.maximum(n, 1)[:, None]).astype(np.float32) * np.float32(WORD_SCALE)


def dense(t: W.Texts) -> np.ndarray:
    """Shares of kinds of bytes, and how varied and how long the words are."""
    n = len(t)
    size = np.diff(t.offsets)
    r = W.words(t)
    n_words = W.counted(r.doc, n)
    some = np.maximum(n_words, 1)
    out = [W.per_text(row[t.data], t.offsets) / np.maximum(size, 1) for row in _CLASS]
    doc, times = W.distinct(r.hash, r.doc, n)
    distinct = W.counted(doc, n)
    top = np.zeros(n)
    np.maximum.at(top, doc, times)
    pair = np.zeros(n)
    if len(r.hash) > 1:
        same = (r.hash[1:] == r.hash[:-1]) & (r.doc[1:] == r.doc[:-1])
        pair = W.counted(r.doc[1:][same], n)
    g, first = W.grams(r.hash, r.doc, 3)
    windows = W.counted(r.doc[first], n)
    repeats = windows - W.counted(W.distinct(g, r.doc[first], n)[0], n)
    length = np.bincount(r.doc, weights=r.end - r.start, minlength=n) / some
    out += [np.log1p(n_words), np.minimum(length, 50) / 10, distinct / np.sqrt(some), top / some, pair / some, repeats / np.maximum(windows, 1), n_words == 0]
    return np.stack(out, 1).astype(np.float64)


def features(t: W.Texts, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([np.clip((dense(t) - mean) / scale, -6, 6).astype(np.float32), words_of(t)], 1)


def forward(weights: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = weights
    h = np.tanh(x @ a + b)
    return h, h @ c + d


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Fit:
    """Steps (Adam) down the non-negative risk with the logistic loss; without a prior, down that of positives against unlabelled."""

    def __init__(self, positive: np.ndarray, prior: float | None, weights: list[np.ndarray] | None = None, rate: float = RATE, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        if weights is None:
            inner = self.rng.normal(0, 0.3, (N_FEATURES, HIDDEN))
            inner[N_DENSE:] *= 0.1
            weights = [inner, np.zeros(HIDDEN), self.rng.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.weights = [w.astype(np.float32) for w in weights]
        self.p, self.prior, self.rate, self.count = positive, prior, rate, 0
        self.first, self.second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]

    def step(self, xu: np.ndarray) -> None:
        xp, prior, w = self.p[self.rng.integers(0, len(self.p), len(xu))], self.prior, self.weights
        x = np.concatenate([xp, xu])
        h, g = forward(w, x)
        s, n = sigmoid(g), len(xp)
        if prior is None:
            slope = np.concatenate([s[:n] - 1, s[n:]]) / (2 * n)
        else:
            loss = np.logaddexp(0, g)
            risk = loss[n:].mean() - prior * loss[:n].mean()
            minus = np.concatenate([-prior * s[:n], s[n:]]) / n
            plus = np.concatenate([prior * (s[:n] - 1) / n, np.zeros(n)])
            slope = plus + minus if risk >= 0 else -minus
        slope = slope.astype(np.float32)
        back = np.outer(slope, w[2]) * (1 - h * h)
        self.count += 1
        for k, grad in enumerate([x.T @ back, back.sum(0), h.T @ slope, slope.sum(keepdims=True)]):
            grad = grad + np.float32(DECAY) * w[k]
            self.first[k] = 0.9 * self.first[k] + 0.1 * grad
            self.second[k] = 0.999 * self.second[k] + 0.001 * grad * grad
            step = np.float32(self.rate) * (self.first[k] / (1 - 0.9**self.count)) / (np.sqrt(self.second[k] / (1 - 0.999**self.count)) + np.float32(1e-8))
            w[k] = (w[k] - step).astype(np.float32)

    def run(self, unlabelled: np.ndarray, epochs: int) -> Fit:
        for _ in range(epochs):
            order = self.rng.permutation(len(unlabelled))
            for at in range(0, len(order), BATCH):
                self.step(unlabelled[order[at : at + BATCH]])
        return self


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.4) -> float:
    """The smallest quotient of the unlabelled's share over the positives' above a threshold that at least `least` of the positives pass, less its standard error.

    Each half is ranked by a classifier of positives against unlabelled that was fitted on the other; small samples are halved
    anew until about `RANKED` texts were ranked, and the quotients of a threshold's rank are averaged.
    """
    rng, quotients, share = np.random.default_rng(3), [], 1 - np.linspace(least, 1, 25)
    passed = []
    for _ in range(max(1, min(MOST_HALVINGS, RANKED // len(unlabelled)))):
        p, u = positive[rng.permutation(len(positive))], unlabelled[rng.permutation(len(unlabelled))]
        for k in (0, 1):
            half = u[k::2]
            fit = Fit(p[k::2], None).run(half, max(EPOCHS // 8, RANKING_STEPS // -(-len(half) // BATCH)))
            a, b = (forward(fit.weights, x[1 - k :: 2])[1] for x in (p, u))
            cut = np.quantile(a, share)
            passed.append([((b >= c).mean(), (a >= c).mean()) for c in cut])
            quotients.append([x / y for x, y in passed[-1]])
    q = np.mean(quotients, 0)
    above, own = np.clip(np.mean(passed, 0).T, 1e-6, 1)
    error = q * np.sqrt((1 - above) / (above * len(unlabelled)) + (1 - own) / (own * len(positive)))
    return float(np.clip((q - error).min(), 0.01, 0.99))


def scores(model: Model, t: W.Texts) -> np.ndarray:
    if not model.weights:
        return np.full(len(t), model.prior)
    return sigmoid(forward(model.weights, features(t, model.mean, model.scale))[1]).astype(np.float64)


def learn(
    docs: DataFrame, labels: DataFrame, training, key: str = "doc_id", text: str = "text", quality: str = "quality", most_positives: int = MOST_POSITIVES, most_start: int = MOST_START
) -> Model:
    """Fit from the labels of identifiers for which the condition `training` holds, and from all texts."""
    rows = docs.select(key, F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit("|"), F.col(text)).alias("record"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(N_DENSE), np.zeros(N_DENSE), 0
        for batch in W.slices(batches, "text"):
            x = dense(W.texts_of(batch.column("text")))
            total, squares, n = total + x.sum(0), squares + (x * x).sum(0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(N_DENSE, dtype=np.int32)), pa.array(total), pa.array(squares), pa.array(np.full(N_DENSE, n))], names=["k", "x", "xx", "n"])

    sums = batched(rows.select("text"), moments, "k int, x double, xx double, n long").groupBy("k").agg(F.sum("x"), F.sum("xx"), F.sum("n")).orderBy("k").collect()
    n = max(1, sums[0][3]) if sums else 1
    mean = np.array([r[1] for r in sums] or [0.0] * N_DENSE) / n
    scale = np.sqrt(np.maximum(np.array([r[2] for r in sums] or [0.0] * N_DENSE) / n - mean * mean, 0)) + 1e-3

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            x = features(W.texts_of(batch.column("text")), mean, scale)
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))], names=["record", "x"])

    def sample(of: DataFrame, most: int, salt: str, size: int) -> np.ndarray:
        """Features of about `most` rows, by a hash of the record and in its order; never more than twice that."""
        parts = 1 << 20
        part = of if size <= most else of.where(F.pmod(F.xxhash64(F.lit(salt), "record"), F.lit(parts)) < int(parts * most / size))
        found = batched(part.select("record", "text"), measure, "record long, x array<float>").limit(2 * most).toArrow()
        x = np.array(found.column("x").combine_chunks().flatten(), np.float32).reshape(-1, N_FEATURES)
        return x[np.argsort(found.column("record").to_numpy(), kind="stable")]

    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(key).agg(F.min(quality).alias("_quality")).where(training)
    good = known.where(F.col("_quality") == 1).select(key)
    trusted = rows.where(F.col(key).isNotNull()).join(good, key, "left_semi")
    positive = sample(trusted, most_positives, "positive", good.count())
    start = sample(rows, most_start, "unlabelled", n)
    if len(positive) < 2 or len(start) < 2:
        return Model(mean, scale, [], 0.5)
    prior = estimated_prior(positive, start)
    code = pickle.dumps((positive, Fit(positive, prior).run(start, EPOCHS).weights))

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, done = None, 0
        for batch in W.slices(batches, "text"):
            positive, weights = pickle.loads(code) if fit is None else (None, None)
            fit = fit or Fit(positive, prior, weights, RATE / 10)
            x = features(W.texts_of(batch.column("text")), mean, scale)
            for at in range(0, len(x), BATCH):
                fit.step(x[at : at + BATCH])
            done += len(x)
        if done:
            flat = np.concatenate([w.ravel() for w in fit.weights]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat * done), pa.array(np.full(len(flat), done))], names=["k", "x", "n"])

    found = batched(rows.select("text"), go_on, "k int, x double, n long").groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x")).toArrow()
    flat = np.zeros(len(found), np.float32)
    flat[found.column("k").to_numpy()] = found.column("x").to_numpy()
    shapes, at, weights = [(N_FEATURES, HIDDEN), (HIDDEN,), (HIDDEN,), (1,)], 0, []
    for shape in shapes:
        size = int(np.prod(shape))
        weights.append(flat[at : at + size].reshape(shape))
        at += size
    return Model(mean, scale, weights, prior)


RESULT = [("score", pa.float64()), ("predicted", pa.int32())]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs`, score (likelier good when higher) and predicted; only the text is looked at."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in W.slices(batches, text):
            s = scores(model, W.texts_of(batch.column(text)))
            yield batch, [s, (s >= 0.5).astype(np.int32)]

    return append_columns(docs, RESULT, part)
