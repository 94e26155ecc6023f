"""Scores of a log-bilinear language model, normalised, beside a unigram base.

Tokens are the words of the text with A-Z in lower case, then one end.  The model
predicts a token from the classes of the two before it in two levels.  The `WORDS`
commonest training tokens are a class each, and all others share `TAILS` classes
by their last two bytes.  Inside a shared class every token seen `LEAST` times or more in
training has a vector of its own (up to `MOST_INNER` of them, so the model grows with the corpus
and its size has a bound), and the rest of the class is one entry.  Both levels are log-bilinear: the context's vectors, each
scaled by a vector of its position, are summed and multiplied with the vector of the class or of the
entry, plus a bias, and normalised over the classes or over the class's entries.  Of the rest of a class
a token has the part (c + 0.5) of its counts, and 0.5 is left for unseen ones, so probabilities add up to one.

Training is by noise-contrastive estimation over all training tokens: tasks run
stochastic gradients over their own rows from the same start, and the weighted mean
of their parameters starts the next round.  Counts cover all training texts.

To score, tasks hold the model and the counts of the `HEAD` commonest tokens, normalise each distinct context of a
slice once by matrix products, and name the tokens of a text whose counts they lack.  Only
these few are joined with the other counts, by token, and their logs summed for each text; the texts themselves are never shuffled.

Cases: null and empty texts are a single end token; a null identifier counts as
training; without training rows only the smoothing is left; repeated rows count and
are scored each; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import batched, written

WORDS, TAILS = 448, 64
#: Least count of an entry of its own in a shared class, and the most such entries.
LEAST, MOST_INNER = 100, 4096
HEAD = 1 << 18
DIMENSIONS, NOISE, MINIBATCH, RATE = 32, 64, 4096, 0.08
#: Tenths of the training texts that each round ends before.
ROUNDS = (1, 4, 10)
#: Parameters that travel in one row.
PIECE = 1 << 14
END = np.uint64(0x5DEECE66D1234567)


class Tokens(NamedTuple):
    """Hash and tail class of each token, and the text it belongs to; each text's last is the end."""

    hash: np.ndarray
    tail: np.ndarray
    doc: np.ndarray


class Model(NamedTuple):
    """`hashes`: sorted tokens with vectors of their own, their class and, in a shared one, their entry (else -1).

    Entries of shared class k are those from starts[k] to starts[k + 1], the last for the rest of the class, whose mass is rest[k].
    """

    hashes: np.ndarray
    classes: np.ndarray
    entries: np.ndarray
    starts: np.ndarray
    rest: np.ndarray
    noise: np.ndarray
    inner_noise: np.ndarray
    context: np.ndarray
    target: np.ndarray
    place: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray


    @property
    def words(self) -> int:
        """The number of classes of one token."""
        return len(self.target) - TAILS


LEARNT = ("context", "target", "place", "bias", "inner", "inner_bias")


def tokens(t: W.Texts) -> Tokens:
    r = W.words(t, fold=True)
    n = len(t)
    at = r.doc + np.arange(len(r.doc))
    ends = np.cumsum(W.counted(r.doc, n) + 1) - 1
    size = len(r.doc) + n
    h, tail, doc = np.full(size, END, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    h[at] = r.hash
    doc[at], doc[ends] = r.doc, np.arange(n)
    if len(at):
        last = W.LOWER[t.data[r.end - 1]].astype(np.int64)
        other = np.where(r.end - r.start > 1, W.LOWER[t.data[np.maximum(r.end - 2, 0)]], 0).astype(np.int64)
        tail[at] = ((last * 257 + other) * 2654435761 >> 7) % TAILS
    return Tokens(h, tail, doc)


def _summed(h: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct hashes; the first of the first column and the sums of the second for each."""
    distinct, first, which = np.unique(h, return_index=True, return_inverse=True)
    return distinct, columns[0][first], np.bincount(which, weights=columns[1], minlength=len(distinct)).astype(np.int64)


def count(texts: DataFrame) -> DataFrame:
    """Columns h, tail and c: how often each token occurs in the column text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], names=["h", "tail", "c"])

        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in W.slices(batches, "text"):
            k = tokens(W.texts_of(batch.column("text")))
            held.append(_summed(k.hash, k.tail, np.ones(len(k.hash))))
            size += len(held[-1][0])
            if size > 1 << 20:
                held = [_summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > 3 << 18:
                    yield out(held.pop())
                    size = 0
        if held:
            yield out(_summed(*map(np.concatenate, zip(*held, strict=True))))

    return batched(texts, partial, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def placed(model: Model, k: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token and its entry in a shared class (-1 in a class of its own)."""
    at = np.minimum(np.searchsorted(model.hashes, k.hash), len(model.hashes) - 1)
    own = model.hashes[at] == k.hash
    return np.where(own, model.classes[at], model.words + k.tail), np.where(own, model.entries[at], model.starts[k.tail + 1] - 1)


def contexts(classes: np.ndarray, doc: np.ndarray, none: int) -> np.ndarray:
    """For each token the classes of the one before and the one before that; the class `none`, after all others, stands before a text."""
    out = np.full((len(classes), 2), none)
    for k in (1, 2):
        same = doc[k:] == doc[:-k]
        out[k:, k - 1][same] = classes[:-k][same]
    return out


def start(counts: DataFrame, head: pa.Table, most_words: int = WORDS, least: int = LEAST, most_inner: int = MOST_INNER, seed: int = 11) -> Model:
    """The untrained model from the counts and their commonest ones (h, tail, c, most common first): masses, and small random vectors."""
    h, tail, c = head.column("h").to_numpy().view(np.uint64), head.column("tail").to_numpy(), head.column("c").to_numpy()
    n_end = int(c[h == END].sum())
    h, tail, c = (x[h != END] for x in (h, tail, c))
    words = slice(0, most_words - 1)
    middle = np.arange(most_words - 1, max(most_words - 1, min(len(h), most_words - 1 + most_inner)))
    middle = middle[c[middle] >= least]
    middle = middle[np.argsort(tail[middle], kind="stable")]
    per_class = W.counted(tail[middle], TAILS)
    starts = np.concatenate([[0], np.cumsum(per_class + 1)])
    entries = np.arange(len(middle)) + tail[middle]  # a rest entry lies before those of each later class
    all_of = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).toArrow()
    mass, kinds = np.zeros(TAILS), np.zeros(TAILS)
    mass[all_of.column("tail").to_numpy()], kinds[all_of.column("tail").to_numpy()] = all_of.column("c").to_numpy(), all_of.column("n").to_numpy()
    if n_end:
        mass[0] -= n_end
        kinds[0] -= 1
    np.subtract.at(mass, tail[words], c[words])
    np.subtract.at(kinds, tail[words], 1)
    share = np.zeros(most_words + TAILS)
    share[0], share[1 : 1 + len(c[words])] = n_end, c[words]
    share[most_words:] = mass
    share = (share + 0.5) / (share + 0.5).sum()
    rest = mass - np.bincount(tail[middle], weights=c[middle], minlength=TAILS) + 0.5 * (kinds - per_class + 1)
    inner = np.zeros(len(middle) + TAILS)
    inner[entries], inner[starts[1:] - 1] = c[middle] + 0.5, rest
    inner = np.log(inner / np.repeat(np.add.reduceat(inner, starts[:-1]), np.diff(starts))).astype(np.float32)
    hashes = np.concatenate([[END], h[words], h[middle]]).astype(np.uint64)
    classes = np.concatenate([np.arange(1 + len(h[words])), most_words + tail[middle]])
    order = np.argsort(hashes)
    rng = np.random.default_rng(seed)
    small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    log = np.log(share).astype(np.float32)
    return Model(
        hashes[order], classes[order], np.concatenate([np.full(1 + len(h[words]), -1), entries])[order], starts, rest, log, inner,
        small(most_words + TAILS + 1, DIMENSIONS), small(most_words + TAILS, DIMENSIONS), np.ones((2, DIMENSIONS), np.float32), log.copy(), np.zeros((len(inner), DIMENSIONS), np.float32), inner.copy(),
    )


def _scatter(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers (below 65,536: two bytes are sorted by radix) and the sums of the rows for each."""
    order = np.argsort(at.astype(np.uint16) if at.max() < 1 << 16 else at, kind="stable")
    sorted_at = at[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_at[1:] != sorted_at[:-1]]))
    return sorted_at[first], np.add.reduceat(rows[order], first, axis=0)


def _logistic(x: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The logistic function of x + more, in the memory of x."""
    x += more
    np.clip(x, -20, 20, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Stochastic gradients (Adagrad) of the noise-contrastive loss from a model's parameters."""

    def __init__(self, model: Model, seed: int):
        self.m = model._replace(**{f: getattr(model, f).copy() for f in LEARNT})
        self.squares = {f: np.full_like(getattr(self.m, f), 0.1) for f in LEARNT}
        self.rng = np.random.default_rng(seed)
        self.cumulative = np.cumsum(np.exp(model.noise.astype(np.float64)))

    def _step(self, field: str, at, grad: np.ndarray) -> None:
        squares = self.squares[field]
        squares[at] += grad * grad
        getattr(self.m, field)[at] -= RATE * grad / np.sqrt(squares[at])

    def learn(self, classes: np.ndarray, before: np.ndarray) -> None:
        m = self.m
        order = self.rng.permutation(len(classes))
        for at in range(0, len(order), MINIBATCH):
            pick = order[at : at + MINIBATCH]
            w, c = classes[pick], before[pick]
            one, two = m.context[c[:, 0]], m.context[c[:, 1]]
            h = one * m.place[0] + two * m.place[1]
            noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE) * self.cumulative[-1]), len(self.cumulative) - 1)
            shift = np.float32(np.log(NOISE))
            true, false = m.target[w], m.target[noise]
            g_true = -1 / (1 + np.exp(np.clip((h * true).sum(1) + m.bias[w] - m.noise[w] - shift, -20, 20)))
            g_false = _logistic(h @ false.T, m.bias[noise] - m.noise[noise] - shift)
            d_h = g_true[:, None] * true + g_false @ false
            n = np.float32(len(pick))
            rows, grads = _scatter(np.concatenate([w, noise]), np.concatenate([np.column_stack([g_true[:, None] * h, g_true]), np.column_stack([g_false.T @ h, g_false.sum(0)])]))
            self._step("target", rows, grads[:, :-1] / n * 64)
            self._step("bias", rows, grads[:, -1] / n * 64)
            rows, grads = _scatter(c.T.ravel(), np.concatenate([d_h * m.place[0], d_h * m.place[1]]))
            self._step("context", rows, grads / n * 64)
            self._step("place", slice(None), np.stack([(d_h * one).sum(0), (d_h * two).sum(0)]) / n)

    def learn_inner(self, classes: np.ndarray, entries: np.ndarray, before: np.ndarray) -> None:
        """The entries of the shared classes, class by class, against noise from the class; contexts stay as they are."""
        m = self.m
        tokens = np.flatnonzero(entries >= 0)
        tokens = self.rng.permutation(tokens)
        tokens = tokens[np.argsort(classes[tokens], kind="stable")]
        ends = np.searchsorted(classes[tokens], np.arange(m.words, m.words + TAILS + 1))
        for k in range(TAILS):
            first, last = m.starts[k], m.starts[k + 1]
            if last - first < 2:
                continue
            cumulative = np.cumsum(np.exp(m.inner_noise[first:last].astype(np.float64)))
            for at in range(ends[k], ends[k + 1], MINIBATCH):
                pick = tokens[at : min(at + MINIBATCH, ends[k + 1])]
                w, c = entries[pick], before[pick]
                h = m.context[c[:, 0]] * m.place[0] + m.context[c[:, 1]] * m.place[1]
                draws = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE) * cumulative[-1]), last - first - 1) + first
                shift = np.float32(np.log(NOISE))
                g_true = -1 / (1 + np.exp(np.clip((h * m.inner[w]).sum(1) + m.inner_bias[w] - m.inner_noise[w] - shift, -20, 20)))
                g_false = _logistic(h @ m.inner[draws].T, m.inner_bias[draws] - m.inner_noise[draws] - shift)
                rows, grads = _scatter(np.concatenate([w, draws]), np.concatenate([np.column_stack([g_true[:, None] * h, g_true]), np.column_stack([g_false.T @ h, g_false.sum(0)])]))
                self._step("inner", rows, grads[:, :-1] / np.float32(len(pick)) * 64)
                self._step("inner_bias", rows, grads[:, -1] / np.float32(len(pick)) * 64)


def mean_of(pieces: DataFrame) -> dict[int, np.ndarray]:
    """The weighted means of pieces of parameters (k, n, x: 32-bit floats), each summed in one task batch by batch."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1), 0
        for batch in batches:
            for weight, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist(), strict=True):
                total, n = total + weight * np.frombuffer(x, np.float32).astype(np.float64), n + weight
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / n).astype(np.float32).tobytes()])], names=["k", "x"])

    return {r.k: np.frombuffer(r.x, np.float32) for r in pieces.groupBy("k").applyInArrow(run, "k int, x binary").collect()}


def train(texts: DataFrame, model: Model, part: Column) -> Model:
    """Rounds of training over the column text; `part` deals rows into tenths."""
    low = 0
    for high in ROUNDS:
        code = pickle.dumps(model)

        def run(batches: Iterator[pa.RecordBatch], code: bytes = code) -> Iterator[pa.RecordBatch]:
            trainer, n = None, 0
            for batch in W.slices(batches, "text"):
                k = tokens(W.texts_of(batch.column("text")))
                trainer = trainer or Trainer(pickle.loads(code), 1)
                classes, entries = placed(trainer.m, k)
                before = contexts(classes, k.doc, len(trainer.m.target))
                trainer.learn(classes, before)
                trainer.learn_inner(classes, entries, before)
                n += len(classes)
            if n:
                flat = np.concatenate([getattr(trainer.m, f).ravel() for f in LEARNT]).astype(np.float32)
                pieces = [flat[at : at + PIECE].tobytes() for at in range(0, len(flat), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pieces), dtype=np.int32)), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces)], names=["k", "n", "x"])

        mean = mean_of(batched(texts.where((part >= low) & (part < high)).select("text"), run, "k int, n long, x binary"))
        if mean:
            flat = np.concatenate([mean[k] for k in range(len(mean))])
            at, new = 0, {}
            for f in LEARNT:
                old = getattr(model, f)
                new[f] = flat[at : at + old.size].reshape(old.shape)
                at += old.size
            model = model._replace(**new)
        low = high
    return model


def _normal(h: np.ndarray, vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logs of the sums of exponentials of all scores, for each context."""
    total = np.empty(len(h), np.float32)
    for at in range(0, len(h), 512):
        s = h[at : at + 512] @ vectors.T
        s += bias
        top = s.max(1, keepdims=True)
        s -= top
        total[at : at + 512] = np.log(np.exp(s, out=s).sum(1)) + top[:, 0]
    return total


def token_logs(model: Model, classes: np.ndarray, entries: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Natural logs of the normalised probabilities of classes, and of entries in shared ones, after their contexts."""
    key, which = np.unique(before[:, 0] * len(model.context) + before[:, 1], return_inverse=True)
    one, two = np.divmod(key, len(model.context))
    h = model.context[one] * model.place[0] + model.context[two] * model.place[1]
    total = _normal(h, model.target, model.bias)
    out = np.empty(len(classes))
    for at in range(0, len(classes), 1 << 18):
        w, k = classes[at : at + (1 << 18)], which[at : at + (1 << 18)]
        out[at : at + (1 << 18)] = np.einsum("ij,ij->i", h[k], model.target[w]) + model.bias[w] - total[k]
    shared = np.flatnonzero(entries >= 0)
    shared = shared[np.argsort(classes[shared], kind="stable")]
    ends = np.searchsorted(classes[shared], np.arange(model.words, model.words + TAILS + 1))
    for k in range(TAILS):
        first, last = model.starts[k], model.starts[k + 1]
        at = shared[ends[k] : ends[k + 1]]
        if last - first < 2 or not len(at):
            continue
        met, of = np.unique(which[at], return_inverse=True)
        total = _normal(h[met], model.inner[first:last], model.inner_bias[first:last])
        w = entries[at]
        out[at] += np.einsum("ij,ij->i", h[which[at]], model.inner[w]) + model.inner_bias[w] - total[of]
    return out


class Head(NamedTuple):
    """Sorted tokens with known counts, and the numbers of all training tokens and of distinct ones."""

    hashes: np.ndarray
    counts: np.ndarray
    n: int
    v: int


def scored(model: Model, head: Head, t: W.Texts) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """n_tokens, n_known, base_score and score of some texts, where a token outside the head counts as unseen; and those tokens with the text of each."""
    k = tokens(t)
    c, inside = np.zeros(len(k.hash)), np.zeros(len(k.hash), bool)
    if len(head.hashes):
        at = np.minimum(np.searchsorted(head.hashes, k.hash), len(head.hashes) - 1)
        inside = head.hashes[at] == k.hash
        c = np.where(inside, head.counts[at], 0)
    classes, entries = placed(model, k)
    logs = token_logs(model, classes, entries, contexts(classes, k.doc, len(model.target)))
    rest = (entries >= 0) & (entries == model.starts[k.tail + 1] - 1)
    logs[rest] += np.log((c[rest] + 0.5) / model.rest[k.tail[rest]])
    base = np.log10((c + 0.5) / (head.n + 0.5 * (head.v + 1)))
    total = lambda x: np.bincount(k.doc, weights=x, minlength=len(t))
    return [W.counted(k.doc, len(t)), total(c > 0).astype(np.int64), total(base), total(logs) / np.log(10)], k.hash[~inside], k.doc[~inside]


RESULT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", words: int = WORDS, least: int = LEAST, most_inner: int = MOST_INNER, most_head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; rows not held out are learnt from."""
    rows = docs.select(F.col(key).alias("doc_id"), held_out.alias("held_out"), F.xxhash64(F.col(key), F.lit("|"), F.col(text)).alias("record"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = written(count(training.select("text")), "token-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    common = counts.orderBy(F.desc("c"), "h").limit(most_head).toArrow()
    common = common.sort_by([("c", "descending"), ("h", "ascending")])
    part = F.pmod(F.xxhash64(F.lit("round"), "record"), F.lit(10))
    hashes = common.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    head = Head(hashes[order], common.column("c").to_numpy()[order], int(n), int(v))
    code = pickle.dumps((train(training, start(counts, common, words, least, most_inner), part), head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in W.slices(batches, "text", 4 << 20):
            model, known = held = held or pickle.loads(code)
            result, other, doc = scored(model, known, W.texts_of(batch.column("text")))
            at = pa.array(np.concatenate([[0], np.cumsum(W.counted(doc, batch.num_rows))]), pa.int32())
            columns = [*(batch.column(c) for c in ("doc_id", "held_out", "record")), *map(pa.array, result), pa.ListArray.from_arrays(at, pa.array(other.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "record", "n_tokens", "n_known", "base_score", "score", "other"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    partial = written(batched(rows, run, f"doc_id {kind}, held_out boolean, record long, n_tokens long, n_known long, base_score double, score double, other array<long>"), "partial-scores")
    more = F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))
    each = partial.select("record", F.posexplode("other").alias("k", "h")).join(counts.select("h", "c"), "h", "left")
    copies = F.count_if(F.col("k") == 0)  # repeated rows have one record, and name their tokens each
    extra = each.groupBy("record").agg((F.sum(F.coalesce(more, F.lit(0.0))) / copies).alias("more"), (F.count("c") / copies).cast("long").alias("seen"))
    more, seen = F.coalesce("more", F.lit(0.0)), F.coalesce("seen", F.lit(0))
    found = partial.drop("other").join(extra, "record", "left")
    return found.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + seen).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
