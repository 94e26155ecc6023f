"""Language identification by mixture inference.

Learning counts byte n-grams (`ORDERS` bytes, with word boundaries, hashed to
`BUCKETS` buckets) of every labelled training text, per language.  The words of a
text are then drawn from a mixture of languages: expectation-maximisation
estimates the text's proportions from the n-gram likelihoods of its words.
Nested sets of the likeliest languages are fitted again, larger by one language each time for as long
as the likelihood less `PENALTY` * log(words) for each language rises; the set where it ends is
selected.  The result has the selected languages with their shares, largest first.  The
predicted language is the first of them; the score is its
proportion in the fit over all languages.

Cases: null texts and texts without a letter are `und` with score 0, and so is
everything when there are no training rows; null languages teach nothing; ties go
to the language that sorts first; repeated rows are predicted each; an empty
table gives no rows; extra columns are kept, and a clash with a result column
raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import append_columns, batched

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
MOST_LANGUAGES = 256
ROUNDS = 8
PENALTY = 3.0
SMOOTHING = 0.5
UNKNOWN = "und"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


class Model(NamedTuple):
    """Languages in sorted order, and log probabilities of each bucket in each of them."""

    languages: list[str]
    logs: np.ndarray


def distinct_words(t: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words with a letter: bytes of the distinct ones between spaces, where each begins, and for each occurrence its word and its text."""
    r = W.words(t, fold=True)
    letters = np.zeros(len(t.data) + 1, np.int64)
    np.cumsum(_LETTER[t.data], out=letters[1:])
    some = letters[r.end] > letters[r.start]
    _, example, which = np.unique(r.hash[some], return_index=True, return_inverse=True)
    start, end = r.start[some][example], r.end[some][example]
    size = end - start + 2
    begin = np.cumsum(size) - size
    data = np.full(int(size.sum()), 32, np.uint8)
    inner = np.ones(len(data), bool)
    inner[begin] = False
    inner[begin + size - 1] = False
    n = end - start
    where = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    data[inner] = W.LOWER[t.data[where]]
    return data, begin, which, r.doc[some]


def buckets(data: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets of all n-grams within words and the word of each."""
    word = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(data))))
    for n in ORDERS:
        m = len(data) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n * 0x9E37, np.uint32)
        for k in range(n):
            h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        same = word[:m] == word[n - 1 :]
        yield (h[same] % np.uint32(BUCKETS)).astype(np.int32), word[:m][same]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Count the n-grams of all rows with a language.

    Tasks sum their counts first; the driver gets BUCKETS rows for each language
    at most, and more than MOST_LANGUAGES languages are refused.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at].astype(np.int64))], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in W.slices(batches, "text"):
            data, begin, which, doc = distinct_words(W.texts_of(batch.column("text")))
            names = batch.column("lang").dictionary_encode()
            code, known = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            weight = np.bincount(which * len(known) + code[doc], minlength=len(begin) * len(known)).reshape(-1, len(known))
            for bucket, word in buckets(data, begin):
                for k, name in enumerate(known):
                    sums.setdefault(name, np.zeros(BUCKETS)).__iadd__(np.bincount(bucket, weights=weight[word, k], minlength=BUCKETS))
            if len(sums) > 64:
                yield from rows()
        yield from rows()

    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = batched(labelled, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.limit(MOST_LANGUAGES * BUCKETS + 1).toArrow()
    languages = sorted(set(found.column("lang").unique().to_pylist()))
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    total = np.full((BUCKETS, len(languages)), SMOOTHING)
    place = {name: k for k, name in enumerate(languages)}
    total[found.column("bucket").to_numpy(), [place[x] for x in found.column("lang").to_pylist()]] += found.column("n").to_numpy()
    return Model(languages, np.log(total / total.sum(0)).astype(np.float32))


def word_logs(model: Model, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Log likelihood of each distinct word in each language: the mean over the orders of the sums over its n-grams."""
    out = np.zeros((len(begin), len(model.languages)))
    for bucket, word in buckets(data, begin):
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(word, weights=model.logs[bucket, k], minlength=len(begin))
    return out / len(ORDERS)


def fit(like: np.ndarray, which: np.ndarray, first: np.ndarray, owner: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation of the languages' shares in each text, from those given; also the log likelihood.

    `first` has the first occurrence of each text that has words, `owner` the text (of these) of each occurrence.
    """
    each = like[which]
    n = np.diff(np.append(first, len(which)))[:, None]
    for _ in range(rounds):
        part = each * share[owner]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        share = np.add.reduceat(part, first, axis=0) / n
        share /= share.sum(1, keepdims=True)
    return share, np.add.reduceat(np.log(np.maximum((each * share[owner]).sum(1), 1e-30)), first)


def part_of(first: np.ndarray, ends: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of some texts (by number), where each of these begins among them, and the place in `some` of each occurrence."""
    n = ends[some] - first[some]
    begin = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(some)), n)
    return np.arange(int(n.sum())) - begin[owner] + first[some][owner], begin, owner


def mixtures(model: Model, t: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text, the predicted language (-1 for none), its score, and the shares of all languages in the selected set (zero outside)."""
    best, score = np.full(len(t), -1), np.zeros(len(t))
    shares = np.zeros((len(t), len(model.languages)), np.float32)
    data, begin, which, doc = distinct_words(t)
    if not len(doc) or not model.languages:
        return best, score, shares
    logs = word_logs(model, data, begin)
    like = np.exp(logs - logs.max(1, keepdims=True)).astype(np.float32)
    texts, first, owner = np.unique(doc, return_index=True, return_inverse=True)
    languages, n = like.shape[1], np.diff(np.append(first, len(doc)))
    whole, _ = fit(like, which, first, owner, np.full((len(texts), languages), 1 / languages, np.float32), ROUNDS)
    rank = np.argsort(np.argsort(-whole, axis=1, kind="stable"), axis=1, kind="stable")
    top, selected = np.full(len(texts), -np.inf), np.zeros((len(texts), languages), np.float32)
    open_texts, ends = np.arange(len(texts)), first + n
    for k in range(1, languages + 1):
        at, from_, of = part_of(first, ends, open_texts)
        share = np.where(rank[open_texts] < k, np.maximum(whole[open_texts], 1e-3), 0).astype(np.float32)
        share, fitted = fit(like, which[at], from_, of, share / share.sum(1, keepdims=True), ROUNDS // 2 if k > 1 else 0)
        value = fitted - PENALTY * k * np.log(n[open_texts] + 1)
        better = value > top[open_texts]
        open_texts = open_texts[better]
        top[open_texts], selected[open_texts] = value[better], share[better]
        if not len(open_texts):
            break
    chosen = selected.argmax(1)
    raw = t.data.tobytes()
    ascii_letter = W.per_text(_LETTER[t.data] & (t.data < 128), t.offsets)[texts] > 0
    for k in np.flatnonzero(~ascii_letter):
        d = texts[k]
        ascii_letter[k] = any(c.isalpha() for c in raw[t.offsets[d] : t.offsets[d + 1]].decode())
    best[texts[ascii_letter]] = chosen[ascii_letter]
    score[texts] = np.where(ascii_letter, whole[np.arange(len(texts)), chosen], 0.0)
    shares[texts[ascii_letter]] = selected[ascii_letter]
    return best, np.clip(score, 0.0, 1.0), shares


RESULT = [("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64()))]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of `docs`, lang_pred, score, and the selected languages with their shares; only the text is looked at."""
    names = np.array([*model.languages, UNKNOWN], object)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        for batch in W.slices(batches, text):
            best, score, shares = mixtures(model, W.texts_of(batch.column(text)))
            size = (shares > 0).sum(1) if shares.shape[1] else np.zeros(len(shares), int)
            order = np.argsort(-shares, axis=1, kind="stable")
            held = np.arange(order.shape[1]) < size[:, None]
            offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            sets = pa.ListArray.from_arrays(offsets, pa.array(names[order[held]].tolist(), pa.string()))
            parts = pa.ListArray.from_arrays(offsets, pa.array(np.take_along_axis(shares, order, 1)[held].astype(float), pa.float64()))
            yield batch, [pa.array(names[best].tolist(), pa.string()), score, sets, parts]

    return append_columns(docs, RESULT, part)


def keep(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose selected languages have at least the part `least` of the text in the fit over all, with the columns of `docs`.

    Texts without a letter go, and so does everything when no language was learnt.
    """
    columns = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), F.col(text).alias("_text"))
    marked = predict(rows, model, "_text")
    return marked.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least * F.get("shares", F.lit(0)))).select("row.*")
