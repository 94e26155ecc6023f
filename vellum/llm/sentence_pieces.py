"""SentencePiece encoding and decoding by a forward pass shared between common prefixes.

White space is marked: a space becomes the mark U+2581, and a mark is put before
the text.  Pieces never hold a mark after another character, so a text splits
into marked words (marks, then other characters) that are encoded on their own.
The distinct marked words of a batch are sorted, which lists a trie of them in
depth-first order; the forward scores of a word begin as those of the prefix it
shares with the word before, and only the rest is computed.

Two kinds of model are handled with the same walk:

unigram   pieces have log probabilities; the score of a prefix is the best sum.
bpe       piece scores are merge ranks, and the library merges by rank, so the
          best sum of scores would be another segmentation.  Here a step from
          one piece to the next scores 0 when merging both pieces' characters
          gives just these two back, else minus infinity.  Exactly one path
          survives for each prefix, and it is the library's.

Characters without a piece become byte pieces.  Decoding joins the pieces,
turns marks into spaces and drops the one put before the text.

Cases: null and empty texts have no ids and decode to the empty text; repeated
rows and ids are encoded each; an empty table gives no rows; extra columns are
kept, and a clash with a result column raises ValueError.  A text that holds
U+2581 itself decodes with a space in its place, as with the library.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import words as W
from .frames import append_columns
from .word_codes import WordCodes

MARK = "▁"
_NOTHING = np.zeros(256, bool)


class Pieces:
    """The pieces of a model and the forward pass over them."""

    def __init__(self, pieces: dict[str, int], scores: list[float], byte_ids: list[int], kind: str):
        self.ids, self.scores, self.bytes, self.kind = pieces, scores, byte_ids, kind
        self.longest = max(map(len, pieces), default=1)
        self.spelling = {i: p for p, i in pieces.items()}
        self.lowest = min(scores, default=0.0) - 10.0
        self.fits: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str, kind: str = "bpe") -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        usual = {model.id_to_piece(i): i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        coded = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(usual, [model.get_score(i) for i in range(n)], coded, kind)

    def merged(self, text: str) -> list[str]:
        """The text merged from characters: again and again the adjacent pair with the best score, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: int, right: int) -> bool:
        if left < 0 or right < 0:
            return True
        pair = left << 32 | right
        known = self.fits.get(pair)
        if known is None:
            a, b = self.spelling[left], self.spelling[right]
            if len(self.fits) > 1 << 19:
                self.fits.clear()
            known = self.fits[pair] = self.merged(a + b) == [a, b]
        return known

    def encode_sorted(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of words that come in sorted order."""
        ids, longest, bpe, scores, lowest = self.ids, self.longest, self.kind == "bpe", self.scores, self.lowest
        best: list[float] = [0.0]  # by length of the prefix: its score, the last piece of its best path, and where that begins
        last: list[int] = [-2]
        begin: list[int] = [0]
        before = ""
        for word in words:
            n, common = len(word), 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                common += 1
            del best[common + 1 :], last[common + 1 :], begin[common + 1 :]
            for j in range(common + 1, n + 1):
                top, piece, start = -1e300, -1, j - 1
                for i in range(max(0, j - longest), j):
                    k = ids.get(word[i:j])
                    if k is None:
                        continue
                    if bpe:
                        if self._may_follow(last[i], k):
                            top, piece, start = 0.0, k, i
                            break
                    elif best[i] + scores[k] > top:
                        top, piece, start = best[i] + scores[k], k, i
                if piece < 0:
                    top = best[j - 1] + lowest
                best.append(top)
                last.append(piece)
                begin.append(start)
            out: list[int] = []
            j = n
            while j:
                out += [last[j]] if last[j] >= 0 else [self.bytes[x] for x in reversed(word[begin[j] : j].encode())]
                j = begin[j]
            out.reverse()
            before = word
            yield out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of distinct words (UTF-8, spaces not yet marked) in the order given."""
        marked = [w.decode().replace(" ", MARK) for w in words]
        order = sorted(range(len(marked)), key=marked.__getitem__)
        out: list[list[int]] = [[]] * len(marked)
        for k, ids in zip(order, self.encode_sorted([marked[k] for k in order]), strict=True):
            out[k] = ids
        return out

    def piece_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that each id stands for, one after the other, and their offsets."""
        spelled = [b""] * len(self.scores)
        for p, i in self.ids.items():
            spelled[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(self.bytes):
            spelled[i] = bytes((b,))
        return np.frombuffer(b"".join(spelled), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])


def marked_words(t: W.Texts) -> tuple[W.Texts, W.Runs]:
    """The texts with a space before each (unless empty), and their marked words."""
    size = np.diff(t.offsets)
    full = size > 0
    offsets = np.concatenate([[0], np.cumsum(size + full)])
    data = np.insert(t.data, t.offsets[:-1][full], 32) if full.any() else t.data
    space = data == 32
    head = space.copy()
    head[1:] &= ~space[:-1]
    head[offsets[:-1][full]] = True
    start = np.flatnonzero(head)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return W.Texts(data, offsets), W.hashed(data, start, np.append(start[1:], len(data)), doc)


def decode(ids: np.ndarray, at: np.ndarray, spelled: tuple[np.ndarray, np.ndarray]) -> W.Texts:
    """The texts of ids (all in a row, `at` has where each text begins)."""
    data, offsets = spelled
    size = (offsets[1:] - offsets[:-1])[ids]
    ends = np.cumsum(size)
    where = np.repeat(offsets[:-1][ids] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    bounds = np.concatenate([[0], ends])[at]
    raw = data[where]
    full = bounds[1:] > bounds[:-1]
    return W.Texts(np.delete(raw, bounds[:-1][full]), bounds - np.concatenate([[0], np.cumsum(full)]))


RESULT = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())]


def encode(docs: DataFrame, model_path: str, text: str = "text", kind: str = "bpe") -> DataFrame:
    """All columns of `docs`, the number of ids, the ids, and the text decoded from them."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list]]:
        pieces = Pieces.load(model_path, kind)
        codes, spelled = WordCodes(pieces.encode_words), pieces.piece_bytes()
        for batch in W.slices(batches, text, 2 << 20):
            t, r = marked_words(W.texts_of(batch.column(text)))
            ids, at = codes(t.data, r, len(t))
            back = decode(ids, at, spelled)
            texts = pa.Array.from_buffers(pa.large_string(), len(back), [None, pa.py_buffer(back.offsets.astype(np.int64)), pa.py_buffer(back.data)])
            yield batch, [np.diff(at), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), texts.cast(pa.string())]

    return append_columns(docs, RESULT, part)
