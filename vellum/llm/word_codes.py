"""Codes of words, computed once for each distinct word of a stream of batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .words import Runs


class WordCodes:
    """Maps words to integer sequences and keeps those of the words seen so far, up to a bound.

    `encode` takes a list of distinct words (bytes) and returns one list of
    integers for each.  What is kept only saves work; it never changes results.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], most: int = 1 << 20):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, r: Runs, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """All codes of the words of `r` in order, and where those of each text begin (n_texts + 1 offsets)."""
        distinct, example, which = np.unique(r.hash, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.clear()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            raw = data.tobytes()
            codes = self.encode([raw[a:b] for a, b in zip(r.start[example[new]].tolist(), r.end[example[new]].tolist(), strict=True)])
            size = np.fromiter(map(len, codes), np.int64, len(codes))
            flat = np.fromiter((x for c in codes for x in c), np.int32, int(size.sum()))
            first = len(self.flat) + np.cumsum(size) - size
            self.flat = np.concatenate([self.flat, flat])
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known, self.first, self.size = known[order], np.concatenate([self.first, first])[order], np.concatenate([self.size, size])[order]
            at = np.searchsorted(self.known, distinct)
        size = self.size[at][which]
        ends = np.cumsum(size)
        where = np.repeat(self.first[at][which] - (ends - size), size)
        where += np.arange(len(where))
        per_text = np.bincount(r.doc, weights=size, minlength=n_texts).astype(np.int64)
        return self.flat[where], np.concatenate([[0], np.cumsum(per_text)])
