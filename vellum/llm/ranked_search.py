"""Ranked lexical search with variable-sized blocks of postings (variable-block-max WAND).

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in the whole text, A-Z in lower
case; a null text has none.  With N documents that have a term, L terms in all, n terms in a document, df documents with a term
and tf occurrences in the document: a term weighs w = floor(1000 ln((2N+2)/(2df+1))), a document's m is
100 - 75 + (75 n N) div L, and its score is the sum of w ((10^9 tf) div (1000 tf + 8 m)) over the query's terms, repeats included.

1. `sizes`: N and L, a sum over all texts.
2. `index`: tasks turn runs of documents (about `SHARD_TERMS` terms) into shards.  A shard is a row: its documents in order of their identifiers, and for
   each term the documents that hold it and their impacts (the score without w).  Dynamic
   programming cuts each list of postings into the blocks whose bound error, over the documents that they
   span, and a fixed cost a block, are smallest.  All lists of a shard are cut at once, in
   vectors over the lists.
3. `search`: df of the queries' terms is summed over the shards.  In each shard every block of a query's lists adds w times its
   largest impact to the documents that it spans, which bounds their scores.  The documents with the
   highest bounds give a threshold; the pivots are the documents whose bound reaches it.  Only blocks
   with a pivot are read, and score these exactly.  The shards' best are merged by rank.

No step holds more than one shard, and queries go in blocks of bounded text.  A query's result does not
depend on shards, blocks or the order of the rows.

Cases: null and empty texts have no terms, are never found and do not count in N; equal scores by ascending
identifier, null first; repeated rows are documents of their own; queries without a known term, and documents of score 0, give no
rows; query rows with equal identifier and text are one query, other texts of one identifier are queries of their own; empty
tables give no rows; of the columns only identifiers and texts are read.
Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .frames import batched, written

#: Bytes that no term holds: all of ASCII but digits and letters.
STOP = np.ones(256, bool)
STOP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

#: Occurrences of terms, and documents, of a shard (the document that exceeds the first is the last).
SHARD_TERMS, SHARD_DOCS = 3 << 20, 1 << 16
#: Most postings of a block, and what a block costs, in impacts times documents.
MOST_POSTINGS, BLOCK_COST = 32, 4_000_000
#: Bytes of distinct query texts that are searched for at once.
QUERY_BYTES = 8 << 20
#: Documents with the highest bounds, whose scores give the first threshold.
SEEDS = 64

#: A shard's row is large: the writer looks at the size of a row group after each.
ROW_GROUPS = {"parquet.block.size": 32 << 20, "parquet.page.size.row.check.min": 1}

INDEX = "shard long, n_docs long, n_terms long, ids array<long>, terms binary, first binary, docs binary, impacts binary, starts binary"


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """N and L: documents with a term, and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for batch in W.slices(batches, "text"):
            t = W.texts_of(batch.column("text"))
            inside = ~STOP[t.data]
            head = inside.copy()
            head[1:] &= ~inside[:-1]
            firsts = t.offsets[:-1][np.diff(t.offsets) > 0]
            head[firsts] = inside[firsts]
            each = W.per_text(head, t.offsets)
            n, terms = n + int(np.count_nonzero(each)), terms + int(each.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    total = batched(docs.select(F.col(text).alias("text")), run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return total[0] or 0, total[1] or 0


def impacts(tf: np.ndarray, n: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Scores without weights, of occurrences and the documents' numbers of terms."""
    m = 25 + (75 * n * size[0]) // size[1]
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def block_starts(docs: np.ndarray, impact: np.ndarray, first: np.ndarray, most: int = MOST_POSTINGS, cost: int = BLOCK_COST) -> np.ndarray:
    """Which postings begin a block; `first` has where each list begins, and the end.

    A block has at most `most` postings.  Among all cuts these make the sum over blocks of documents spanned times largest impact, and
    `cost` a block, smallest.  Two postings are never in one block if the documents between them alone cost more than a block,
    so a list falls into runs first, and all runs go through the dynamic programme together.
    """
    docs, impact = docs.astype(np.int64), impact.astype(np.int64)
    new = np.zeros(len(docs), bool)
    new[1:] = (np.diff(docs) - 1) * np.maximum(impact[1:], impact[:-1]) >= cost
    new[first[:-1]] = True
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(docs)))
    several = np.flatnonzero(length > 1)
    order = several[np.argsort(-length[several], kind="stable")]  # by falling length, so that the runs that go on are always the first ones
    longest, base = length[order], at[order]
    best = np.zeros(len(docs) + len(length), np.int64)  # of a run with n postings n + 1 values: the least cost of its first 0 to n postings
    shift = base + order
    taken = np.zeros(len(docs), np.int32)
    for j in range(int(longest[0]) if len(longest) else 0):
        active = int(np.searchsorted(-longest, -j))
        back = np.arange(min(j + 1, most))
        where = (base[:active, None] + j) - back
        span = docs[base[:active, None] + j] - docs[where] + 1
        total = np.maximum.accumulate(impact[where], axis=1) * span + best[(shift[:active, None] + j) - back] + cost
        choice = np.argmin(total, axis=1)
        best[shift[:active] + j + 1] = total[np.arange(active), choice]
        taken[base[:active] + j] = choice + 1
    end, left = base + longest, longest
    while len(end):  # back from the end of all runs at once
        size = taken[end - 1]
        inner = left > size
        end, left = (end - size)[inner], (left - size)[inner]
        new[end] = True
    return new


class _Held:
    """The terms of some documents, before they become a shard."""

    def __init__(self) -> None:
        self.hashes, self.docs, self.ids, self.counts = [], [], [], []
        self.n_docs = self.n_terms = 0

    def add(self, ids: pa.Array, r: W.Runs, n: int) -> None:
        self.hashes.append(r.hash)
        self.docs.append((r.doc + self.n_docs).astype(np.int32))
        self.ids.append(ids)
        self.counts.append(W.counted(r.doc, n))
        self.n_docs += n
        self.n_terms += len(r.hash)

    def row(self, number: int, size: tuple[int, int]) -> pa.RecordBatch:
        ids = pa.concat_arrays(self.ids)
        counts = np.concatenate(self.counts)
        order = np.argsort(ids.fill_null(np.iinfo(np.int64).min).to_numpy(), kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        ids, counts = ids.take(pa.array(order)), counts[order]
        h, doc = np.concatenate(self.hashes), place[np.concatenate(self.docs)]
        order = np.argsort(h, kind="stable") if (np.diff(place) >= 0).all() else np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])[: len(h)]
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        h, doc = h[at], doc[at]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        first = np.append(head, len(h))
        impact = impacts(tf, counts[doc], size)
        raw = [h[head], first.astype(np.int64), doc.astype(np.uint16), impact.astype(np.int32), np.packbits(block_starts(doc, impact, first))]
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([int(np.count_nonzero(counts))]), pa.array([int(counts.sum())]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([x.tobytes()], pa.binary()) for x in raw)],
            names=[x.split()[0] for x in INDEX.split(", ")],
        )


def index(docs: DataFrame, size: tuple[int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """INDEX rows, a shard each; `size` holds N and L of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Held()
        for batch in W.slices(batches, "text"):
            t = W.texts_of(batch.column("text"))
            if held.n_docs and held.n_docs + len(t) > SHARD_DOCS:
                yield held.row(number, size)
                number, held = number + 1, _Held()
            held.add(batch.column("doc_id"), W.runs(t.data, t.offsets, STOP, fold=True), len(t))
            if held.n_terms >= SHARD_TERMS:
                yield held.row(number, size)
                number, held = number + 1, _Held()
        if held.n_terms:
            yield held.row(number, size)

    return batched(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), run, INDEX)


class Queries(NamedTuple):
    """Distinct terms of all queries (sorted hashes); each query's terms as places among them, and how often it has them."""

    keys: list[str]
    terms: np.ndarray
    first: np.ndarray
    term: np.ndarray
    times: np.ndarray


def queries_of(keys: list[str], texts: pa.Array) -> Queries:
    t = W.texts_of(texts)
    r = W.runs(t.data, t.offsets, STOP, fold=True)
    terms, which = np.unique(r.hash, return_inverse=True)
    pair, times = np.unique(r.doc * max(1, len(terms)) + which, return_counts=True)
    doc, term = pair // max(1, len(terms)), pair % max(1, len(terms))
    return Queries(keys, terms, np.searchsorted(doc, np.arange(len(t) + 1)), term, times)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one after the other."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def added(at: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by place."""
    if float(value.sum(dtype=np.float64)) < 2.0**52:  # then floats add exactly
        return np.bincount(at, value, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    np.add.at(out, at, value)
    return out


class Shard:
    """A row of the index, ready for queries."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.terms, self.first, self.docs, self.impacts = get("terms", np.uint64), get("first", np.int64), get("docs", np.uint16), get("impacts", np.int32)
        self.n = len(row["ids"])
        self.blocks = np.append(np.flatnonzero(np.unpackbits(get("starts", np.uint8), count=len(self.docs))), len(self.docs))
        self.first_block = np.searchsorted(self.blocks, self.first)
        self.tops = np.maximum.reduceat(self.impacts, self.blocks[:-1]).astype(np.int64)
        self.low = self.docs[self.blocks[:-1]].astype(np.int64)
        self.after = self.docs[self.blocks[1:] - 1].astype(np.int64) + 1

    def place(self, terms: np.ndarray) -> np.ndarray:
        """Where the shard's lists of these terms are; -1 where it has none."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def best(self, lists: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k documents with the highest scores above 0, equal ones by number; their scores, and how many postings were read."""
        size = self.first_block[lists + 1] - self.first_block[lists]
        block, weight = spread(self.first_block[lists], size), np.repeat(weights, size)
        gain = weight * self.tops[block]
        bound = np.cumsum(added(self.low[block], gain, self.n + 1) - added(self.after[block], gain, self.n + 1))[:-1]
        pivots, n_read = bound > 0, 0
        if np.count_nonzero(pivots) > SEEDS:
            seeds = np.zeros(self.n, bool)
            seeds[np.argpartition(-bound, SEEDS)[:SEEDS]] = True
            score, n_read = self.scores(block, weight, seeds)
            if len(score := score[seeds]) >= k:
                pivots &= bound >= np.partition(score, len(score) - k)[len(score) - k]
        score, n = self.scores(block, weight, pivots)
        found = np.flatnonzero(pivots & (score > 0))
        found = found[np.lexsort((found, -score[found]))[:k]]
        return found, score[found], n_read + n

    def scores(self, block: np.ndarray, weight: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, int]:
        """Exact scores of the pivots (of other documents less), from the blocks that pivots lie in; how many postings these have."""
        before = np.concatenate([[0], np.cumsum(pivots)])
        some = before[self.after[block]] > before[self.low[block]]
        block, weight = block[some], weight[some]
        size = self.blocks[block + 1] - self.blocks[block]
        at = spread(self.blocks[block], size)
        return added(self.docs[at], np.repeat(weight, size) * self.impacts[at], self.n), len(at)


def frequencies(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Documents of all shards that hold each term (sorted hashes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for own, first in zip(batch.column("terms"), batch.column("first"), strict=True):
                own, first = np.frombuffer(own.as_py(), np.uint64), np.frombuffer(first.as_py(), np.int64)
                if len(own):
                    at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
                    total += np.where(own[at] == terms, first[at + 1] - first[at], 0)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    found = batched(shards.select("terms", "first"), run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    out = np.zeros(len(terms), np.int64)
    out[found.column("term").to_numpy()] = found.column("df").to_numpy()
    return out


def weights_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2.0 * n + 2.0) / (2.0 * df + 1.0))).astype(np.int64)


def _found(shards: DataFrame, q: Queries, n: int, k: int) -> DataFrame:
    """Each shard's best documents of each query: query, doc_id, score."""
    df = frequencies(shards, q.terms)
    weight = np.where(df > 0, weights_of(df, n), 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                if not len(shard.terms):
                    continue
                ids, place = pa.array(row["ids"], pa.int64()), shard.place(q.terms)
                keys, docs, scores = [], [], []
                for i, key in enumerate(q.keys):
                    term, times = q.term[q.first[i] : q.first[i + 1]], q.times[q.first[i] : q.first[i + 1]]
                    w = weight[term] * times
                    here = (place[term] >= 0) & (w > 0)
                    if here.any():
                        d, s, _ = shard.best(place[term[here]], w[here], k)
                        keys += [key] * len(d)
                        docs.append(d)
                        scores.append(s)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), ids.take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(scores))], names=["query", "doc_id", "score"])
        W.give_back()

    return shards.select("ids", "terms", "first", "docs", "impacts", "starts").mapInArrow(run, "query string, doc_id long, score long")


def search(shards: DataFrame, size: tuple[int, int], queries: DataFrame, k: int = 10, key: str = "item_id", text: str = "text") -> DataFrame:
    """Columns of the key, rank, doc_id and score: the `k` best documents of each query over all shards."""
    asked = queries.select(F.col(key), F.col(text).alias("text")).where("text is not null").distinct().withColumn("query", F.sha2("text", 256))
    texts = written(asked.select("query", "text").distinct(), "queries")
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    parts = -(-total // QUERY_BYTES)
    found = None
    for part in range(parts):
        held = texts.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == part).toArrow()
        if held.num_rows:
            rows = _found(shards, queries_of(held.column("query").to_pylist(), held.column("text").combine_chunks()), size[0], k)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = asked.sparkSession.createDataFrame([], "query string, doc_id long, score long")
    by = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return best.join(asked.drop("text"), "query").select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The `k` best of documents (doc_id, text) for each query (item_id, text)."""
    size = sizes(docs)
    return search(written(index(docs, size), "postings", **ROW_GROUPS), size, queries, k)
