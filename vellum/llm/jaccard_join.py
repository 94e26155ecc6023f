"""N-gram Jaccard join with signature trees.

A document's set holds its distinct shingles of five words (A-Z in lower case),
as 64-bit hashes; with fewer words the whole sequence is the only one.  Two sets
link when 100 * intersection >= 80 * union.  Documents with equal sets are one
vertex, and a component is what links connect.

1. Signatures: each text gives its set's fingerprint, size, bitmap (about 3 to 6
   bits a shingle) and prefix: of the hashes in a fixed order the first
   n - ceil(0.8 n) + 1.  Sets that link share a hash of both prefixes, of the smaller
   set even of its first n - ceil(8 n / 9) + 1, so no link is lost.  The order puts
   the `MOST_COMMON` hashes found in most texts last; which they are affects speed only.
2. Blocks: hashes that only one set has are dropped.  The sets that share a hash,
   and are in the same or the next class of size, meet under the smallest of them, so sets
   that share many hashes meet once.  Larger blocks are split into parts, and every two parts meet.
3. Signature trees: in a block, nodes hold the OR of their bitmaps, the range of sizes and the
   largest number of shingles without a bit of their own.  Two trees are walked together
   from the top; a pair of nodes goes when its largest possible overlap is too small.
   Sets without a partner go, and the others fall into the clusters that the pairs left connect.
4. Links: the texts of the sets left are read again; intersections are exact, by
   breadth-first search from set to set, and a spanning forest is what a cluster returns.
5. Components: smallest labels are passed along the forest's edges until nothing changes.

All grouping is by shuffles that combine on the map side; a block has a bounded number of sets and
shingles, and keys that very many rows share are joined by broadcast of those keys alone.  The sets of a
large block are compared part by part, so the work in one very large cluster of different near copies
grows with the square of its number of different sets (exact copies are one set).

Cases: null and empty texts have no shingles, link with nothing and are their own
component; null identifiers take part but name no component unless there is no
other; repeated rows are copies; an empty table gives no rows; of the columns only
identifier and text are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .frames import batched, hot_join, hot_keys, written

SHINGLE = 5
#: Most sets, and about most shingles, of one part of a block.
PART, PART_SHINGLES = 1024, 1 << 21
#: Bytes of a table of a few longs that may be broadcast, and what a row of it takes.
MOST_BROADCAST, ROW = 64 << 20, 32
LEAF, FAN = 8, 8
CLASS_RATIO = 1.25
#: Hashes that are ordered last, and how often a task must meet one to report it.
MOST_COMMON, LOCALLY_COMMON = 1 << 19, 4
SIGNATURE = "doc_id long, record long, n_shingles long, vertex long, bitmap binary, prefix array<long>"


def shingle_sets(t: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one text after the other, and their offsets."""
    r = W.words(t, fold=True)
    h, at = W.grams(r.hash, r.doc, SHINGLE)
    doc = r.doc[at]
    n_words = W.counted(r.doc, len(t))
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        first = np.searchsorted(r.doc, short)
        sums = [np.add.reduce(r.hash[f : f + n_words[d]] * W._GRAM[8 : 8 + n_words[d]]) for d, f in zip(short, first, strict=True)]
        whole = W.mix(np.array(sums, np.uint64) ^ n_words[short].astype(np.uint64))
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
        h, doc = h[new], doc[new]
    return h, np.concatenate([[0], np.cumsum(W.counted(doc, len(t)))])


def bitmap(h: np.ndarray) -> np.ndarray:
    """A bit for each hash, in a power of two of at least three bits a hash."""
    width = 1 << max(6, int(3 * len(h) - 1).bit_length())
    out = np.zeros(width, bool)
    out[(h >> np.uint64(20)) & np.uint64(width - 1)] = True
    return np.packbits(out, bitorder="little")


def common_hashes(docs: DataFrame, text: str) -> np.ndarray:
    """Up to MOST_COMMON hashes that tasks met in most texts, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def often(held: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= LOCALLY_COMMON
            return pa.RecordBatch.from_arrays([pa.array(h[many].view(np.int64)), pa.array(n[many])], names=["h", "n"])

        held: list[np.ndarray] = []
        for batch in W.slices(batches, "text"):
            held.append(shingle_sets(W.texts_of(batch.column("text")))[0])
            if sum(map(len, held)) > 4 << 20:
                yield often(held)
                held = []
        if held:
            yield often(held)

    counts = batched(docs.select(F.col(text).alias("text")), run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).select("h").toArrow().column("h").to_numpy().view(np.uint64))


def common_last(h: np.ndarray, at: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes of each text with its common ones after the others, both parts in order."""
    if not len(common) or not len(h):
        return h
    place = np.minimum(np.searchsorted(common, h), len(common) - 1)
    late = common[place] == h
    before = np.concatenate([[0], np.cumsum(late)])
    n = np.diff(at)
    start, rare = np.repeat(at[:-1], n), np.repeat(n - (before[at[1:]] - before[at[:-1]]), n)
    rank_late = before[:-1] - np.repeat(before[at[:-1]], n)
    rank_rare = np.arange(len(h)) - start - rank_late
    out = np.empty_like(h)
    out[start + np.where(late, rare + rank_late, rank_rare)] = h
    return out


def signatures(docs: DataFrame, key: str, text: str, common: np.ndarray) -> DataFrame:
    """SIGNATURE columns of every row; `record` names identifier and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            h, at = shingle_sets(W.texts_of(batch.column("text")))
            n = np.diff(at)
            mixed = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(W.mix(h), out=mixed[1:])
            vertex = W.mix((mixed[at[1:]] - mixed[at[:-1]]) ^ n.astype(np.uint64)).view(np.int64)
            size = np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)
            ends = np.cumsum(size)
            where = np.repeat(at[:-1] - (ends - size), size) + np.arange(int(ends[-1]))
            prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(common_last(h, at, common)[where].view(np.int64)))
            maps = [bitmap(h[a:b]).tobytes() if b > a else None for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("record"), pa.array(n), pa.array(vertex), pa.array(maps, pa.binary()), prefix], names=["doc_id", "record", "n_shingles", "vertex", "bitmap", "prefix"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.col(key), F.lit("|"), F.col(text)).alias("record"), F.col(text).alias("text"))
    return batched(rows, run, SIGNATURE)


def _sized(small: DataFrame) -> DataFrame:
    """With a broadcast hint if the rows (of a few longs) take few enough bytes; else the join shuffles."""
    most = MOST_BROADCAST // ROW
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small


def _shared_rows(held: DataFrame, shared: DataFrame) -> DataFrame:
    """The rows of `held` whose hash is shared; beyond a broadcast, those with a hot hash still meet a broadcast of the hot ones."""
    if shared.limit(MOST_BROADCAST // ROW + 1).count() <= MOST_BROADCAST // ROW:
        return held.join(F.broadcast(shared.select("h")), "h")
    return hot_join(held, shared.select("h"), ["h"], hot_keys(shared, ["h"], "times"))


def blocks(marks: DataFrame) -> DataFrame:
    """Columns block and vertex: each two sets that can link are together in some block of at most two parts."""
    short = F.col("r") <= F.col("n") - F.ceil(F.col("n") * 8 / 9)  # within the prefix of the smaller set of a pair
    held = marks.select("vertex", F.col("n_shingles").alias("n"), F.posexplode("prefix").alias("r", "h")).select("h", "vertex", "n", short.alias("short"))
    shared = held.groupBy("h").agg(F.min("vertex").alias("a"), F.max("vertex").alias("b"), F.max("short").alias("short"), F.count(F.lit(1)).alias("n")).where("a <> b and short")
    shared = written(shared.select("h", F.col("n").alias("times")), "shared-hashes")
    kept = _shared_rows(held, shared).distinct()
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(CLASS_RATIO)) + 1e-9).cast("int")
    own, next_class = F.struct(size_class.alias("s"), F.lit(True).alias("own")), F.struct((size_class + 1).alias("s"), F.lit(False).alias("own"))
    classes = F.when(F.col("short"), F.array(own, next_class)).otherwise(F.array(own))
    classed = written(kept.select("h", "vertex", "short", F.explode(classes).alias("c")).select("h", "c.s", "c.own", "short", "vertex"), "size-classes")
    meets = classed.groupBy("h", "s").agg(F.min("vertex").alias("centre"), F.max("vertex").alias("last"), F.max("own").alias("some_own"), F.max("short").alias("some_short"), F.count(F.lit(1)).alias("n"))
    meets = written(meets.where("centre <> last and some_own and some_short").select("h", "s", "centre", "n"), "meets")
    hot = hot_keys(meets, ["h", "s"])
    members = written(hot_join(classed, meets.drop("n"), ["h", "s"], hot).select("centre", "s", "vertex").distinct(), "meetings")
    most = F.least(F.lit(float(PART)), F.greatest(F.lit(16.0), PART_SHINGLES / F.pow(F.lit(CLASS_RATIO), F.col("s") + 1)))
    parts = written(members.groupBy("centre", "s").agg(F.count(F.lit(1)).alias("n")).select("centre", "s", "n", F.ceil(F.col("n") / most).cast("int").alias("parts")), "parts")
    own = F.pmod(F.xxhash64(F.lit("part"), "vertex"), F.col("parts")).cast("int")
    placed = hot_join(members, parts.drop("n"), ["centre", "s"], hot_keys(parts, ["centre", "s"])).withColumn("own", own)
    other = placed.select("centre", "s", "vertex", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return other.select(F.xxhash64("centre", "s", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "vertex")


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key together, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        k = batch.column(key).to_numpy()
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(key)[0].as_py() != k[a]:
                yield pa.concat_batches(held) if len(held) > 1 else held[0]
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]
    W.give_back()


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For 0 to n - 1 the smallest number reached over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


class SignatureTree:
    """Levels of nodes from the sets (level 0) up; each node covers up to FAN nodes (LEAF sets) below."""

    def __init__(self, maps: np.ndarray, n: np.ndarray):
        rest = n - np.bitwise_count(maps).sum(1, dtype=np.int64)
        self.levels = [(maps, n, n, rest)]
        self.fans = []
        while len(self.levels[-1][0]) > FAN:
            maps, low, high, rest = self.levels[-1]
            fan = LEAF if len(self.levels) == 1 else FAN
            first = np.arange(0, len(maps), fan)
            self.fans.append(fan)
            self.levels.append((np.bitwise_or.reduceat(maps, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first), np.maximum.reduceat(rest, first)))

    def possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sets of two nodes could overlap enough: 9 * overlap >= 4 * (both sizes)."""
        maps, low, high, rest = self.levels[level]
        most = np.minimum(high[a], high[b])
        least = 4 * (low[a] + low[b])
        keep = np.flatnonzero(9 * most >= least)
        out = np.zeros(len(a), bool)
        step = max(1, (8 << 20) // maps[0].nbytes)
        for at in range(0, len(keep), step):
            k = keep[at : at + step]
            both = np.bitwise_count(maps[a[k]] & maps[b[k]]).sum(1, dtype=np.int64) + np.minimum(rest[a[k]], rest[b[k]])
            out[k] = 9 * np.minimum(both, most[k]) >= least[k]
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets (a < b) left by the dual traversal."""
        top = len(self.levels) - 1
        a, b = (x.ravel() for x in np.indices((len(self.levels[top][0]),) * 2))
        a, b = a[a <= b], b[a <= b]
        for level in range(top, -1, -1):
            if not level:
                a, b = a[a != b], b[a != b]
            keep = self.possible(level, a, b)
            a, b = a[keep], b[keep]
            if level:
                fan, below = self.fans[level - 1], len(self.levels[level - 1][0])
                i, j = (x.ravel() for x in np.indices((fan, fan)))
                a, b = (a[:, None] * fan + i).ravel(), (b[:, None] * fan + j).ravel()
                inside = (a < below) & (b < below) & (a <= b)
                a, b = a[inside], b[inside]
        return a, b


def clusters(vertex: np.ndarray, n: np.ndarray, maps: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the sets that have a possible partner, and the cluster of each."""
    width = min(map(len, maps))
    folded = np.empty((len(maps), width), np.uint8)
    for k, m in enumerate(maps):
        folded[k] = np.bitwise_or.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0)
    folded = folded.view(np.uint64)
    order = np.lexsort((n, folded[:, 0]))
    a, b = SignatureTree(folded[order], n[order]).pairs()
    label = connected(len(maps), a, b)
    some = np.unique(np.concatenate([a, b]))
    return order[some], vertex[order[label[some]]]


def prune(members: DataFrame) -> DataFrame:
    """Columns cluster, vertex and record of the sets (block, vertex, record, n, bitmap) that keep a partner.

    A cluster is named by its sets, so the same one found in several blocks is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cluster", "vertex", "record"])

        for group in runs_of(batches, "block"):
            vertex, first = np.unique(group.column("vertex").to_numpy(), return_index=True)
            if len(first) < 2:
                continue
            maps = group.column("bitmap").take(pa.array(first)).to_pylist()
            keep, label = clusters(vertex, group.column("n").to_numpy()[first], maps)
            if len(keep):
                which, inverse = np.unique(label, return_inverse=True)
                order = np.argsort(inverse, kind="stable")
                sums = np.add.reduceat(W.mix(vertex[keep][order].view(np.uint64)), np.searchsorted(inverse[order], np.arange(len(which))))
                out.append((W.mix(sums).view(np.int64)[inverse], vertex[keep], group.column("record").to_numpy()[first][keep]))
                size += len(keep)
            if size > 1 << 16:
                yield emit()
                out.clear()
                size = 0
        if out:
            yield emit()

    left = batched(members.repartition("block").sortWithinPartitions("block"), run, "cluster long, vertex long, record long")
    return left.distinct()


def forest(vertex: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (set, set it was reached from) of a spanning forest of the exact links."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    values, which, times = np.unique(h, return_inverse=True, return_counts=True)
    by_value = owner[np.argsort(which, kind="stable")]
    begin = np.cumsum(times) - times
    unseen = np.ones(len(n), bool)
    found, origin = [], []
    for start in range(len(n)):
        if not unseen[start]:
            continue
        unseen[start] = False
        queue = [start]
        while queue and unseen.any():
            a = queue.pop()
            k = which[at[a] : at[a + 1]]
            ends = np.cumsum(times[k])
            where = np.repeat(begin[k] - (ends - times[k]), times[k]) + np.arange(int(ends[-1]))
            both = np.bincount(by_value[where], minlength=len(n))
            linked = np.flatnonzero(unseen & (9 * both >= 4 * (n[a] + n)) & (both > 0))
            unseen[linked] = False
            queue += linked.tolist()
            found.append(vertex[linked])
            origin.append(np.full(len(linked), vertex[a]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(origin)


def links(left: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Edges (a, b) that connect just what the exact links among the sets of each cluster connect."""
    wanted = left.select("record").distinct()
    rows = docs.select(F.xxhash64(F.col(key), F.lit("|"), F.col(text)).alias("record"), F.col(text).alias("text")).join(_sized(wanted), "record")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.slices(batches, "text"):
            h, at = shingle_sets(W.texts_of(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["record", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of(batches, "cluster"):
            vertex, first = np.unique(group.column("vertex").to_numpy(), return_index=True)
            lists = group.column("hashes").take(pa.array(first))
            at = np.asarray(lists.offsets)
            a, b = forest(vertex, lists.values.to_numpy().view(np.uint64)[at[0] : at[-1]], at - at[0])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = left.join(batched(rows, sets, "record long, hashes array<long>"), "record").select("cluster", "vertex", "hashes")
    return batched(found.repartition("cluster").sortWithinPartitions("cluster"), run, "a long, b long").distinct()


def labels(edges: DataFrame) -> DataFrame:
    """Columns vertex and label: for every vertex with an edge, the smallest vertex of its component.

    Each round takes the smallest label among the neighbours and then that
    label's own label, so paths shorten fast; rounds are written to the shared folder.
    A vertex with very many edges, and a label that very many have, is joined by broadcast.
    """
    both = written(edges.union(edges.select("b", "a")).distinct().select("a", F.col("b").alias("vertex")), "edges")
    now = written(both.groupBy(F.col("a").alias("vertex")).agg(F.least(F.min("vertex"), F.col("a")).alias("label")), "labels")
    hubs = hot_keys(both.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")), ["vertex"])
    while True:
        near = hot_join(both, now, ["vertex"], hubs).groupBy(F.col("a").alias("vertex")).agg(F.min("label").alias("near"))
        low = written(now.join(near, "vertex").select("vertex", F.least("label", "near").alias("label"), F.col("label").alias("old")), "near-labels")
        jump = now.select(F.col("vertex").alias("label"), F.col("label").alias("further"))
        shared = hot_keys(low.groupBy("label").agg(F.count(F.lit(1)).alias("n")), ["label"])
        new = written(hot_join(low, jump, ["label"], shared).select("vertex", F.least("label", "further").alias("label"), "old"), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("vertex", "label")
        now = new.select("vertex", "label")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Identifier, record (hash of identifier and text), n_shingles, component_id and label, one row a row.

    `component_id` is an identifier, so components may share one where identifiers repeat; `label` is the component's own.
    """
    marks = written(signatures(docs, key, text, common_hashes(docs, text)), "signatures")
    some = marks.where("n_shingles > 0")
    kinds = written(some.groupBy("vertex").agg(F.min("record").alias("record"), F.min("doc_id").alias("low")), "vertices")
    members = written(blocks(some), "members")
    meeting = kinds.join(_sized(members.select("vertex").distinct()), "vertex", "left_semi").select("vertex", "record")
    chosen = some.select("vertex", "record", F.col("n_shingles").alias("n"), "bitmap").join(_sized(meeting), ["vertex", "record"])
    left = written(prune(members.join(chosen, "vertex").select("block", "vertex", "record", "n", "bitmap")), "clusters")
    found = labels(links(left, docs, key, text))
    labelled = written(kinds.select("vertex", "low").join(found, "vertex").select("vertex", "label", "low"), "labelled")
    lowest = written(labelled.groupBy("label").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("n")), "components")
    linked = hot_join(labelled.drop("low"), lowest.drop("n"), ["label"], hot_keys(lowest, ["label"]))
    named = kinds.select("vertex", "low").join(linked, "vertex", "left").select("vertex", F.coalesce("component", "low").alias("component_id"), F.coalesce("label", "vertex").alias("label"))
    own = marks.select("doc_id", "record", "n_shingles", "vertex").join(named, "vertex", "left")
    alone = F.col("n_shingles") == 0
    return own.select(F.col("doc_id").alias(key), "record", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.when(~alone, F.col("label")).alias("label"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each component the document with the smallest identifier; documents without words all stay.

    Components are told apart by their label, so unrelated texts with one identifier all stay.
    Of repeated rows (equal identifier and text) one stays.  When a component has
    only null identifiers, one of its documents stays.  What goes is usually little,
    so documents are matched against that, without a shuffle when it is small.
    """
    marked = written(join(docs.select(key, text), key, text), "components")
    group = [F.col("label").alias("_label"), F.when(F.col("n_shingles") == 0, F.col("record")).alias("_own")]
    first = F.min_by("record", F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), "record"))
    chosen = marked.groupBy(*group).agg(first.alias("record")).select("record")
    goes = marked.select("record").distinct().join(chosen, "record", "left_anti")
    again = marked.groupBy("record").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("record")
    goes, again = written(goes, "removed"), written(again, "repeated")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.xxhash64(F.col(key), F.lit("|"), F.col(text)).alias("record"))
    once = rows.join(_sized(goes.union(again).distinct()), "record", "left_anti")
    if again.limit(1).count():
        one = rows.join(_sized(again.join(goes, "record", "left_anti")), "record", "left_semi").dropDuplicates(["record"])
        once = once.unionByName(one)
    return once.select("row.*")
