"""Benchmark decontamination by spaced seeds.

Texts are cut into words (lower case, split at ASCII characters other than
letters and digits).  Each fixed mask names the word positions of a span that count; the others
are ignored, so that a replaced word there does no harm.  The masks miss nothing: however
the replaced words of a window that counts lie, one of its places has a mask on equal
words only.  The hashes of the masked
words at every position of the documents are joined with those of the benchmark.
A hit fixes how document and item lie against each other; the words of the whole
item are then compared in that position, and the pair is an overlap when some
window of `WINDOW` words (the whole item, if shorter) has at least
`SHARE` of its words equal in place.

Only DataFrame and SQL functions are used.  Texts are cut once, every word is hashed
once, and each position becomes one row with a hash for each mask; the rows that no
seed meets go at once.  Seeds, hits and items are broadcast up to
`MOST_BROADCAST` bytes, measured first; beyond that the joins shuffle, that by hash
with the documents' side dealt over `SALTS` copies of the seeds, so that a passage
that most documents share does not meet in one task.

Cases: null and empty texts and items overlap with nothing, nor do items of less
than `shortest` words (one to four words are no evidence unless asked for; they take masks of two words or one); a null identifier is kept as null, of items too; repeated rows (same identifier and
text) give one result, and items with one identifier and several texts are items each; of several
alignments of a pair the one with the best window counts, of equal ones that with more equal words, then the
first; an empty table gives no rows; of the columns of both tables
only identifier and text are read, so others may have any names.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import written

#: Word positions that count, for items of 9 words and more, and for items of 5 to 8 words.
SEEDS, SHORT_SEEDS = ((0, 1, 2, 4), (0, 3, 4, 5)), ((0, 1, 2), (0, 1, 3))
LONG, SHORTEST = 9, 5
#: Fewest and most words of an item, and its masks.
GROUPS = ((LONG, 1 << 30, SEEDS), (SHORTEST, LONG - 1, SHORT_SEEDS), (2, SHORTEST - 1, ((0, 1),)), (1, 1, ((0,),)))
WINDOW, SHARE = 13, 0.75
MOST_BROADCAST = 64 << 20
SALTS = 32
_SPLIT = "[\\x00-/:-@\\[-`{-\\x7f]+"

#: A mask in use: its number, the positions, and the fewest and most words of the items that it is for.
Mask = tuple[int, tuple[int, ...], int, int]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _SPLIT), "")


def record_key(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key), F.lit("|"), F.col(text))


def masks_of(low: int, high: int) -> list[Mask]:
    """The masks of the groups of items that have between `low` and `high` words."""
    out: list[Mask] = []
    for number, (least, most, masks) in enumerate(GROUPS):
        if least <= high and most >= low:
            out += [(10 * number + k, mask, least, most) for k, mask in enumerate(masks)]
    return out


def masked(rows: DataFrame, words: Column, masks: list[Mask]) -> DataFrame:
    """At every word of `rows`: the column id, n (number of words), at (the position) and h<number>, the hash of each mask's words from there on.

    Beyond the end words are missing; such hashes equal those of no whole mask.
    """
    reach = 1 + max(mask[-1] for _, mask, _, _ in masks)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    beside = F.flatten(F.transform(F.array(hashed), lambda h: F.arrays_zip(h, *[F.slice(h, k + 1, F.size(h)) for k in range(1, reach)])))
    each = rows.select("id", F.posexplode(beside).alias("at", "near"))
    names = each.schema["near"].dataType.names
    return each.select("id", "at", *[F.xxhash64(F.lit(n), *[F.col("near")[names[p]] for p in mask]).alias(f"h{n}") for n, mask, _, _ in masks])


def seeds(items: DataFrame, masks: list[Mask]) -> DataFrame:
    """Columns hash, item and item_at: each mask at all places where it lies inside an item that it is for."""
    n = F.size("item_words")
    held = items.select(F.col("item").alias("id"), "item_words")
    each = []
    for mask in masks:
        number, positions, least, most = mask
        inside = masked(held.where(n.between(least, most)), F.col("item_words"), [mask]).join(items.select(F.col("item").alias("id"), n.alias("n")), "id")
        each.append(inside.where(F.col("at") < F.col("n") - positions[-1]).select(F.col(f"h{number}").alias("hash"), F.col("id").alias("item"), F.col("at").alias("item_at")))
    return functools.reduce(DataFrame.unionByName, each)


def _fits(rows: DataFrame, width: Column | int) -> bool:
    """Whether the rows, of a width in bytes each, may be broadcast."""
    width = F.lit(width) if isinstance(width, int) else width
    return (rows.agg(F.sum(width.cast("long"))).first()[0] or 0) <= MOST_BROADCAST


def _sized(small: DataFrame, width: Column | int = 32) -> DataFrame:
    """The rows with a broadcast hint if their bytes allow."""
    return F.broadcast(small) if _fits(small, width) else small


def seed_hits(positions: DataFrame, found: DataFrame, masks: list[Mask]) -> DataFrame:
    """Columns record, item and start of all positions that a seed meets."""
    hashes = [f"h{number}" for number, *_ in masks]
    if _fits(found, 48):
        near = positions
        for h in hashes:
            near = near.join(F.broadcast(found.select(F.col("hash").alias(f"_{h}")).distinct()), F.col(h) == F.col(f"_{h}"), "left")
        some = F.array_compact(F.array(*[F.col(f"_{h}") for h in hashes]))
        near = near.where(functools.reduce(Column.__or__, [F.col(f"_{h}").isNotNull() for h in hashes])).select("id", "at", F.explode(some).alias("hash"))
        met = near.join(F.broadcast(found), "hash")
    else:
        near = positions.select("id", "at", F.explode(F.array(*hashes)).alias("hash")).withColumn("salt", F.pmod(F.col("id"), F.lit(SALTS)))
        met = near.join(found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["hash", "salt"])
    return met.select(F.col("id").alias("record"), "item", (F.col("at") - F.col("item_at")).alias("start")).distinct()


def overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item_key: str = "item_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """One row for each document and item that overlap.

    Columns: record (hash of identifier and text), doc_id, item_id, start (word of
    the document where the item's first word lies, may be negative), item_words,
    matched (words of the item equal in place) and best_window.
    """
    if shortest < 1:
        raise ValueError("items need at least one word")
    named = benchmark.select(F.col(item_key).alias("item_id"), record_key(item_key, text).alias("item"), words_of(F.col(text)).alias("item_words"))
    items = written(named.where(F.size("item_words") >= shortest).dropDuplicates(["item"]), "benchmark-words")
    n = F.size("item_words")
    sizes = items.agg(F.min(n), F.max(n), F.sum(F.octet_length(F.array_join("item_words", " ")) + 24 * n + 64)).first()
    masks = masks_of(sizes[0], sizes[1]) if sizes[0] else masks_of(WINDOW, WINDOW)
    rows = docs.select(F.col(key).alias("doc_id"), record_key(key, text).alias("id"), F.col(text).alias("text"))
    found = written(seeds(items, masks), "benchmark-seeds")
    placed = written(seed_hits(masked(rows, words_of(F.col("text")), masks), found, masks), "seed-hits")
    by_record = placed.join(F.broadcast(items.select("item", n.alias("n"))) if _fits(items, 24) else items.select("item", n.alias("n")), "item")
    by_record = by_record.groupBy(F.col("record").alias("id")).agg(F.collect_list(F.struct("item", "start", "n")).alias("hits"))
    beside = F.flatten(F.transform(F.array(words_of(F.col("text"))), lambda w: F.transform("hits", lambda h: F.struct(h["item"].alias("item"), h["start"].alias("start"), _part(w, h).alias("part")))))
    texts = items.select("item", "item_id", "item_words")
    placed_texts = rows.join(_sized(by_record, 16 + 24 * F.size("hits")), "id").select("id", "doc_id", F.explode(beside).alias("h")).select("id", "doc_id", "h.*")
    aligned = placed_texts.join(F.broadcast(texts) if (sizes[2] or 0) <= MOST_BROADCAST else texts, "item")
    same = "transform(item_words, (x, j) -> if(get(part, j + least(start, 0)) <=> x, 1, 0))"
    aligned = aligned.select(F.col("id").alias("record"), "doc_id", "item", "item_id", "start", n.alias("n"), F.expr(same).alias("same"))
    windows = F.expr(f"array_max(transform(sequence(0, n - least({WINDOW}, n)), s -> aggregate(slice(same, s + 1, least({WINDOW}, n)), 0, (a, x) -> a + x)))")
    judged = aligned.select("record", "doc_id", "item", "item_id", "start", "n", F.expr("aggregate(same, 0, (a, x) -> a + x)").alias("matched"), windows.alias("best_window"))
    judged = judged.where(F.col("best_window") >= F.ceil(F.least(F.lit(WINDOW), F.col("n")) * SHARE))
    best = judged.groupBy("record", "doc_id", "item", "item_id").agg(F.max(F.struct("best_window", "matched", (-F.col("start")).alias("s"), "n")).alias("b"))
    return best.select(
        "record", "doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.n").alias("item_words"), F.col("b.matched").alias("matched"), F.col("b.best_window").alias("best_window")
    )


def _part(words: Column, hit: Column) -> Column:
    """The document's words beside the item; those before its first word are missing at the front."""
    before = F.least(hit["start"], F.lit(0))
    return F.slice(words, hit["start"] - before + 1, F.greatest(hit["n"] + before, F.lit(0)))


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id") -> DataFrame:
    """The documents that overlap with no benchmark item."""
    leaked = written(overlaps(docs, benchmark, key, item_key, text).select("record").distinct(), "leaked")
    columns = docs.columns
    marked = docs.select(F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"), record_key(key, text).alias("record"))
    return marked.join(_sized(leaked), "record", "left_anti").select("row.*")
