"""Sharding by fixed virtual slots.

Every record hashes to one of `SLOTS` virtual slots, of which one in `CUT` is cut into
small ones, `SMALL` in all, by other bits of the hash.  Bytes are summed per slot,
and a small versioned table maps slots to shards; rebalancing edits that table
and moves whole slots only.  The map is bounded by the number of slots, so it may
be broadcast; documents themselves are never gathered.

The law that holds is `bytes`: slots go, largest first, to the shard with the
fewest bytes, so the sizes of the shards are near equal.  Whole slots alone would
leave them apart by about one slot, which grows with the table; the small slots come
last and fill that up, to within the bytes of one of them (a two-millionth of the table) or one record.

Records hash by identifier and text, so neither an identifier that repeats with other texts (or
is null) nor a text that repeats under other identifiers fills a slot.  Rows equal in both cannot be
told apart and share a slot, which cannot be split: shards are near equal while no such row repeats so
often that it alone outweighs a shard.

Cases: a null identifier hashes by the text; null and empty texts have the size of their row overhead; repeated
rows are separate records with a position each (their order among equals is
open); an empty table gives an empty map and no rows; extra columns are kept,
and a clash with a result column raises ValueError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .frames import shared_folder

SLOTS = 4096
#: One slot in CUT is cut into small ones, SMALL in all: together they hold 1.6 % of the bytes, more than the 0.6 % that 24 shards can miss before them.
CUT, SMALL = 64, 1 << 15
RUN = 256
OVERHEAD = 8


def text_size(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus the fixed overhead of a record."""
    return F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + F.lit(OVERHEAD).cast("long")


def text_crc32(text: str = "text") -> Column:
    return F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def slot_of(key: str, other: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: by its identifier and another column.  Small slots have numbers from `slots` on."""
    h = F.xxhash64(F.col(key), F.lit("|"), F.col(other))
    pieces = max(1, SMALL // -(-slots // CUT))
    whole, piece = F.pmod(h, F.lit(slots)), F.pmod(F.shiftright(h, 32), F.lit(pieces))
    return F.when(whole % CUT == 0, slots + F.floor(whole / CUT) * pieces + piece).otherwise(whole).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each slot that has records (columns virtual_slot, size)."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def balanced(sizes: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Give each slot a shard; a slot that has one (column shard) moves only where that evens out the bytes.

    One fold over the slots, largest first: the state holds the bytes of each
    shard and the choices so far.  `sizes` has at most as many rows as there are slots.
    """
    if "shard" not in sizes.columns:
        sizes = sizes.withColumn("shard", F.lit(None).cast("int"))
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows", "shard")), asc=False).alias("slots"))
    loads = f"transform(sequence(0, {shards - 1}), i -> aggregate(filter(slots, x -> x.shard <=> i), 0L, (a, x) -> a + x.bytes))"
    empty = "cast(array() as array<struct<virtual_slot:int,bytes:bigint,rows:bigint,shard:int>>)"
    step = f"""
        aggregate(
            array(cast(array_position(s.load, array_min(s.load)) - 1 as int)),
            s,
            (t, least) -> aggregate(
                array(if(x.shard is null or x.shard >= {shards} or t.load[x.shard] - x.bytes >= t.load[least], least, x.shard)),
                t,
                (u, goal) -> named_struct(
                    'load', transform(u.load, (v, i) -> v + if(i = goal, x.bytes, 0L) - if(i <=> x.shard, x.bytes, 0L)),
                    'chosen', array_append(u.chosen, named_struct('virtual_slot', x.virtual_slot, 'bytes', x.bytes, 'rows', x.rows, 'shard', goal)))))
    """
    # runs of slots, as each choice that is added copies those before it in its run
    fold = f"""
        aggregate(
            sequence(1, greatest(1, size(slots)), {RUN}),
            named_struct('load', {loads}, 'chosen', {empty}),
            (a, first) -> aggregate(
                array(aggregate(slice(slots, first, {RUN}), named_struct('load', a.load, 'chosen', {empty}), (s, x) -> {step})),
                a,
                (b, r) -> named_struct('load', r.load, 'chosen', concat(b.chosen, r.chosen))))
    """
    return one.select(F.explode(F.expr(fold)["chosen"]).alias("m")).select(F.lit(version).alias("version"), "m.*")


def store_map(slot_map: DataFrame, path: str, version: int = 1) -> None:
    """Add a version of the map; versions that exist are never overwritten."""
    slot_map.write.mode("errorifexists").parquet(f"{path}/{version:06d}")


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("version int, virtual_slot int, bytes long, rows long, shard int").parquet(f"{path}/{version:06d}")


def assign(records: DataFrame, slot_map: DataFrame, order: list[str], slots: int = SLOTS) -> DataFrame:
    """Records (with virtual_slot and size) with their shard and their gapless position in it, from 0.

    Positions run slot by slot: a window numbers the rows of each slot, and the
    rows of the shard's earlier slots are added from the map, so no task sees a whole shard.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = slot_map.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("virtual_slot").orderBy(*order)
    if slots > 1 << 16:
        raise ValueError("a map of that many slots is not for broadcasting")
    return (
        records.withColumn("inside", F.row_number().over(inside))
        .join(F.broadcast(placed), "virtual_slot")
        .withColumn("slot", (F.col("first") + F.col("inside") - 1).cast("long"))
        .drop("inside", "first")
    )


def records_of(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Documents with their size, text_crc32 and virtual_slot."""
    if clash := sorted({c.lower() for c in docs.columns} & {"size", "text_crc32", "virtual_slot", "law", "shard", "slot", "grown_shard", "inside", "first"}):
        raise ValueError(f"columns already present: {', '.join(clash)}")
    return docs.withColumns({"size": text_size(text), "text_crc32": text_crc32(text), "virtual_slot": slot_of(key, text, slots)})


def shard(records: DataFrame, shards: int, key: str = "doc_id", slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """The records (see records_of) with law, shard, slot and grown_shard.

    The map of version 1 is stored under `map_path` (by default in the shared
    folder).  Drop the text from the records before where only the placement is
    wanted; it is not needed here.
    """
    path = map_path or shared_folder(records.sparkSession, "slot-map")
    store_map(balanced(slot_sizes(records.select("virtual_slot", "size")), shards), path)
    placed = assign(records, load_map(records.sparkSession, path, 1), [key, "text_crc32", "size"], slots)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def write_shards(sharded: DataFrame, path: str) -> None:
    """The documents in one folder a shard; a shard is written by many tasks, slot by slot."""
    sharded.repartition("shard", "virtual_slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
