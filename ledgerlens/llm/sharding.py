"""Operator 13: shards by fixed virtual slots, in DataFrame functions alone.

A record's id, size and checksum are hashed to one of ``slots`` virtual slots, whose number never changes. A table of
(version, slot, shard, bytes, rows) says which shard serves a slot. Version 0 deals the slots out by turns. rebalance()
writes the next version: every shard gives up the slots beyond an even share of the bytes, its smallest, and these go,
largest first, each to the shard that has least. grow() writes a version with one more shard, into which alone slots move.
Versions are never changed; they lie in the shared folder.

The law is ``bytes``: shards differ by no more than about the largest slot that moved.

* Texts are read once, to (id, size, checksum), counted before they are shuffled, and written; all else reads that table.
* What meets on the driver or is broadcast has one row a slot.
* Places in a shard come from the slots' counts: the rows of a shard are never sorted together, only those of a slot.
* Equal rows (id, size and checksum) are told apart by lanes of ``LANE`` copies, and each lane has a virtual slot of its
  own; so an id that holds a third of all rows is spread as well.

Defined cases: a null text has no bytes (size 1, checksum 0); an empty text likewise; null ids are hashed as such;
repeated rows are rows; equal texts under different ids fall into shards on their own; very long texts count whole, and
one that outweighs a shard's share has a shard that is larger by it; an empty table gives no rows and a map without
bytes; further columns are ignored, and kept by records().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import free_name
from .scratch import Scratch

LANE = 4096
MAP = "version int, slot int, shard int, bytes long, rows long"


def size_and_checksum(text: Column) -> tuple[Column, Column]:
    whole = F.coalesce(text, F.lit(""))
    return (F.octet_length(whole) + 1).cast("long"), F.crc32(whole.cast("binary"))


def virtual_slot(slots: int, lane: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "size", "text_crc32", lane), F.lit(slots)).cast("int")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, n): the distinct digests of the rows, and how many rows have them."""
    size, crc = size_and_checksum(F.col("text"))
    return docs.select("doc_id", size.alias("size"), crc.alias("text_crc32")).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))


def lanes(counted: DataFrame, slots: int) -> DataFrame:
    """(doc_id, size, text_crc32, lane, n, virtual_slot): the digests in lanes of at most LANE equal rows."""
    lane = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {LANE}")))
    dealt = counted.select("doc_id", "size", "text_crc32", "n", lane.alias("lane"))
    rows = F.least(F.lit(LANE).cast("long"), F.col("n") - F.col("lane") * LANE)
    return dealt.withColumn("n", rows).withColumn("virtual_slot", virtual_slot(slots, F.col("lane")))


def first_map(spark: SparkSession, dealt: DataFrame, slots: int, shards: int) -> DataFrame:
    """Version 0: slots by turns, with the bytes and rows that they hold; slots without rows are there too."""
    held = dealt.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    return every.join(held, every.slot == held.virtual_slot, "left").select(
        F.lit(0).alias("version"), "slot", (F.col("slot") % shards).cast("int").alias("shard"), F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


def _given_up(current: DataFrame, shards: int) -> DataFrame:
    """current with `stays`: the largest slots of a shard stay, as long as they are within an even share of all bytes.
    A map has one row a slot, so the window over all of its one version is bounded by their number."""
    share = F.sum("bytes").over(Window.partitionBy("version")) / shards
    so_far = F.sum("bytes").over(Window.partitionBy("version", "shard").orderBy(F.desc("bytes"), "slot").rowsBetween(Window.unboundedPreceding, 0))
    return current.withColumn("stays", (so_far <= share) | (F.col("bytes") == 0))


def rebalance(current: DataFrame, shards: int) -> DataFrame:
    """The next version, with shards near equal in bytes. The slots given up are folded, largest first, over the shards'
    loads; there is one row a slot, so the fold is bounded by their number."""
    marked = _given_up(current, shards)
    kept = F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))).alias("kept")
    loose = F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("less"), "slot")))).alias("loose")
    start = f"""array_sort(transform(sequence(0, {shards - 1}), s -> struct(
        aggregate(filter(kept, k -> k.shard = s), 0L, (a, k) -> a + k.bytes) AS bytes, s AS shard)))"""
    placed = f"""aggregate(loose, struct({start} AS loads, cast(array() AS array<struct<slot: int, to: int>>) AS moves),
        (done, x) -> struct(
            array_sort(transform(done.loads, (y, i) -> CASE WHEN i = 0 THEN struct(y.bytes - x.less AS bytes, y.shard AS shard) ELSE y END)) AS loads,
            array_append(done.moves, struct(x.slot AS slot, done.loads[0].shard AS to)) AS moves),
        done -> done.moves)"""
    moves = marked.agg(kept, loose).select(F.explode(F.expr(placed)).alias("m")).select("m.slot", "m.to")
    return marked.join(F.broadcast(moves), "slot", "left").select((F.col("version") + 1).alias("version"), "slot", F.coalesce("to", "shard").alias("shard"), "bytes", "rows")


def grow(current: DataFrame, shards: int) -> DataFrame:
    """The next version with one shard more than `shards`, numbered `shards`; what each gives up goes there."""
    return _given_up(current, shards + 1).select((F.col("version") + 1).alias("version"), "slot", F.when(F.col("stays"), F.col("shard")).otherwise(shards).alias("shard"), "bytes", "rows")


class Shards:
    """The slot map of a table, with all its versions, and the places of its rows."""

    def __init__(self, docs: DataFrame, shards: int = 8, slots: int = 4096):
        self.spark, self.slots, self.shards = docs.sparkSession, slots, shards
        self.scratch = Scratch(self.spark)
        self.counted = self.scratch.keep(digests(docs))
        self.versions = [self.scratch.keep(first_map(self.spark, self.dealt(), slots, shards).coalesce(1))]

    def dealt(self) -> DataFrame:
        return lanes(self.counted, self.slots)

    def rebalance(self) -> Shards:
        self.versions.append(self.scratch.keep(rebalance(self.versions[-1], self.shards).coalesce(1)))
        return self

    def grow(self) -> Shards:
        self.versions.append(self.scratch.keep(grow(self.versions[-1], self.shards).coalesce(1)))
        self.shards += 1
        return self

    def places(self) -> DataFrame:
        """(doc_id, size, text_crc32, virtual_slot, shard, slot) for each row, by the last version; slot is the row's
        place in its shard, from 0 without a gap: the rows of the shard's slots before its own, and its place in that."""
        own = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        where = self.versions[-1].select(F.col("slot").alias("virtual_slot"), "shard", F.coalesce(F.sum("rows").over(own), F.lit(0)).alias("offset"))
        before = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32", "lane").rowsBetween(Window.unboundedPreceding, -1)
        ordered = self.dealt().withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        placed = ordered.join(F.broadcast(where), "virtual_slot")  # one row a slot
        at = F.col("offset") + F.col("before")
        return placed.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", F.explode(F.sequence(at, at + F.col("n") - 1)).alias("slot"))

    def records(self, docs: DataFrame) -> DataFrame:
        """The rows of docs with their shard in a column of that name (of a free name, where they have one). Only digests
        of more than LANE rows are looked up; their rows choose a lane each."""
        size, crc = size_and_checksum(F.col("text"))
        name, t = free_name(docs, "shard"), free_name(docs, "slot_of")
        hot = self.counted.where(F.col("n") > LANE)
        row = docs.select(F.struct(*[F.col("`{}`".format(c.replace("`", "``"))) for c in docs.columns]).alias("row"), "doc_id", size.alias("size"), crc.alias("text_crc32"))
        same = (row.doc_id.eqNullSafe(hot.doc_id)) & (row["size"] == hot["size"]) & (row.text_crc32 == hot.text_crc32)
        looked = row.join(hot, same, "left").select("row", row.doc_id, row["size"], row.text_crc32, F.coalesce(F.pmod(F.monotonically_increasing_id(), F.expr(f"(n - 1) div {LANE} + 1")), F.lit(0)).alias("lane"))
        where = self.versions[-1].select(F.col("slot").alias(t), F.col("shard").alias(name))
        out = looked.withColumn("virtual_slot", virtual_slot(self.slots, F.col("lane"))).join(F.broadcast(where), F.col("virtual_slot") == F.col(t))
        return out.select("row.*", name)


def by_bytes(docs: DataFrame, shards: int = 8, slots: int = 4096) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot) for each row, after one rebalancing."""
    placed = Shards(docs, shards, slots).rebalance().places()
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")
