"""Stable sharding by jump consistent hashing, in DataFrame functions only.

A key walks through ever larger shard numbers, each a draw of the key's own random sequence, and stays at the last one
below the number of shards. There is no ring or table: the key and the number decide, and when a shard is appended, a
key either stays where it is or goes to the new shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the published function: the multiplier of its random sequence, and the bits of a draw.
MULTIPLIER, DRAW_BITS = 2862933555777941757, 31
#: Blocks that rows are numbered in, over all shards: a table of so many counts joins them up.
BLOCKS = 1 << 16
#: Equal rows that are numbered as one.
CHUNK = 4096


def _next(seed: Column) -> Column:
    """seed * MULTIPLIER + 1 modulo 2**64, as a signed long; a product of longs would not wrap round."""
    whole = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    product = seed.cast("decimal(20,0)") * F.lit(str(MULTIPLIER)).cast("decimal(19,0)")
    return (F.pmod(product + whole((1 << 63) + 1), whole(1 << 64)) - whole(1 << 63)).cast("long")


def jump(key: Column, shards: int) -> Column:
    """A struct of the shards of a key (a long, used as 64 bits) among ``shards`` and among one more.

    A walk has some ln(shards) steps, and never more than there are shards: most keys are through after the first
    few, and only those that aren't go on, so every key gets its exact shard.
    """
    if not 1 <= shards < 1 << 30:
        raise ValueError("shards must be from 1 to 2**30 - 1")
    most = shards + 1
    start = F.struct(key.cast("long").alias("seed"), F.lit(-1).cast("long").alias("before"), F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))

    def step(s: Column, _: Column) -> Column:
        seed = _next(s["seed"])
        moved = F.struct(seed.alias("seed"), s["at"].alias("before"), s["to"].alias("at"), F.lit(None).cast("long").alias("to"))
        return F.when(s["to"] < most, moved).otherwise(s)

    def drawn(s: Column) -> Column:
        part = (F.shiftrightunsigned(s["seed"], 64 - DRAW_BITS) + 1).cast("double")
        to = F.floor((s["at"] + 1).cast("double") * (F.lit(float(1 << DRAW_BITS)) / part)).cast("long")
        return F.struct(s["seed"].alias("seed"), s["before"].alias("before"), s["at"].alias("at"), F.coalesce(s["to"], to).alias("to"))

    # the draw is made from the seed that the first half of a step has put in place, so that it is worked out once
    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(2 * steps)), state, lambda s, i: F.when(s["to"].isNull(), drawn(s)).otherwise(step(s, i)))

    usual = min(most, 8 + 4 * math.ceil(math.log(most)))
    end = walk(start, usual)
    if usual < most:
        end = F.get(F.transform(F.array(end), lambda s: F.when(s["to"] >= most, s).otherwise(walk(s, most))), 0)
    ends = F.transform(F.array(end), lambda s: F.struct(F.when(s["at"] == shards, s["before"]).otherwise(s["at"]).cast("int").alias("shard"), s["at"].cast("int").alias("grown_shard")))
    return F.get(ends, 0)


def with_shard(rows: DataFrame, shards: int, *key: str, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """``rows`` with two more columns: the shard of the ``key`` columns among ``shards``, and among one more.

    Keys of any type are taken by a 64-bit hash; equal keys get equal shards, and nulls are equal to one another.
    No row is moved. The new names must not be among the columns.
    """
    if taken := {shard, grown} & set(rows.columns):
        raise ValueError(f"columns are taken: {sorted(taken)}")
    # an array, which inline() takes apart, so that both come out of one walk
    return rows.select("*", F.inline(F.array(jump(F.xxhash64(*key), shards))).alias(shard, grown))


def number(groups: DataFrame, count: str, within: str, order: list[str], blocks: int) -> DataFrame:
    """``groups`` (rows that stand for ``count`` equal rows) with the number of the first of them among the rows of
    ``within``, as column ``slot``: gapless from 0.

    Rows go by a hash of ``order`` into blocks, in which they are sorted by ``order``; only the blocks' counts are
    added up over the whole of ``within``, so no task holds more than a block, or one row for each block.
    """
    rows = groups.withColumn("block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(within, "block").agg(F.sum(count).alias("c"))
    before = W.partitionBy(within).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select(within, "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("first"))
    inside = W.partitionBy(within, "block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    return rows.join(first, [within, "block"]).withColumn("slot", F.col("first") + F.col("inside")).drop("block", "first", "inside")


def place(documents: DataFrame, shards: int = 16) -> DataFrame:
    """The shard and slot of every row of ``documents`` (doc_id, text), and its shard when one more is appended.

    Returns doc_id, size (UTF-8 bytes of the text plus 1), text_crc32 (unsigned, of the UTF-8 bytes), law (``key``:
    doc_id and the number of shards decide), shard, slot (gapless from 0 in a shard), grown_shard.

    A slot follows from a row's own values, whatever the files or partitions: rows of a shard stand by a hash, which
    mixes their order. Equal rows (doc_id, size and checksum) are counted before they are shuffled, numbered in chunks
    and written out again, so one row that stands very often is no task's work. Rows of one doc_id share a shard, which
    is then as large as they are.

    A null text has no bytes: size 1 and checksum 0, as an empty one. Null doc_ids share one shard. Very long texts
    are only measured where they are read. An empty table gives no rows; further columns are ignored.
    """
    text = F.col("text").cast("string")
    rows = documents.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"))
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    chunks = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long"))))
    chunks = with_shard(chunks.withColumn("n", F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK)), shards, "doc_id")
    placed = number(chunks, "n", "shard", ["doc_id", "size", "text_crc32", "chunk"], max(1, BLOCKS // shards))
    each = F.explode(F.sequence(F.col("slot"), F.col("slot") + F.col("n") - 1)).alias("slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", each, "grown_shard")


def write_shards(documents: DataFrame, path: str, shards: int = 16, parts: int = 1) -> None:
    """``documents`` as Parquet under ``path``, a folder ``shard=k`` for each shard, with some ``parts`` files in each.

    Rows are dealt to a shard's parts by a hash of all their values, so that equal doc_ids needn't meet in one task.
    """
    rows = with_shard(documents, shards, "doc_id").drop("grown_shard")
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]), F.lit(parts))
    rows.repartition(shards * parts, "shard", part).write.partitionBy("shard").parquet(path)


def moving(documents: DataFrame, shards: int) -> DataFrame:
    """The rows that leave their shard when one is appended to ``shards``, with the shard they leave: some 1 in shards + 1."""
    return with_shard(documents, shards, "doc_id").filter(F.col("grown_shard") == shards).drop("grown_shard")
