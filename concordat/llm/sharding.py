"""Sharding by jump consistent hashing: a key and the number of shards decide, without a table.

A key has a fixed sequence of jumps, each to a later shard than the one before, drawn from the MD5 of
the key and the number of the jump.  It stays in the last shard that it reaches below the number of
shards, so one more shard takes a 1/(n+1) share of the keys and moves no other.  Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.operators.slices import ranged, running_sum

from .common import Scratch, partitions

#: Bits of a draw.
BITS = 31
#: Jumps written as one expression; a key with more (for n shards it has about ln n) takes n at most.
USUAL_JUMPS = 24
#: Rows alike that are numbered as one piece.
PIECE = 1 << 16


def jump(key: Column, shards: int) -> Column:
    """The shard, from 0, of a key as text; a null key has the shard of ''."""
    if shards < 1:
        raise ValueError("there must be a shard")
    key = F.coalesce(key.cast("string"), F.lit(""))

    def step(state: Column, k: Column) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", key, k.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
        kept = F.shiftrightunsigned(draw, 32 - BITS) + 1
        to = F.floor((state["to"] + 1) * F.lit(float(1 << BITS)) / kept).cast("bigint")
        return F.when(state["to"] < shards, F.struct(state["to"].alias("at"), to.alias("to"))).otherwise(state)

    def jumps(state: Column, first: int, last: int) -> Column:
        return F.aggregate(F.sequence(F.lit(first), F.lit(last)), state, step)

    zero = F.lit(0).cast("bigint")
    state = jumps(F.struct(zero.alias("at"), zero.alias("to")), 0, min(USUAL_JUMPS, shards))
    if shards > USUAL_JUMPS:
        state = F.when(state["to"] < shards, jumps(state, USUAL_JUMPS + 1, shards)).otherwise(state)
    return state["at"].cast("int")


def with_shard(docs: DataFrame, shards: int = 16, key_col: str = "doc_id", name: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row: nothing is shuffled, a column of that name is replaced."""
    return docs.withColumn(name, jump(F.col(key_col), shards))


def write_shards(docs: DataFrame, path: str, shards: int = 16, key_col: str = "doc_id", shard_bytes: int = 256 << 20) -> None:
    """Write whole rows to a folder ``shard=k`` each, in files of about ``shard_bytes``.

    A shard is dealt over as many tasks as its share of the input needs, by row, so that rows of one key
    are not one task.
    """
    salts = max(1, partitions(docs, shard_bytes) // shards)
    others = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]), F.lit(salts))
    rows = docs.select(*others, jump(F.col(key_col), shards).alias("shard"))
    rows.repartition(shards * salts, "shard", salt).write.partitionBy("shard").parquet(path)


def place(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id, size (UTF-8 bytes of the text and 1), text_crc32, shard, slot, and grown_shard.

    Slots number a shard's rows from 0 by id (null first), size and checksum; grown_shard is the shard
    were there one more.  A null text is an empty one; rows without an id share a shard.  Rows alike in
    all three are counted before they are numbered; each keeps a slot of its own.  An empty table gives
    no rows; other columns are not read.  Rows are numbered in ranges of the order, so a shard is many tasks.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text).cast("bigint") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = scratch.save(rows.groupBy("id", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    rows = rows.withColumn("shard", jump(F.col("id"), shards)).withColumn("grown_shard", jump(F.col("id"), shards + 1))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PIECE))))
    pieces = pieces.withColumn("n", F.least(F.lit(PIECE).cast("bigint"), F.col("n") - F.col("piece") * PIECE))
    order = ["id", "size", "text_crc32", "piece"]
    numbered = running_sum(ranged(pieces, ["shard"], order, partitions(pieces)), ["shard"], order, "upto", F.col("n"))
    slot = F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1))
    return numbered.select("id", "size", "text_crc32", "shard", slot.alias("slot"), "grown_shard")
