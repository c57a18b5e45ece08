"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree.

The documents of a source are dealt by hash into blocks.  A source's target is met by whole passes
over its blocks and a last, partial pass: the first blocks of a permutation whole, and in the blocks
after them single documents while any fits the room that is left.  The drawn blocks
of all sources are one population: at each node of a binary tree over the output shards, a
multivariate hypergeometric draw decides how many blocks of each source go left, so that the shards
are equal in blocks and exact in sum.  A shard then takes the next disjoint run of each source's
permuted blocks and is shuffled within itself.

Only counts by source and the tree reach the driver; blocks and documents stay in Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SHARDS, SEED = 16, 11
#: Documents in a block on average, blocks of a source at most, and sources at most.
BLOCK_DOCS, MAX_BLOCKS, MAX_SOURCES = 64, 1 << 16, 100_000
#: Blocks of all sources and passes at most, so that the draws stay within 10**9; with more sources blocks are larger.
MAX_DRAWN = 1 << 28
#: Rows of the block tables up to which they are broadcast, and tasks that shuffle one shard, at least.
BROADCAST_ROWS, SUBSHARDS = 100_000, 8
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], share: float = 1.0, most: float = MAX_REPEATS) -> list[float]:
    """Words to take of each source: by weight, none above ``most`` times its size, the excess reshared."""
    out, open_, left = [0.0] * len(sizes), {k for k, s in enumerate(sizes) if s}, share * sum(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total > most * sizes[k]}
        for k in full or open_:
            out[k] = most * sizes[k] if full else left * weights[k] / total
        if not full:
            break
        left -= sum(out[k] for k in full)
        open_ -= full
    return out


def split(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """Blocks of each source for each shard, by recursive hypergeometric draws; sums are exact."""
    order = np.random.default_rng(seed)

    def down(own: np.ndarray, n: int) -> list[list[int]]:
        if n == 1:
            return [own.tolist()]
        left = n // 2
        drawn = order.multivariate_hypergeometric(own, int(own.sum()) * left // n, method="marginals")
        return down(drawn, left) + down(own - drawn, n - left)

    return down(np.asarray(quotas, np.int64), shards)


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *carry) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string"), F.lit(seed)).alias("key"),  # of one id, texts are told apart
        *carry,
    )


def _placed(measured: DataFrame, plans: DataFrame) -> DataFrame:
    """Each row with its source's plan (at most MAX_SOURCES short rows) and its block."""
    source = plans.withColumnRenamed("source", "plan_source")
    return measured.join(F.broadcast(source), measured["source"].eqNullSafe(source["plan_source"])).withColumn("block", F.pmod(F.shiftright("key", 7), F.col("blocks")).cast("int")).drop("plan_source", "blocks")


def _taken(placed: DataFrame, homes: DataFrame, cut: DataFrame) -> DataFrame:
    """Each row with ``shards``, one entry for each copy; the block tables are broadcast while small."""
    joined = placed.join(_small(homes), ["number", "block"], "left")
    joined = joined.join(_small(cut), (joined["number"] == cut["cut_number"]) & (joined["block"] == cut["cut_block"]) & (joined["key"] == cut["cut_key"]) & joined["id"].eqNullSafe(cut["cut_id"]) & (joined["size"] == cut["cut_size"]), "left")
    use = F.filter("homes", lambda h: (h["turn"] < F.col("passes")) | (F.col("part") == 2) | F.col("in_part"))
    return joined.withColumn("shards", F.when(F.col("size") > 0, F.coalesce(F.transform(use, lambda h: h["shard"]), F.array().cast("array<int>"))).otherwise(F.array().cast("array<int>")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _filled(rows: pa.Table) -> pa.Table:
    """The rows of one source that fill its room: by order while they fit, then the smallest if nearer than none."""
    room, own = rows["room"][0].as_py(), rows["own"].to_pylist()
    columns = [rows[c].to_pylist() for c in ("first", "class", "extra", "place", "block", "key", "size")]
    names = [(i is None, str(i)) for i in rows["id"].to_pylist()]
    order = [(0, 0, 0, key, name, size, k) if first else (1, -level, extra, place, block, key, name, size, k) for k, (first, level, extra, place, block, key, size, name) in enumerate(zip(*columns, names, strict=True))]
    taken, least = [], None
    for one in sorted(order):
        k = one[-1]
        if own[k] <= room:
            taken.append(k)
            room -= own[k]
        elif least is None or own[k] < own[least]:
            least = k
    if least is not None and own[least] - room < room:
        taken.append(least)
    return rows.take(taken).select(["number", "block", "id", "key", "size"])


def _cut(placed: DataFrame, blocks: DataFrame, scratch: Scratch, seed: int) -> DataFrame:
    """(number, block, id, key, size) of the documents that fill the room left by the whole blocks.

    The first block in part goes document by document.  The room then left is carried on over all blocks
    after it, by classes of size (powers of two) from the largest down.  In a class, documents are taken in
    permuted order until one does not fit, so that less than the class's upper end is left: blocks up to
    the sum that can still be taken are enough, with the two smallest documents of the others.  In the end
    no document fits any more, and the smallest left out is taken if that is nearer than none.
    """
    rooms = blocks.where("part = 1").select("number", "room")
    later = blocks.where("part < 2").select("number", "block", (F.col("part") == 1).alias("first")).join(rooms, "number")
    one = ["number", "block", "id", "key", "size"]
    rest = (
        placed.join(_small(scratch.save(later, "later")), ["number", "block"]).where("size > 0 and size < 2 * room")
        .groupBy(*one, "room", "first").agg(F.sum("size").alias("own"))  # rows of one id and text are taken alike
        .where("own < 2 * room").withColumn("class", F.length(F.bin("own")) - 1).withColumn("place", F.xxhash64("number", "block", F.lit(seed)))
    )
    rest = scratch.save(rest, "rest")

    sums = scratch.save(rest.where("not first").groupBy("number", "class", "block", "place", "room").agg(F.sum("own").alias("words")), "sums")
    above = Window.partitionBy("number").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)  # 64 classes at most
    most = (
        sums.groupBy("number", "class", "room").agg(F.sum("words").alias("words")).where("pow(2, class) <= room")
        .select("number", "class", F.least("room", F.min(F.when(F.col("words") > F.col("room"), F.pow(F.lit(2.0), F.col("class") + 1))).over(above)).alias("most"))
    )
    in_class = Window.partitionBy("number", "class").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, -1)  # MAX_BLOCKS at most
    chosen = sums.withColumn("before", F.coalesce(F.sum("words").over(in_class), F.lit(0))).join(most, ["number", "class"]).where("before < most").select("number", "class", "block", F.lit(True).alias("chosen"))
    marked = rest.join(_small(scratch.save(chosen, "chosen")), ["number", "class", "block"], "left").withColumn("extra", ~F.col("first") & F.col("chosen").isNull())
    by_size = ["own", "key", "id", "size", "block"]
    others = marked.where("extra")
    for group in (["number", "class", "block"], ["number", "class"]):
        others = others.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*by_size))).where("nth <= 2").drop("nth")
    own = [*one, "own", "room", "first", "class", "place", "extra"]
    offered = marked.where("not extra").select(*own).unionByName(others.select(*own))
    return offered.groupBy("number").applyInArrow(_filled, rest.select(*one).schema)


_PLANS = pa.schema([
    ("number", pa.int32()), ("source", pa.string()), ("source_size", pa.int64()), ("target", pa.float64()),
    ("passes", pa.int32()), ("rest", pa.float64()), ("blocks", pa.int32()),
])
_ENDS = pa.schema([("number", pa.int32()), ("bases", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])


def _rows(spark: SparkSession, rows: list[tuple], schema: pa.Schema) -> DataFrame:
    """A few rows of the driver.  As an Arrow table they need no Python worker; as a list they would start some more."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema))


def _plan(sizes: DataFrame, scratch: Scratch, weights: tuple[float, ...], share: float, shards: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plans by source, homes of the drawn blocks, and the documents taken of partial blocks."""
    spark = sizes.sparkSession
    found = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    wanted = targets([r["size"] for r in found], [weights[k % len(weights)] for k in range(len(found))], share)
    plan = []
    for number, (row, target) in enumerate(zip(found, wanted, strict=True)):
        passes = min(MAX_REPEATS, int(target // row["size"])) if row["size"] else 0
        blocks = min(MAX_BLOCKS, max(1, MAX_DRAWN // ((MAX_REPEATS + 1) * len(found))), max(1, -(-row["docs"] // BLOCK_DOCS)))
        plan.append((number, row["source"], int(row["size"]), float(target), passes, float(target - passes * row["size"]), blocks))
    plans = _rows(spark, plan, _PLANS)
    placed = _placed(sizes, plans)

    # The last pass: whole blocks in permuted order, then documents.  A source has MAX_BLOCKS rows at most.
    by_source = Window.partitionBy("number").orderBy(F.xxhash64("number", "block", F.lit(seed)), "block")
    blocks = placed.groupBy("number", "block", "passes", "rest").agg(F.sum("size").alias("words"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("words").over(by_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    blocks = scratch.save(
        blocks.withColumn("room", F.col("rest") - F.col("before")).withColumn("part", F.when(F.col("room") >= F.col("words"), 2).when(F.col("room") > 0, 1).otherwise(0)),
        "blocks",
    )
    cut = scratch.save(_cut(placed, blocks, scratch, seed), "cut")
    partial = cut.select("number", "block", F.lit(1).alias("in_part")).distinct()
    blocks = scratch.save(
        blocks.join(_small(partial), ["number", "block"], "left").withColumn("part", F.when(F.col("part") == 2, 2).otherwise(F.coalesce("in_part", F.lit(0)))).drop("in_part"),
        "drawn",
    )

    # Every drawn block (turn, block), numbered in its source's permuted order, falls to a shard.
    drawn = blocks.select("number", "block", "passes", "part", F.explode(F.sequence(F.lit(0), F.col("passes"))).alias("turn")).where("turn < passes or part > 0")
    turns = drawn.groupBy("number", "turn").agg(F.count("*").alias("n")).collect()  # four short rows a source at most
    quotas: dict[int, list[int]] = {}
    for r in sorted(turns, key=lambda r: (r["number"], r["turn"])):
        quotas.setdefault(r["number"], []).append(r["n"])
    numbers = sorted(quotas)
    cuts = np.cumsum(np.array(split([sum(quotas[n]) for n in numbers], shards, seed)).reshape(shards, len(numbers)), axis=0)
    ends = _rows(spark, [(n, [0, *np.cumsum(quotas[n]).tolist()], cuts[:, k].tolist()) for k, n in enumerate(numbers)], _ENDS)
    permuted = Window.partitionBy("number", "turn").orderBy(F.xxhash64("number", "block", F.lit(seed) + F.col("turn")), "block")
    homes = (
        drawn.withColumn("rank", F.row_number().over(permuted) - 1)
        .join(F.broadcast(ends), "number")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.get("bases", F.col("turn")) + F.col("rank"))))
        .groupBy("number", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "shard"))).alias("homes"))  # one to four turns
    )

    cut = cut.select(*(F.col(c).alias(f"cut_{c}") for c in cut.columns), F.lit(True).alias("in_part"))
    return plans, scratch.save(homes, "homes"), cut


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """For every row: id, source, size, source_size, target, taken, and the shards its copies go to.

    Sources in ascending code points, null last, take ``weights`` in turn.  A source's taken words
    miss its target by half the smallest unit that its last pass leaves out, at most.  A unit is a document;
    only rows that have both id and text in common are one unit, taken alike.  Rows without an id, or of one
    id, with texts of their own are units of their own.  A null or empty text has size 0 and takes nothing;
    an empty table gives no rows.
    Columns other than the three named are not read.  A rerun gives the same result.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = scratch.save(_measured(docs, id_col, text_col, source_col, seed), "sizes")
    plans, homes, cut = _plan(sizes, scratch, weights, share, shards, seed)
    return _taken(_placed(sizes, plans), homes, cut).select("id", "source", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that the mix takes, one for each copy, by shard and shuffled within it.

    Whether a row is taken depends on the row and the plan only, so texts move once, to their shard.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    measured = _measured(docs, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("row"))
    sizes = scratch.save(measured.drop("row"), "sizes")
    plans, homes, cut = _plan(sizes, scratch, weights, share, shards, seed)
    copies = _taken(_placed(measured, plans), homes, cut).select("row", "key", F.posexplode("shards").alias("copy", "shard"))
    parts = partitions(docs)
    dealt = copies.repartition(max(shards, parts), "shard", F.pmod("key", F.lit(max(SUBSHARDS, -(-parts // shards)))))
    return dealt.sortWithinPartitions("shard", F.xxhash64("key", "copy", F.lit(seed))).select("row.*")
