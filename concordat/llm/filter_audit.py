"""Filter interaction audit: what each of five filters removes in every order of the five.

Native expressions give each row a mask of the filters it fails; identical texts meet in one
``groupBy`` that yields their smallest id.  Rows are counted by part and mask, so a part is a
histogram of at most 32 cells, and the figures of all orders are sums over those cells.  What is
shuffled is a row's id, part, mask and the SHA-256 of its text, never the text.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# The five filters and what they measure.
FILTERS = "ABCDE"
SPACE = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#$%&*|]"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITALS_PERCENT = 200, 50, 2

_BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}
_ORDERS = ["".join(order) for order in permutations(FILTERS)]


def text_mask(text: Column) -> Column:
    """The bits of filters A to D that a text fails; a null text is an empty one."""
    text = F.coalesce(text, F.lit(""))
    inner = F.btrim(text, F.lit(SPACE))
    words = F.split(inner, SPLIT, -1)
    n = F.when(inner == "", 0).otherwise(F.size(words)).cast("bigint")
    distinct = F.when(inner == "", 0).otherwise(F.size(F.array_distinct(words))).cast("bigint")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("bigint")
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals > MAX_CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(failed, _BIT[letter]).otherwise(0) for letter, failed in fails.items()), F.lit(0))


def cells(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic",
) -> DataFrame:
    """Rows by part and failure mask (bit 0 is filter A): n, and those labelled good and toxic.

    A row fails E if a row with a smaller id, in any part, has the same text.  A null id is not
    smaller than any, nor has it smaller ones or a label.  A null part is the part ''.  Repeated rows
    count each; a label counts if any row of the id has it.

    Rows alike are combined before they meet, and rows meet by id and text, or by id with at most 32
    rows a part: no id, text or part gathers its rows in one task.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    text, row_id = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col)
    rows = docs.select(
        row_id.alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.when(row_id.isNotNull(), F.unhex(F.sha2(text, 256))).alias("digest"),
        text_mask(text).alias("mask"),
    )
    rows = scratch.save(rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n")), "rows")
    first = rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), _BIT["E"]).otherwise(0)
    masked = rows.join(first, ["id", "digest"], "left").groupBy("id", "part", (F.col("mask") + copy).alias("mask")).agg(F.sum("n").alias("n"))

    def any_of(column: str) -> Column:
        return F.max(F.when(F.col(column) == 1, 1).otherwise(0))

    kind = docs.schema[id_col].dataType
    known = labels.select(labels[id_col].cast(kind).alias("id"), good_col, toxic_col).groupBy("id").agg(any_of(good_col).alias("good"), any_of(toxic_col).alias("toxic"))
    labelled = [F.coalesce(F.sum(F.col("n") * F.col(c)), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return masked.join(known, "id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), *labelled)


def audit(found: DataFrame) -> DataFrame:
    """For every part, order of the filters and step, the figures of that step, from the table of :func:`cells`.

    Columns: part, filter_order, step (from 1), and counts: kept after the step, removed in it, redundant
    (failing its filter, but removed earlier), unique_fails (failing its filter only), good_lost and
    toxic_lost (of the removed), shapley (what the filter removes, summed over all orders: a row failing
    k filters falls to each of them in 1/k of the orders).  No rows give no parts.
    """
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = by_part.withColumn("filter_order", F.explode(F.split(F.lit(",".join(_ORDERS)), ",")))
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))

    def bits(letters: Column) -> Column:
        return sum((F.when(letters.contains(letter), bit).otherwise(0) for letter, bit in _BIT.items()), F.lit(0))

    own, before = F.col("own"), F.col("before")
    steps = steps.withColumn("own", bits(F.col("filter_order").substr(F.col("step"), F.lit(1)))).withColumn("before", bits(F.col("filter_order").substr(F.lit(1), F.col("step") - 1)))

    def total(which, value=lambda cell: cell["n"]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, cell: acc + F.when(which(cell["mask"]), value(cell)).otherwise(0))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(own) != 0

    def gone(mask: Column) -> Column:
        return mask.bitwiseAND(before) != 0

    def removed(mask: Column) -> Column:
        return fails(mask) & ~gone(mask)

    n_orders = len(_ORDERS)
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~gone(m)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: fails(m) & gone(m)).alias("redundant"),
        total(lambda m: m == own).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(fails, lambda c: c["n"] * (F.lit(n_orders) / F.bit_count(c["mask"])).cast("bigint")).alias("shapley"),
    )
