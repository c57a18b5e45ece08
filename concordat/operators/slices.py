"""Ordered computations by key in two levels, so that a key with very many rows is not one task.

Rows are dealt by ranges of key and order and written once.  Within a range a window works as usual;
what goes before a range of the same key is carried in from a summary of a row for each key and range.
Rows of one key that are equal in all of ``order`` stay in one range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.sources.workspace import Workspace, partitions

RANGE = "_range"


def ranged(rows: DataFrame, by: list[str], order: list[str], groups: int | None = None) -> DataFrame:
    """``rows`` with the number of their range: as many ranges as the rows' size needs, unless told otherwise.

    Rows are written before, as they are sampled for the ranges and then dealt; their size is then known.
    """
    work = Workspace(rows.sparkSession, "ranged")
    if groups is None:
        rows = work.save(rows, "given")
        groups = partitions(rows)
    return work.save(rows.repartitionByRange(groups, *by, *order).withColumn(RANGE, F.spark_partition_id()), "rows")


def _within(by: list[str], order: list[str]):
    return Window.partitionBy(*by, RANGE).orderBy(*order)


def _carried(rows: DataFrame, by: list[str], summary: DataFrame) -> DataFrame:
    """Rows with column _carried of their key and range; a null key is a key."""
    keys = [*by, RANGE]
    side = summary.select(*[F.col(k).alias(f"_c_{k}") for k in keys], "_carried")
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_c_{k}")) for k in keys])
    return rows.join(side, match).drop(*[f"_c_{k}" for k in keys])


def previous(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Add ``name``: ``value`` in the row before; null in the first row of a key."""
    given = rows.withColumn("_value", value)
    last = given.groupBy(*by, RANGE).agg(F.max_by(F.struct("_value"), F.struct(*order)).alias("_last"))
    before = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy(*by).orderBy(RANGE)))
    w = _within(by, order)
    met = _carried(given, by, before).withColumn("_first", F.row_number().over(w) == 1).withColumn(name, F.lag("_value").over(w))
    return met.withColumn(name, F.when(F.col("_first"), F.col("_carried._value")).otherwise(F.col(name))).drop("_value", "_carried", "_first")


def running_sum(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column) -> DataFrame:
    """Add ``name``: the sum of ``value`` up to and with each row."""
    given = rows.withColumn("_value", value)
    sums = given.groupBy(*by, RANGE).agg(F.sum("_value").alias("_sum"))
    before = sums.withColumn("_carried", F.sum("_sum").over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)))
    own = F.sum("_value").over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(given, by, before).withColumn(name, F.coalesce("_carried", F.lit(0)) + own).drop("_value", "_carried")


def running_max(rows: DataFrame, by: list[str], order: list[str], name: str, value: Column, itself: bool = True) -> DataFrame:
    """Add ``name``: the greatest ``value`` up to each row, with the row ``itself`` or before it; nulls do not count."""
    given = rows.withColumn("_value", value)
    most = given.groupBy(*by, RANGE).agg(F.max("_value").alias("_most"))
    before = most.withColumn("_carried", F.max("_most").over(Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)))
    own = F.max("_value").over(_within(by, order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1))
    return _carried(given, by, before).withColumn(name, F.greatest("_carried", own)).drop("_value", "_carried")
