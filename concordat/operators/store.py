"""Mutations as new snapshots: upserts, compare-and-swap receipts, isolation of bad writes, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tree import subtree


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], bump: str | None = None, keep_first: tuple[str, ...] = (), keep_known: tuple[str, ...] = (), guard: Column | None = None) -> DataFrame:
    """``current`` after ``incoming`` (one row a key): inserted or updated rows, with column effect.

    ``bump`` grows by one on update and is one on insert; ``keep_first`` columns keep an existing
    value, ``keep_known`` ones keep it where the new one is null; ``guard`` (over current and new_* columns) must hold for an update, else the row stays and
    effect is ``refused``.
    """
    cols = [c for c in current.columns if c not in key and c != bump]
    new = incoming.select(*key, *[F.col(c).alias(f"new_{c}") for c in cols if c in incoming.columns], F.lit(True).alias("_new"))
    joined = current.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    ok = F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))
    write = F.col("_new").isNotNull() & (F.col("_old").isNull() | ok)

    def value(c: str) -> Column:
        if c not in incoming.columns:
            return F.col(c)
        order = (c, f"new_{c}") if c in keep_first else (f"new_{c}", c)
        fresh = F.coalesce(*order) if c in keep_first or c in keep_known else F.col(f"new_{c}")
        return F.when(write, fresh).otherwise(F.col(c)).alias(c)

    bumped = [(F.coalesce(F.col(bump), F.lit(0)) + write.cast("int")).cast("bigint").alias(bump)] if bump else []
    effect = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(write, "updated").otherwise("refused")
    return joined.select(*key, *[value(c) for c in cols], *bumped, effect.alias("effect"))


def insert_missing(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """``current`` and the rows of ``incoming`` whose key is new; of equal new keys one stays."""
    return current.unionByName(incoming.join(current.select(*key), key, "left_anti").dropDuplicates(key).select(current.columns))


def insert_selected(current: DataFrame, rows: DataFrame, must_exist: DataFrame, must_not: DataFrame, key: list[str]) -> DataFrame:
    """Insert ``rows`` whose key is in ``must_exist`` and not in ``must_not``."""
    return current.unionByName(rows.join(must_exist.select(*key), key, "left_semi").join(must_not.select(*key), key, "left_anti").select(current.columns))


def compare_and_swap(current: DataFrame, receipts: DataFrame, key: str, expected: list[str], sets: list[str]) -> DataFrame:
    """``current`` after receipts that apply only if every expected_* equals (null-safe) what is stored.

    Receipts: key, expected_<e> for each of ``expected``, new_<s> for each of ``sets``.  Column outcome
    is ``applied``, ``stale`` or null (no receipt).
    """
    has = F.col("_receipt").isNotNull()
    match = reduce(lambda a, b: a & b, [F.col(e).eqNullSafe(F.col(f"expected_{e}")) for e in expected])
    joined = current.join(receipts.withColumn("_receipt", F.lit(True)), key, "left")
    apply = has & match
    cols = [F.when(apply, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in sets else F.col(c) for c in current.columns]
    return joined.select(*cols, F.when(apply, "applied").when(has, "stale").alias("outcome"))


def isolate(rows: DataFrame, problem: Column, unique: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): a bad row, or a later one of the same unique key, is rejected alone.

    The first of each key is found by a grouped minimum, which combines on the map side.
    """
    marked = rows.withColumn("problem", problem)
    first = marked.where("problem is null").groupBy(*unique).agg(F.min(order).alias("_first"))
    joined = marked.join(first, unique, "left")
    why = F.when(F.col("problem").isNotNull(), F.col("problem")).when(F.col(order) > F.col("_first"), "duplicate")
    out = joined.withColumn("problem", why).drop("_first")
    return out.where("problem is null").drop("problem"), out.where("problem is not null")


def cascade_delete(nodes: DataFrame, doomed: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """``nodes`` and dependent tables without the doomed subtrees; {name: what is left}."""
    gone = subtree(nodes, doomed).select("id")
    left = {"nodes": nodes.join(gone, "id", "left_anti")}
    return left | {name: df.join(gone.withColumnRenamed("id", column), column, "left_anti") for name, (df, column) in children.items()}


def violations(df: DataFrame, rules: dict[str, Column], ident: str) -> DataFrame:
    """(rule, id) for every row that breaks a rule; a null condition breaks none, as in a CHECK."""
    broken = [F.when(~ok, F.lit(name)) for name, ok in rules.items()]
    return df.select(F.col(ident).alias("id"), F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("rule"))


def key_violations(df: DataFrame, key: list[str], name: str) -> DataFrame:
    """(rule, n) for keys that stand more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(name).alias("rule"), *key, "n")
