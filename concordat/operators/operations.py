"""Durable intents: the active operation of an item, state folds, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pacing import numbered

# Fixed values.
TYPES = ("createDirectory", "uploadMultipart", "uploadResumable", "trashRemote", "deleteLocal")
STATES = ("ready", "inFlight", "verify", "unknownOutcome", "completed", "failed")
ACTIVE = ("ready", "inFlight", "verify", "unknownOutcome")


def latest_active(operations: DataFrame, item: str = "item_id", created: str = "created_at", ident: str = "operation_id") -> DataFrame:
    """The newest active operation of each item; ties by id.  ``max_by`` combines on the map side."""
    rest = [c for c in operations.columns if c != item]
    return operations.where(F.col("state").isin(*ACTIVE)).groupBy(item).agg(F.max_by(F.struct(*rest), F.struct(created, ident)).alias("o")).select(item, "o.*")


def with_latest(items: DataFrame, operations: DataFrame, item: str = "item_id") -> DataFrame:
    return items.join(latest_active(operations, item), item, "left")


def chosen_items(items: DataFrame, ids: DataFrame, column: str, key: str) -> DataFrame:
    """Items named in a JSON array of ids, which a request carries."""
    wanted = ids.select(F.explode(F.from_json(column, "array<bigint>")).alias(key)).distinct()
    return items.join(wanted, key, "left_semi")


def fold_states(log: DataFrame, ident: str, order: str) -> DataFrame:
    """The state each operation ends in: completed or failed once reached stays, else the last one.

    ``log``: ident, order, state.  A later unknownOutcome does not undo a completion.
    """
    final = F.min(F.when(F.col("state").isin("completed", "failed"), F.struct(order, "state")))
    last = F.max(F.struct(order, "state"))
    return log.groupBy(ident).agg(F.coalesce(final, last).alias("s"), F.count("*").alias("steps")).select(ident, F.col("s.state").alias("state"), "steps")


def reuse_or_create(wanted: DataFrame, operations: DataFrame, item: str, new_id: Column) -> DataFrame:
    """(item, operation_id, reused): the active operation of the item, else a new one under a derived id."""
    active = latest_active(operations, item).select(item, F.col("operation_id").alias("active_id"))
    return wanted.join(active, item, "left").select(item, F.coalesce("active_id", new_id).alias("operation_id"), F.col("active_id").isNotNull().alias("reused"))


def cleanup_conflicts(wanted: DataFrame, operations: DataFrame, item: str) -> DataFrame:
    """Wanted cleanups whose item has an active one with another payload."""
    active = latest_active(operations.where(F.col("operation_type").isin("trashRemote", "deleteLocal")), item).select(item, F.col("payload").alias("active_payload"))
    return wanted.join(active, item).where(~F.col("payload").eqNullSafe(F.col("active_payload")))


def to_replay(operations: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Active operations with turn: the order in which they are taken up again, the oldest first."""
    return numbered(operations.where(F.col("state").isin(*ACTIVE) & F.col("operation_type").isin(*types)), ["created_at", "operation_id"], 1, ident="turn")


def staged_items(items: DataFrame, staged: DataFrame, key: str) -> DataFrame:
    """Items of a staged table of ids, in which an id may stand several times."""
    return items.join(staged.select(key).distinct(), key, "left_semi")
