"""The change feed as a stream: each micro-batch is folded into a versioned inbox.

Offsets and the batch number live in the checkpoint; the inbox is committed under the batch number,
so a batch that is replayed after a failure is applied once.  The inbox is kept in buckets by key, and
a batch rewrites only those it touches.  Event time does not matter here: late changes are told by
their versions, not by watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.operators.feed import invalidate, latest, pending_count
from concordat.sources.snapshots import Snapshots


def folding(key: list[str], order: list[str]) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A fold of new events into stored ones: the newest event of each key, and how many there were."""

    def fold(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if stored is None:
            return new
        both = stored.unionByName(new)
        rest = [c for c in new.columns if c not in key and c != "n_events"]
        folded = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"), F.sum("n_events").alias("n_events"))
        return folded.select(*key, "_r.*", "n_events").select(stored.columns)

    return fold


def fold_into(inbox: Snapshots, key: list[str], order: list[str]):
    """A foreachBatch function: the newest event of each key, over all batches so far."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        inbox.commit_all(batch=number, folds={"table": (latest(batch, key, order), key, folding(key, order))})
        batch.unpersist()

    return run


def consume_page(state: Snapshots, changes: DataFrame, key: str, order: list[str], number: int, token: str, expected: str | None = None) -> int:
    """One page of changes in one commit: the inbox, the items it makes unknown, and the next cursor.

    ``state`` has tables ``inbox`` and ``items``, both kept by ``key``: a page rewrites only the buckets
    of the objects it tells of.  A page that started from another cursor than the stored one raises
    StaleCursor and changes nothing.
    """
    new = latest(changes, [key], order)
    folds = {"inbox": (new, [key], folding([key], order))}
    if "items" in state.head()["tables"]:
        folds["items"] = (changes.select(key).distinct(), [key], lambda items, changed: invalidate(items, changed, key))
    return state.commit_all(batch=number, folds=folds, cursor=token, expected=expected)


def replay(events: DataFrame, inbox: Snapshots, checkpoint: str, key: list[str], order: list[str], every: str | None = None) -> None:
    """Run the stream until nothing new is there; with ``every`` (an interval) it goes on until it is stopped."""
    writer = events.writeStream.foreachBatch(fold_into(inbox, key, order)).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def rebuild(listing: DataFrame, inbox: Snapshots, order: dict) -> int:
    """After a rejected cursor: the full listing becomes the inbox; the stream goes on from a token taken before it."""
    return inbox.commit(listing.withColumns({c: F.lit(v) for c, v in order.items()}).withColumn("n_events", F.lit(1).cast("bigint")))


def recover(state: Snapshots, wave: Callable[[], bool], apply: Callable[[], None], counts: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]], start_token: Callable[[], str]) -> int:
    """Bring a root without a valid cursor up to date; gives the waves it took.

    The cursor is taken before anything is listed, so no change is missed.  Then waves of listing pages
    (``wave``: whether there were any) and the application of what they found (``apply``) take turns
    until a wave has nothing to list; what is then still pending (``counts``: inbox, listings, unknown
    items, excluded ones) is an error.
    """
    if state.cursor() is None:
        state.commit_all(cursor=start_token())
    apply()
    waves = 0
    while wave():
        waves += 1
        apply()
    apply()
    left = pending_count(*counts()).first()["pending"]
    if left:
        raise RuntimeError(f"{left} remote observations are still pending")
    return waves
