"""The feed as keyed state with timers: the newest change of each object, and when it is tried again.

Each object has one row of state, whatever number of changes it has had.  A change replaces the older
one and is tried after a delay that doubles with each try; after the last try the entry is given up
and its state goes.  Timers follow event time, so what comes out does not depend on how the feed was
cut into batches, nor on restarts: state and timers live in the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from concordat.sources.snapshots import Snapshots

#: Seconds before the first try, tries before an entry is given up, and how late changes may come.
DELAY_S, TRIES, LATE = 3600, 5, "10 minutes"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Retries:
    """When the tries of a change at ``at`` are due: after delay, 3 delays, 7 delays and so on."""

    delay_ms: int = DELAY_S * 1000
    tries: int = TRIES

    def due(self, at: int, tried: int) -> int:
        return at + self.delay_ms * (2 ** (tried + 1) - 1)

    def tried(self, at: int, tried: int, now: int) -> int:
        """Tries done by ``now``, given those done before."""
        while tried < self.tries and self.due(at, tried) <= now:
            tried += 1
        return tried


class _Entries(StatefulProcessor):
    """State of an object: the newest order number and payload, its time, and the tries so far."""

    def __init__(self, key: str, retries: Retries):
        self.key, self.retries = key, retries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        names = [StructField("number", LongType()), StructField("payload", StringType()), StructField("at", LongType()), StructField("tried", LongType())]
        self.entry = handle.getValueState("entry", StructType(names))

    def _settle(self, key: tuple, entry: tuple, arrived: int, now: int) -> Iterator[pd.DataFrame]:
        """Store the entry with its tries up to ``now`` and the timer of the next, or give it up."""
        number, payload, at, before = entry
        tried = self.retries.tried(at, before, now)
        if tried < self.retries.tries:
            self.entry.update((number, payload, at, tried))
            self.handle.registerTimer(self.retries.due(at, tried))
        else:
            self.entry.clear()
        if arrived or tried != before:
            state = "pending" if tried < self.retries.tries else "given up"
            yield pd.DataFrame({self.key: [key[0]], "number": [number], "payload": [payload], "tried": [tried], "state": [state], "n_events": [arrived]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        stored = self.entry.get() if self.entry.exists() else None
        best, arrived = stored and tuple(stored), 0
        for part in rows:
            arrived += len(part)
            newest = part.loc[part["number"].idxmax()]
            if best is None or int(newest["number"]) > best[0]:
                best = (int(newest["number"]), newest["payload"], int(newest["at_ms"]), 0)
        if stored is not None:
            self.handle.deleteTimer(self.retries.due(stored[2], stored[3]))
        yield from self._settle(key, best, arrived, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.entry.exists():
            yield from self._settle(key, tuple(self.entry.get()), 0, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def entries(events: DataFrame, key: str, late: str = LATE, retries: Retries = Retries()) -> DataFrame:
    """A stream of entry rows (key, number, payload, tried, state, n_events) from a stream of changes.

    ``events``: key, number (the order of changes), payload, at (timestamp).  A row comes for each key of
    a batch, n_events being the changes in it, and for each try.  Of one number the first payload counts.
    Changes that come later than ``late`` are dropped, as event time has passed them.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, number long, payload string, tried long, state string, n_events long"
    grouped = events.withWatermark("at", late).select(key, "number", "payload", "at", F.unix_millis("at").alias("at_ms")).groupBy(key)
    return grouped.transformWithStateInPandas(_Entries(key, retries), outputStructType=schema, outputMode="Update", timeMode="EventTime")


@contextmanager
def _state_store(spark: SparkSession):
    """Keyed state needs a store that holds several columns; the session's own setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def follow(events: DataFrame, inbox: Snapshots, checkpoint: str, key: str, late: str = LATE, retries: Retries = Retries()) -> None:
    """Run until nothing new is there; ``inbox`` then has one row an object: its newest entry.

    Each batch of entry rows is one commit under the batch's number, so a replayed one is applied once.
    """

    def fold(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        both = new if stored is None else stored.unionByName(new)
        last = F.max_by(F.struct("number", "payload", "tried", "state"), F.struct("number", "tried")).alias("r")
        return both.groupBy(key).agg(last, F.sum("n_events").alias("n_events")).select(key, "r.*", "n_events")

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        inbox.commit_all(batch=number, folds={"table": (batch, [key], fold)})
        batch.unpersist()

    with _state_store(events.sparkSession):
        query = entries(events, key, late, retries).writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
