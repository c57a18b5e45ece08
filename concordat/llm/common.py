"""What the operators share: reading tables, written intermediate results, Arrow output."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from concordat.sources.ship import ship
from concordat.sources.workspace import Workspace


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(df: DataFrame, size: int = 16 << 20) -> int:
    """Partitions for an exchange of about as many bytes as ``df`` has: as set, more for a large input.

    Spark's estimate of the input is a file size; where it has none, the setting holds.
    """
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(own, held // size) if held < 1 << 60 else own


class Scratch(Workspace):
    """Intermediate tables in the folder of ``spark.checkpoint.dir``, which all executors share.

    A table written here cuts the lineage: losing an executor repeats tasks of the current step only.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        super().__init__(spark, name)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads, so that disk use is that of the widest step."""
        for name in names:
            super().drop(name)


_kept: dict[str, dict] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def kept(owner: str) -> dict:
    """What tasks of one operator keep in their Python worker; what another operator kept there goes."""
    if owner not in _kept:
        _kept.clear()
    return _kept.setdefault(owner, {})


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and what the allocator holds for later."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def in_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, owner: str = "") -> DataFrame:
    """``df.mapInArrow(function, schema)`` for workers that live on after their task, for those of later stages too.

    A task drops what operators other than ``owner`` kept, and ends by giving back what it freed.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept(owner)
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def arrow_map(df: DataFrame, function: Callable[..., dict], schema: str, *args) -> DataFrame:
    """``function(batch, *args)`` for every Arrow batch of ``df``; it returns a dict of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(batch, *args))

    return in_arrow(df, run, schema)
