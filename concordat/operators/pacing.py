"""Request pacing, samplers and identifier batches."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concordat.sources.workspace import Workspace, partitions

from .metrics import RATE_LIMIT, RATE_WINDOW_US

# Fixed values.
ID_BATCH, LOW_WATER = 1000, 200
SAMPLE_US = 500_000
WRITER_CAPACITY, WRITER_TIMEOUT_US = 256, 5_000


def _permit(limit: int, width_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, recent = None, deque(maxlen=limit)
        for batch in batches:
            starts = []
            for own, at in zip(batch.column("gate").to_pylist(), batch.column("at_us").to_pylist(), strict=True):
                if own != gate:
                    gate, recent = own, deque(maxlen=limit)
                start = at
                if recent:
                    start = max(start, recent[-1] + 1_000_000 // limit)
                if len(recent) == limit:
                    start = max(start, recent[0] + width_us)
                recent.append(start)
                starts.append(start)
            yield pa.RecordBatch.from_pydict({"gate": batch.column("gate"), "request": batch.column("request"), "at_us": batch.column("at_us"), "start_us": pa.array(starts, pa.int64())})

    return run


def permits(requests: DataFrame, limit: int = RATE_LIMIT, width_us: int = RATE_WINDOW_US) -> DataFrame:
    """When each request (gate, request, at_us) may start: paced, and ``limit`` in the rolling window.

    A start depends on the starts before it, which no window function expresses.  Rows stream
    through sorted partitions, and a task remembers ``limit`` starts, however many requests a gate has.
    """
    dealt = requests.select(F.col("gate").cast("long"), F.col("request").cast("long"), F.col("at_us").cast("long")).repartition("gate").sortWithinPartitions("gate", "at_us", "request")
    return dealt.mapInArrow(_permit(limit, width_us), "gate long, request long, at_us long, start_us long")


def sampled(samples: DataFrame, by: list[str], at_us: str, order: list[str], every_us: int = SAMPLE_US) -> DataFrame:
    """The last sample of each interval, one map-side combined row for each."""
    rest = [c for c in samples.columns if c not in by]
    interval = F.floor(F.col(at_us) / every_us).alias("interval")
    return samples.groupBy(*by, interval).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*by, "interval", "s.*")


def refills(need: Column, held: Column) -> Column:
    """Batches of identifiers to fetch so that ``need`` of them are held."""
    return F.ceil(F.greatest(need - held, F.lit(0)) / ID_BATCH).cast("bigint")


def prefetches(held: Column) -> Column:
    """Whether so few identifiers are left that the next batch is fetched ahead."""
    return held < LOW_WATER


def numbered(rows: DataFrame, order: list[str], first: int, groups: int | None = None, ident: str = "id") -> DataFrame:
    """Add ``ident``: consecutive numbers from ``first`` in ``order``, without one task that holds all rows.

    Rows are written, range partitioned (into more ranges for more rows) and written again, so that
    counts and numbers come from the same ranges; the sizes of the ranges are summed up, and each range
    numbers its own rows.
    """
    work = Workspace(rows.sparkSession, "numbered")
    if groups is None:
        rows = work.save(rows, "rows")  # sampled for the ranges and read again; its size is known
        groups = partitions(rows)
    ranged = work.save(rows.repartitionByRange(groups, *order).withColumn("_range", F.spark_partition_id()), "ranged")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    placed = ranged.withColumn("_own", own).join(F.broadcast(before), "_range")
    return placed.withColumn(ident, (F.col("_before") + F.col("_own") + (first - 1)).cast("bigint")).drop("_range", "_own", "_before")


def _flush(capacity: int, timeout_us: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, number, held, since = None, 0, 0, 0
        for batch in batches:
            flushes, reasons = [], []
            for own, at, now in zip(*(batch.column(c).to_pylist() for c in ("writer", "at_us", "immediate")), strict=True):
                if own != writer:
                    writer, number, held = own, 0, 0
                if held and at - since >= timeout_us:  # what waits is written before the next arrives
                    number, held = number + 1, 0
                since = since if held else at
                held += 1
                flushes.append(number)
                reasons.append("immediate" if now else "capacity" if held >= capacity else None)
                if reasons[-1]:
                    number, held = number + 1, 0
            yield pa.RecordBatch.from_pydict({"writer": batch.column("writer"), "write": batch.column("write"), "at_us": batch.column("at_us"), "flush": pa.array(flushes, pa.int64()), "closed_by": pa.array(reasons, pa.string())})

    return run


def flushes(writes: DataFrame, capacity: int = WRITER_CAPACITY, timeout_us: int = WRITER_TIMEOUT_US) -> DataFrame:
    """(writer, write, at_us, flush, closed_by): which group commit takes each write.

    A commit is closed by the write that fills it (capacity), by one that must not wait (immediate), or
    when its first write has waited for ``timeout_us``; then closed_by is null in all its rows.  Writes
    stream through sorted partitions; a task remembers one open commit.
    """
    dealt = writes.select(F.col("writer").cast("long"), F.col("write").cast("long"), F.col("at_us").cast("long"), F.coalesce("immediate", F.lit(False)).alias("immediate"))
    dealt = dealt.repartition("writer").sortWithinPartitions("writer", "at_us", "write")
    return dealt.mapInArrow(_flush(capacity, timeout_us), "writer long, write long, at_us long, flush long, closed_by string")
