"""Rates, progress, cooldowns and run statistics over ordered samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import slices

# Fixed values.
RATE_WINDOW_US, RATE_LIMIT = 1_010_000, 65
MIN_SAMPLE_S = 0.1
COOLDOWN = (1.0, 3600.0)
COOLDOWN_UNKNOWN = 1.5
ALONE_FIRST, CHUNK = 1, 64
#: Samples of a key up to which a window over the key is one task's work; beyond it ranges are used.
HOT = 1 << 20


def _hot(samples: DataFrame, by: list[str], most: int) -> bool:
    """Whether a key has more samples than one task should hold; counted on the map side."""
    return not samples.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > most).limit(1).isEmpty()


def in_window(samples: DataFrame, by: list[str], at_us: str, width_us: int = RATE_WINDOW_US, most: int = HOT) -> DataFrame:
    """Add in_window: starts within the last ``width_us`` up to each sample, itself and those of its time included.

    A start counts from its time until ``width_us`` after it, so the number is a running sum of what comes
    and what goes, which :mod:`slices` takes over ranges: a key with more than ``most`` samples is many tasks.
    """
    if not _hot(samples, by, most):
        return samples.withColumn("in_window", F.count("*").over(Window.partitionBy(*by).orderBy(at_us).rangeBetween(-width_us, 0)))
    counted = samples.groupBy(*by, F.col(at_us).alias("_time")).agg(F.count("*").alias("_n"))
    comes = counted.select(*by, "_time", F.lit(0).alias("_turn"), "_n")
    goes = counted.select(*by, (F.col("_time") + width_us).alias("_time"), F.lit(2).alias("_turn"), (-F.col("_n")).alias("_n"))
    own = samples.select(*by, F.col(at_us).alias("_time"), F.lit(1).alias("_turn"), F.lit(0).cast("bigint").alias("_n"), F.struct(*samples.columns).alias("_row"))
    order = ["_time", "_turn"]
    met = slices.running_sum(slices.ranged(comes.unionByName(goes).unionByName(own, allowMissingColumns=True), by, order), by, order, "in_window", F.col("_n"))
    return met.where("_turn = 1").select("_row.*", "in_window")


def next_start(samples: DataFrame, by: list[str], at_us: str, order: list[str], limit: int = RATE_LIMIT, width_us: int = RATE_WINDOW_US, most: int = HOT) -> DataFrame:
    """Add next_us: the earliest start that the pace and the window permit after each start.

    With more than ``most`` samples of a key, the start ``limit`` places before is met by its number within
    the key, not by a window over the key.
    """
    paced = F.col(at_us) + F.lit(1_000_000 // limit)
    start = F.greatest(paced, F.coalesce(F.col("_oldest") + F.lit(width_us), paced))
    if not _hot(samples, by, most):
        before = F.lag(at_us, limit - 1).over(Window.partitionBy(*by).orderBy(*order))
        return samples.withColumn("_oldest", before).withColumn("next_us", start).drop("_oldest")
    numbered = slices.running_sum(slices.ranged(samples, by, order), by, order, "_number", F.lit(1)).drop(slices.RANGE)
    before = numbered.select(*[F.col(k).alias(f"_k_{k}") for k in by], (F.col("_number") + limit - 1).alias("_later"), F.col(at_us).alias("_oldest"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by], F.col("_number") == F.col("_later"))
    met = numbered.join(before, same, "left").drop(*[f"_k_{k}" for k in by], "_later", "_number")
    return met.withColumn("next_us", start).drop("_oldest")


def sampled_rate(samples: DataFrame, by: list[str], at_us: str, total: str, order: list[str]) -> DataFrame:
    """Add rate (units a second) against the sample before: null for the first or too short an interval."""
    met = slices.previous(slices.ranged(samples, by, order), by, order, "_before", F.struct(F.col(at_us).alias("at"), F.col(total).alias("total")))
    seconds = (F.col(at_us) - F.col("_before.at")) / 1e6
    moved = F.col(total) - F.col("_before.total")
    return met.withColumn("rate", F.when(seconds >= MIN_SAMPLE_S, F.greatest(moved / seconds, F.lit(0.0)))).drop("_before", slices.RANGE)


def fraction(done: Column, total: Column) -> Column:
    """Progress from 0 to 1; nothing to do is 0."""
    return F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), done / total))).otherwise(0.0)


def distinct_until_changed(samples: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The samples whose values differ (null-safe) from the one before."""
    now = F.struct(*values)
    met = slices.previous(slices.ranged(samples, by, order), by, order, "_before", now)
    return met.where(F.col("_before").isNull() | ~now.eqNullSafe(F.col("_before"))).drop("_before", slices.RANGE)


def high_water(samples: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Add fresh: what each value adds to the greatest value before it."""
    met = slices.running_max(slices.ranged(samples, by, order), by, order, "_most", F.col(value), itself=False)
    return met.withColumn("fresh", F.greatest(F.col(value) - F.coalesce("_most", F.lit(0)), F.lit(0))).drop("_most", slices.RANGE)


def cooldown(samples: DataFrame, by: list[str], order: list[str], at: str, delay: str) -> DataFrame:
    """Add until: the running latest end of all pauses; delays are kept to 1 to 3600 s, unknown ones 1.5 s."""
    d = F.col(delay)
    kept = F.when(d.isNull() | F.isnan(d), COOLDOWN_UNKNOWN).otherwise(F.least(F.greatest(d, F.lit(COOLDOWN[0])), F.lit(COOLDOWN[1])))
    return slices.running_max(slices.ranged(samples, by, order), by, order, "until", F.col(at) + kept).drop(slices.RANGE)


def stalled(samples: DataFrame, by: list[str], order: list[str], offset: str, start: int = 0, sent: str | None = None, total: str | None = None) -> DataFrame:
    """Add stalled and went_back to acknowledged offsets, in order, after ``start``; with ``sent`` also invalid.

    stalled: the second acknowledgement in a row that confirms nothing new; went_back: it confirms less
    than the one before, which is an invalid answer and not a stall.  ``sent`` has the bytes sent since
    the acknowledgement before, ``total`` those of the whole file: an answer that goes back, confirms
    more than was sent, or says that more is wanted at the end of the file is invalid.
    """
    met = slices.previous(slices.ranged(samples, by, order), by, order, "_before", F.col(offset))
    before = F.coalesce("_before", F.lit(start))
    marked = met.withColumn("went_back", F.col(offset) < before).withColumn("_nothing", F.col(offset) == before)
    if sent is not None:
        beyond = F.col(offset) > before + F.col(sent)
        at_end = F.lit(False) if total is None else F.col(offset) >= F.col(total)
        marked = marked.withColumn("invalid", F.col("went_back") | beyond | at_end)
    again = slices.previous(marked.drop("_before"), by, order, "_again", F.col("_nothing"))
    return again.withColumn("stalled", F.col("_nothing") & F.coalesce("_again", F.lit(False))).drop("_nothing", "_again", slices.RANGE)


def batches(rows: DataFrame, by: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Add batch: the first row alone, then chunks."""
    met = slices.running_sum(slices.ranged(rows, by, order), by, order, "_n", F.lit(1))
    n = F.col("_n") - 1
    return met.withColumn("batch", F.when(n < ALONE_FIRST, 0).otherwise(1 + F.floor((n - ALONE_FIRST) / chunk)).cast("bigint")).drop("_n", slices.RANGE)


def observation_batches(entries: DataFrame, by: list[str], order: list[str], is_directory: str, chunk: int = CHUNK) -> DataFrame:
    """The files of a scan with segment and chunk: which commit takes them.

    The first file goes alone (chunk -1); a directory commits what was gathered before it; the others go
    in chunks.  A file's place is the number of files before it less that at the last directory, so both
    are running sums over ranges, and one scan is many tasks.
    """
    folder = F.col(is_directory)
    met = slices.running_sum(slices.ranged(entries, by, order), by, order, "segment", folder.cast("bigint"))
    met = slices.running_sum(met, by, order, "_files", (~folder).cast("bigint"))
    beside = F.greatest(F.col("_files") - ALONE_FIRST, F.lit(0))  # without the one that goes alone
    met = slices.running_max(met, by, order, "_gone", F.when(folder, beside))
    place = beside - F.coalesce("_gone", F.lit(0)) - 1
    number = F.when(F.col("_files") <= ALONE_FIRST, -1).otherwise(F.floor(place / chunk)).cast("bigint")
    return met.where(~folder).withColumn("chunk", number).drop("_files", "_gone", slices.RANGE)


def transfers_in_order(transfers: DataFrame) -> DataFrame:
    """Running and queued transfers of each direction in the order in which they began, with their place."""
    by, order = ["direction", "state"], ["began", "id"]
    return slices.running_sum(slices.ranged(transfers, by, order), by, order, "place", F.lit(1)).drop(slices.RANGE)


def run_statistics(actions: DataFrame) -> DataFrame:
    """One row: counts and bytes by action, failures, issues, and work left, in one partial aggregate."""
    a = F.col("action")
    count = lambda *names: F.count_if(a.isin(*names))
    size = lambda *names: F.coalesce(F.sum(F.when(a.isin(*names), F.col("bytes"))), F.lit(0)).cast("bigint")
    return actions.agg(
        count("upload").alias("uploaded"), size("upload").alias("uploaded_bytes"), count("download").alias("downloaded"), size("download").alias("downloaded_bytes"),
        count("scanned", "skipped").alias("scanned"), count("skipped").alias("skipped"), count("directoryCreated").alias("directories_created"), count("issue").alias("issues"), count("nameConflict").alias("name_conflicts"),
        count("trashRemote", "deleteLocal").alias("deleted"), count("conflict").alias("conflicts"), count("failed", "scanFailed").alias("failures"),
        (F.greatest(count("pending"), F.max(F.when(a == "enumerated", 1).otherwise(0))) + count("conflict")).alias("remote_work_pending"),
    )


def writer_statistics(flushes: DataFrame) -> DataFrame:
    """One row by flush reason, with average batch sizes (0 when nothing was flushed)."""
    return flushes.groupBy("reason").agg(F.count("*").alias("flushes"), F.sum("rows").cast("bigint").alias("rows")).withColumn("average", F.coalesce(F.try_divide("rows", "flushes"), F.lit(0.0)).cast("double"))


def throughput(files: Column, size: Column, seconds: Column) -> tuple[Column, Column]:
    """Files and binary megabytes a second; 0 for no time."""
    per = lambda x: F.coalesce(F.try_divide(x, seconds), F.lit(0.0))
    return per(files), per(size / (1024.0 * 1024.0))


def middle(samples: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, median, smallest, n): the middle sample, the lower one of two, never an average."""
    view = samples.select(*by, F.col(value).alias("_v"))
    return view.groupBy(*by).agg(F.expr("percentile_disc(0.5) within group (order by _v)").alias("median"), F.min("_v").alias("smallest"), F.count("*").alias("n"))
