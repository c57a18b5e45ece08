"""A full listing as a stream that feeds itself: pages lead to more pages until none is open.

A wave is written before it is read, all open pages in files of some pages each, and the offset of the stream
is its number, so a batch can be repeated exactly and no page passes through the driver.  There are as many waves
as the tree has levels and folders have pages.  Each file is a task.  A batch is one commit: the entries found, and the listing jobs after it, with
new ones for the folders found; what is then pending makes the next wave.  The stream ends by itself when
no job is pending, and goes on where it was after a restart.
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from concordat.operators import feed
from concordat.sources.scan import ChangesSource
from concordat.sources.ship import ship
from concordat.sources.snapshots import Snapshots
from concordat.sources.workspace import shuffled

from .feed_stream import replay

FOLDER = "application/vnd.google-apps.folder"
#: Pages that a task lists at most.
WAVE = 64
WRITER = "listing"


class ListingWaves(DataSource):
    """``listing_waves``: the pages of successive waves.

    Options: path, a folder of page files ``<directory>/<token>.json``, the first of each named ``start.json``;
    waves, a folder of folders ``<n>.json`` of JSON lines (id of a directory, page_token).  A page gives a row
    for each file, or one without a file.  A page that is not there any more, or answers with an error, is
    stale; a first page must be there.  An incomplete page or an empty token fails the batch.
    """

    @classmethod
    def name(cls) -> str:
        return "listing_waves"

    def schema(self) -> str:
        return "directory string, requested_token string, next_token string, stale boolean, id string, name string, mimeType string, size string, sha256Checksum string, version string, trashed boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _WaveReader(self.options["path"], self.options["waves"])


class _Open(InputPartition):
    def __init__(self, file: str):
        self.file = file


class _WaveReader(DataSourceStreamReader):
    def __init__(self, path: str, waves: str):
        self.path, self.waves, self.wave = path, waves, 0

    def initialOffset(self) -> dict:
        return {"wave": 0}

    def latestOffset(self) -> dict:
        while os.path.exists(f"{self.waves}/{self.wave}.json/_SUCCESS"):
            self.wave += 1
        return {"wave": self.wave}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Open(f) for f in sorted(glob.glob(f"{self.waves}/{end['wave'] - 1}.json/part-*"))] if end["wave"] > start["wave"] else []

    def read(self, partition: _Open) -> Iterator[tuple]:
        with open(partition.file) as held:
            for line in held:
                page = json.loads(line)
                yield from self._page(page["id"], page.get("page_token"))

    def _page(self, directory: str, token: str | None) -> Iterator[tuple]:
        try:
            with open(f"{self.path}/{directory}/{token or 'start'}.json") as held:
                page = json.load(held)
        except FileNotFoundError:
            if token is None:
                raise
            page = {"error": "gone"}
        if "error" in page:
            if token is None:
                raise ValueError(f"{directory}: cannot be listed: {page['error']}")
            yield (directory, token, None, True, *[None] * 7)
            return
        following = page.get("nextPageToken")
        problem = "incompleteSearch" if page.get("incompleteSearch") else "emptyToken" if following == "" else "tokenDidNotAdvance" if following and following == token else None
        if problem:
            raise ValueError(f"{directory}: {problem}")
        for f in page.get("files", []) or [{}]:
            yield (directory, token, following, False, *[f.get(k) for k in ("id", "name", "mimeType", "size", "sha256Checksum", "version", "trashed")])


_ENTRY = ["id", "name", "mimeType", "size", "sha256Checksum", "version", "trashed"]


def _fold_jobs(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Listing jobs after a wave: pages move them on, and folders that were found have a job of their own."""
    moved = feed.advance(stored, shuffled(new.where("not found")).select("id", "requested_token", "next_token", "stale"))
    fresh = new.where("found").select("id").distinct().join(shuffled(stored.select("id")), "id", "left_anti")
    return moved.unionByName(fresh.withColumns({"scan_id": F.lit(1).cast("bigint"), "page_token": F.lit(None).cast("string"), "state": F.lit("pending")})).select(stored.columns)


def _fold_entries(stored: DataFrame | None, new: DataFrame) -> DataFrame:
    """The entry of each object as it was listed last."""
    both = new if stored is None else stored.unionByName(new)
    return both.groupBy("id").agg(F.max_by(F.struct("parent_id", *_ENTRY[1:], "wave"), "wave").alias("r")).select("id", "r.*")


def _open_wave(state: Snapshots, waves: str, limit: int | None) -> None:
    """Write the wave that the state's cursor names, unless nothing is pending; written twice, it is the same."""
    where = f"{waves}/{int(json.loads(state.cursor())['wave'])}.json"
    if os.path.exists(f"{where}/_SUCCESS"):
        return
    jobs = state.read(table="jobs")
    pages = (jobs.where("state = 'pending'") if limit is None else feed.wave(jobs, limit)).select("id", "page_token")
    if number := pages.count():
        parts = min(number, max(state.spark.sparkContext.defaultParallelism, -(-number // WAVE)))
        pages.repartition(parts).write.mode("overwrite").json(f"file://{where}")


def list_all(spark: SparkSession, pages: str, root: str, state: Snapshots, waves: str, checkpoint: str, token: str = "", limit: int | None = None) -> DataFrame:
    """List everything below the folder ``root`` (an id); gives (id, parent_id, name, ...) of what was found.

    ``state`` takes tables jobs and entries and, as its cursor, the wave and ``token``, the place in the
    feed that was taken before the first page was read.  ``pages``, ``waves``: folders that driver and
    executors see; ``limit``: pages of a wave, 64 at most, or all that are open.  Called again after a failure, it goes on with the wave that was open.
    """
    ship(spark)
    spark.dataSource.register(ListingWaves)
    if "jobs" not in state.head()["tables"]:
        first = spark.createDataFrame([(root, 1, None, "pending")], "id string, scan_id long, page_token string, state string")
        state.commit_all({"jobs": first}, cursor=json.dumps({"wave": 0, "token": token}))
    _open_wave(state, waves, limit)

    def apply(batch: DataFrame, number: int) -> None:
        now = json.loads(state.cursor())
        batch.persist()
        none = F.lit(None).cast("string")
        asked = batch.select(F.col("directory").alias("id"), "requested_token", "next_token", "stale", F.lit(False).alias("found")).distinct()
        folders = batch.where((F.col("mimeType") == FOLDER) & ~F.coalesce("trashed", F.lit(False))).select("id", none.alias("requested_token"), none.alias("next_token"), F.lit(False).alias("stale"), F.lit(True).alias("found"))
        entries = batch.where("id is not null").select("id", F.col("directory").alias("parent_id"), *_ENTRY[1:], F.lit(now["wave"]).alias("wave"))
        state.commit_all(
            batch=number, writer=WRITER, cursor=json.dumps(now | {"wave": now["wave"] + 1}),
            folds={"jobs": (asked.unionByName(folders), ["id"], _fold_jobs), "entries": (_fold_entries(None, entries), ["id"], _fold_entries)},
        )
        batch.unpersist()
        _open_wave(state, waves, limit)

    stream = spark.readStream.format("listing_waves").option("path", pages).option("waves", waves).load()
    query = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return state.read(table="entries").drop("wave")


def catch_up(spark: SparkSession, changes: str, pages: str, root: str, cursor: str | None, fresh_token: str, inbox: Snapshots, state: Snapshots, folder: str, key: str = "remote_id") -> tuple[DataFrame | None, str]:
    """(what a full listing found or None, the token that the feed was followed from).

    The feed is followed from ``cursor`` into ``inbox`` (newest change by object).  Without a cursor, or if
    the service rejects it, ``fresh_token``, taken beforehand, is where the feed goes on after everything
    below ``root`` has been listed anew, so that nothing that changes meanwhile is missed.
    """
    ship(spark)
    spark.dataSource.register(ChangesSource)

    def follow(token: str) -> None:
        raw = spark.readStream.format("changes").option("path", changes).option("start", token).load()
        replay(feed.parsed(raw).drop("payload"), inbox, f"{folder}/feed-{token}", [key], ["seq"])

    if cursor is not None:
        try:
            follow(cursor)
            return None, cursor
        except StreamingQueryException as failed:
            if "CursorRejected: " not in str(failed):  # the line that raises it may be quoted too
                raise
    found = list_all(spark, pages, root, state, f"{folder}/waves".removeprefix("file://"), f"{folder}/listing", fresh_token)
    follow(fresh_token)
    return found, fresh_token
