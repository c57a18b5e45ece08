"""Scans of real folders, and listings and change pages as Python data sources."""

from __future__ import annotations

import hashlib
import json
import os
import stat
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from concordat.functions.paths import not_version_control
from concordat.operators.diff import same_version, trusted_digest

ENTRY = "path string, name string, parent string, is_directory boolean, device long, inode long, mtime long, ctime long, size long"
READ = 8 * 1024 * 1024


class FolderSource(DataSource):
    """``folder``: every entry below a folder with its metadata in nanoseconds, hidden and empty ones too.

    Option path: a folder that all executors see; option partitions: about how many to make.  Options
    below (a path) and parents (a JSON list of paths) choose what is listed: all below a folder, or what
    lies directly in some.  They are options and not pushed filters, because Spark 4.1 keeps what was
    pushed with the source and not with the scan, so two filtered scans of one source mix up.  The
    driver lists directories from the top until so many are known, and no further; each of those is a
    partition with all below it, and the ones above them are listed by tasks too.  Within a partition
    a directory comes before what it holds.  Content is not opened.
    """

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        parents = self.options.get("parents")
        return _FolderReader(self.options["path"].rstrip("/"), int(self.options.get("partitions", "64")), self.options.get("below", ""), None if parents is None else json.loads(parents))


class _FolderReader(DataSourceReader):
    def __init__(self, path: str, wanted: int, below: str, parents: list[str] | None):
        self.path, self.wanted, self.below, self.parents = path, wanted, below, parents

    def partitions(self):
        if self.parents is not None:
            return [_Folder(p, deep=False) for p in self.parents if self._listed(p)]
        above, below = [], deque([self.below] if self._listed(self.below) else [])
        while below and len(below) < self.wanted and len(above) < 16 * self.wanted:
            at = below.popleft()
            above.append(at)
            with os.scandir(os.path.join(self.path, at)) as entries:
                below.extend(self._relative(e) for e in sorted(entries, key=lambda e: e.name) if self._is_folder(e))
        return [*(_Folder(p, deep=False) for p in above), *(_Folder(p, deep=True) for p in below)]

    def _listed(self, folder: str) -> bool:
        """Whether a folder that is asked for is one that a listing from the top would reach."""
        parts = [p for p in folder.split("/")] if folder else []
        if parts and (parts[0] == ".git" or any(p in ("", ".", "..") for p in parts)):
            return False
        at = [os.path.join(self.path, *parts[:k]) for k in range(1, len(parts) + 1)]
        return os.path.isdir(self.path) and all(os.path.isdir(p) and not os.path.islink(p) for p in at)

    def _relative(self, entry: os.DirEntry) -> str:
        return entry.path[len(self.path) + 1 :]

    def _is_folder(self, entry: os.DirEntry) -> bool:
        return entry.is_dir(follow_symlinks=False) and self._relative(entry) != ".git"

    def read(self, partition):
        waiting = [] if partition is None else [partition.path]  # none where no folder is chosen
        while waiting:
            with os.scandir(os.path.join(self.path, waiting.pop())) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    rel, seen, is_dir = self._relative(entry), entry.stat(follow_symlinks=False), entry.is_dir(follow_symlinks=False)
                    if is_dir and rel == ".git":
                        continue
                    yield rel, entry.name, os.path.dirname(rel), is_dir, seen.st_dev, seen.st_ino, seen.st_mtime_ns, seen.st_ctime_ns, seen.st_size
                    if is_dir and partition.deep:
                        waiting.append(rel)


def entries(spark: SparkSession, root: str, below: str = "", parents: list[str] | None = None) -> DataFrame:
    """The entries below ``root``, or ``below`` a folder in it, or directly in ``parents``; not .git and what it holds.

    Only the folders that can hold such entries are listed.
    """
    spark.dataSource.register(FolderSource)
    options = {"path": root, "below": below} | ({} if parents is None else {"parents": json.dumps(sorted(set(parents)))})
    return spark.read.format("folder").options(**options).load().where(not_version_control(F.col("path")))


def files(spark: SparkSession, root: str) -> DataFrame:
    return entries(spark, root).where("not is_directory")


_VERSION = ("device", "inode", "mtime", "ctime", "size")
_READINGS = "path string, sha256 string, error string, " + ", ".join(f"{when}_{c} long" for when in ("before", "after") for c in _VERSION)


def _read(root: str, path: str) -> tuple[str | None, str | None, list, list]:
    """(digest, error, version before, version after): a file that cannot be read is a row, not a failed task."""
    before = after = [None] * len(_VERSION)
    own, where = hashlib.sha256(), os.path.join(root, path)
    try:
        flags = os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0) | getattr(os, "O_NONBLOCK", 0)
        with open(os.open(where, flags), "rb") as content:
            before = _version(os.fstat(content.fileno()))
            if not stat.S_ISREG(os.fstat(content.fileno()).st_mode):
                return None, "not a regular file", before, after
            while part := content.read(READ):
                own.update(part)
        after = _version(os.lstat(where))
    except OSError as failed:
        return None, failed.strerror or type(failed).__name__, before, after
    return own.hexdigest(), None, before, after


def _version(seen: os.stat_result) -> list[int]:
    return [seen.st_dev, seen.st_ino, seen.st_mtime_ns, seen.st_ctime_ns, seen.st_size]


def _readings(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_read(root, path) for path in batch.column("path").to_pylist()]
            out = {"path": batch.column("path"), "sha256": pa.array([r[0] for r in rows], pa.string()), "error": pa.array([r[1] for r in rows], pa.string())}
            for side, k in (("before", 2), ("after", 3)):
                out |= {f"{side}_{c}": pa.array([r[k][n] for r in rows], pa.int64()) for n, c in enumerate(_VERSION)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def readings(root: str, changed: DataFrame) -> DataFrame:
    """For each path of ``changed``: its digest, or why it could not be read, and its version around the reading.

    One pass gives good and bad rows.  Files are read in pieces, so a file of any size fits.  The
    fast-path join comes first: only files whose metadata changed are in ``changed``.
    """
    return changed.select("path").mapInArrow(_readings(root.rstrip("/")), _READINGS)


def settled(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, sha256) of files that did not change while they were read, and (path, error) of all others."""
    same = same_version("before", "after")
    good = read.where(F.col("error").isNull() & same).select("path", "sha256")
    return good, read.where(F.col("error").isNotNull() | ~same).select("path", F.coalesce("error", F.lit("changed while it was read")).alias("error"))


def digests(root: str, changed: DataFrame) -> DataFrame:
    """path and sha256 of the files that ``changed`` names; null where there is no digest to trust.

    Such a file waits for evidence in a round, see :func:`concordat.operators.rounds.observe_local`.
    """
    return readings(root, changed).select("path", F.when(F.col("error").isNull(), trusted_digest("before", "after", F.col("sha256"))).alias("sha256"))


def is_empty(spark: SparkSession, root: str) -> bool:
    """Whether nothing but .git lies in the folder: stops at the first entry, reads no metadata of others."""
    with os.scandir(root) as entries:
        return not any(e.name != ".git" for e in entries)


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool = False):
        self.path, self.deep = path, deep


class ListingSource(DataSource):
    """``listing``: pages of JSON listings, one folder of pages for each directory.

    Option directories (a JSON list) chooses some; the others are not opened.
    Option path: a folder with one sub-folder for each listed directory, holding page files
    ``<token>.json`` ({"files": [...], "nextPageToken": ..., "incompleteSearch": ...}), the first named
    ``start.json``.  One partition for each directory; pages are followed in the task until there is no
    token.  An incomplete page, an empty token, or one that does not advance fails the read.
    """

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return "directory string, id string, name string, mimeType string, size string, sha256Checksum string, version string, trashed boolean"

    def reader(self, schema) -> DataSourceReader:
        chosen = self.options.get("directories")
        return _ListingReader(self.options["path"], None if chosen is None else sorted(set(json.loads(chosen))))


class _ListingReader(DataSourceReader):
    def __init__(self, path: str, directories: list[str] | None):
        self.path, self.directories = path, directories

    def partitions(self):
        if self.directories is not None:
            named = [d for d in self.directories if d and "/" not in d and d not in (".", "..")]
            return [_Folder(f"{self.path}/{d}") for d in named if os.path.isdir(f"{self.path}/{d}")]
        with os.scandir(self.path) as entries:
            return [_Folder(e.path) for e in sorted(entries, key=lambda e: e.name) if e.is_dir()]

    def read(self, partition):
        token, seen = None if partition is None else "start", set()  # none where no directory is chosen
        while token:
            if token in seen:
                raise ValueError(f"{partition.path}: the token {token} did not advance")
            seen.add(token)
            with open(f"{partition.path}/{token}.json") as page:
                page = json.load(page)
            if page.get("incompleteSearch"):
                raise ValueError(f"{partition.path}: the listing is incomplete")
            if page.get("nextPageToken") == "":
                raise ValueError(f"{partition.path}: the next token is empty")
            for f in page.get("files", []):
                yield (os.path.basename(partition.path), f["id"], f["name"], f.get("mimeType"), f.get("size"), f.get("sha256Checksum"), f.get("version"), f.get("trashed"))
            token = page.get("nextPageToken")


#: Changes of a page at most; a change's number is its page's number times this, and its place.
PAGE = 1000


class ChangesSource(DataSource):
    """``changes``: a stream of change pages; the offset is a page's token and number.

    Option path: a folder of ``<token>.json`` ({"changes": [...], "nextPageToken" | "newStartPageToken"}),
    option start: the first token.  The driver follows the tokens to the last page that is there; the
    changes themselves are read by tasks, one for each page.  A page {"error": {"code": ..., "message": ...}}
    that says that the token is not known any more ends the stream with CursorRejected.
    """

    @classmethod
    def name(cls) -> str:
        return "changes"

    def schema(self) -> str:
        return "token string, seq long, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ChangesReader(self.options["path"], self.options.get("start", "start"))


class _Page(InputPartition):
    def __init__(self, token: str, number: int):
        self.token, self.number = token, number


class _ChangesReader(DataSourceStreamReader):
    def __init__(self, path: str, start: str):
        self.path, self.first = path, {"token": start, "page": 0}
        self.now = self.first

    def initialOffset(self) -> dict:
        return self.first

    def _open(self, token: str) -> dict | None:
        try:
            with open(f"{self.path}/{token}.json") as page:
                return json.load(page)
        except FileNotFoundError:
            return None

    def _after(self, offset: dict) -> dict | None:
        page = self._open(offset["token"])
        error = (page or {}).get("error")
        if error:
            rejected = error.get("code") == 410 or (error.get("code") == 400 and "pagetoken" in error.get("message", "").lower())
            raise ValueError(f"{'CursorRejected' if rejected else 'the feed cannot be read'}: {offset['token']}: {error}")
        token = page and (page.get("nextPageToken") or page.get("newStartPageToken"))
        if not token or token == offset["token"]:
            return None
        return {"token": token, "page": offset["page"] + 1}

    def latestOffset(self) -> dict:
        while following := self._after(self.now):
            self.now = following
        return self.now

    def partitions(self, start: dict, end: dict):
        pages = []
        while start["page"] < end["page"]:
            pages.append(_Page(start["token"], start["page"]))
            start = self._after(start)
        return pages

    def read(self, partition):
        for k, change in enumerate(self._open(partition.token).get("changes", [])):
            yield partition.token, partition.number * PAGE + k, json.dumps(change)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FolderSource)
    spark.dataSource.register(ListingSource)
    spark.dataSource.register(ChangesSource)
