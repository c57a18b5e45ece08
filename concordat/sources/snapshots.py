"""Versioned tables: a commit writes new folders and then one small file that names them.

Keyed tables are kept in buckets by the low bits of their keys' hash.  A bucket that has grown beyond
LEAF_BYTES is split by the next commit that touches it, and only it: buckets of one table differ in depth,
so a commit rewrites what its keys touch, at about one bucket's size a task, however large the table is.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bits of the first buckets of a keyed table, bytes of a bucket, and versions whose folders are kept.
BITS, LEAF_BYTES, KEEP = 5, 256 << 20, 3
BUCKET = "_bucket"


class StaleCursor(RuntimeError):
    """The stored cursor is not the one that a commit started from."""


class LostRace(RuntimeError):
    """Another writer has replaced a table that this commit replaces as a whole."""


def leaf_of(key: list[str], leaves: list[tuple[int, int]]) -> Column:
    """The name ``bits-value`` of the bucket of a row."""
    h = F.xxhash64(*key)
    by_bits: dict[int, list[int]] = {}
    for bits, value in leaves:
        by_bits.setdefault(bits, []).append(value)
    out = F.lit(None).cast("string")
    for bits, values in by_bits.items():
        low = F.pmod(h, F.lit(1 << bits))
        name = F.concat(F.lit(f"{bits}-"), low.cast("string"))
        out = F.coalesce(out, name if len(values) == 1 << bits else F.when(low.isin(values), name))
    return out


def _parts(name: str) -> tuple[int, int]:
    bits, value = name.split("-")
    return int(bits), int(value)


class Snapshots:
    """Tables below ``root`` that change together; readers see a whole version or the one before.

    A version is a file ``commit-<n>`` that names, for each table, the folders of its buckets, with
    the batches and the cursor it goes with.  It is written beside and renamed, which fails if the name
    is taken, so of two writers of one version the second has lost: it drops its folders and folds its
    rows once more onto the winner's version.  Folders are a writer's own and never changed, so a lost
    executor repeats tasks on the same input, and a reader of an older version is not disturbed until
    ``keep`` newer ones are there.  A keyed table begins with 2 ** ``bits`` buckets.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = KEEP, leaf_bytes: int = LEAF_BYTES, bits: int = BITS):
        self.spark, self.root, self.keep, self.leaf_bytes, self.bits = spark, root.rstrip("/"), keep, leaf_bytes, bits
        self._jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(conf)
        self._fs.mkdirs(self._path(""))
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path("")).toUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str = "") -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def _versions(self) -> list[int]:
        return sorted(int(n.removeprefix("commit-")) for n in self._names() if n.startswith("commit-"))

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        return max(self._versions(), default=0)

    def head(self, version: int | None = None) -> dict:
        """What a version says: batches by writer, cursor, and the folders of its tables."""
        now = self.version() if version is None else version
        if not now:
            return {"batches": {}, "cursor": None, "tables": {}}
        held = self._fs.open(self._path(f"commit-{now}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8"))
        finally:
            held.close()

    def batch(self, writer: str = "") -> int:
        return self.head()["batches"].get(writer, -1)

    def cursor(self) -> str | None:
        return self.head()["cursor"]

    def read(self, version: int | None = None, table: str = "table") -> DataFrame | None:
        """A table of a version (the newest); None if it has none."""
        return self._of(self.head(version)["tables"].get(table))

    def lookup(self, keys: DataFrame, table: str = "table", version: int | None = None) -> DataFrame:
        """The rows of a keyed table with the given keys; only the buckets that can hold them are opened."""
        entry = self.head(version)["tables"][table]
        leaves = [_parts(n) for n in entry["leaves"]]
        chosen = [r[0] for r in keys.select(leaf_of(entry["key"], leaves)).distinct().collect()]  # names of buckets
        return self._of(entry, chosen).join(keys.select(entry["key"]).distinct(), entry["key"], "left_semi")

    def _of(self, entry: dict | None, chosen: list[str] | None = None) -> DataFrame | None:
        if entry is None:
            return None
        folders = [f for name, f in entry["folders"].items() if chosen is None or name in chosen]
        schema = StructType.fromJson(json.loads(entry["schema"]))
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in folders])

    def commit(self, df: DataFrame | Callable[[DataFrame | None], DataFrame], batch: int = -1, table: str = "table") -> int:
        """A whole table as the next version; a batch that was committed before is not applied again."""
        return self.commit_all({table: df}, batch)

    def commit_all(
        self, whole: dict[str, DataFrame | Callable[[DataFrame | None], DataFrame]] | None = None, batch: int = -1, folds: dict[str, tuple] | None = None,
        cursor: str | None = None, expected: str | None = None, writer: str = "",
    ) -> int:
        """Several tables and the cursor in one version: all of it becomes visible, or nothing.

        ``whole``: tables that are replaced, by rows or by a function of the stored rows.  ``folds``:
        {table: (new rows, key, fold)}, keyed tables of which only the buckets with new keys are
        rewritten; ``fold(stored, new)`` gives their rows, and stored is None in the first version.
        With ``expected`` the stored cursor must be that one.  Batches are numbered by ``writer``.

        If another writer was first, folds and functions are applied once more to its version; rows that
        replace a table which it has changed too raise LostRace, and a moved cursor StaleCursor.
        """
        began = None
        while True:
            now = self.version()
            head = self.head(now)
            began = head if began is None else began
            if 0 <= batch <= head["batches"].get(writer, -1):
                return now
            if expected is not None and head["cursor"] != expected:
                raise StaleCursor(f"the cursor is {head['cursor']!r}, not {expected!r}")
            for name, df in (whole or {}).items():
                if isinstance(df, DataFrame) and head["tables"].get(name) != began["tables"].get(name):
                    raise LostRace(f"another writer has changed {name!r}")
            own = f"v-{now + 1}-{uuid.uuid4().hex[:12]}"
            try:
                tables = dict(head["tables"])
                for name, df in (whole or {}).items():
                    rows = df if isinstance(df, DataFrame) else df(self._of(head["tables"].get(name)))
                    rows.write.parquet(f"{self.root}/{own}-{name}")
                    tables[name] = {"schema": rows.schema.json(), "key": None, "folders": {"0-0": f"{own}-{name}"}, "bytes": {"0-0": self._bytes(f"{own}-{name}")}}
                for name, (new, key, fold) in (folds or {}).items():
                    tables[name] = self._folded(f"{own}-{name}", tables.get(name), new, key, fold)
            except Exception:
                self._drop(own)
                if self.version() == now:
                    raise
                continue  # what was read has been deleted meanwhile: start from the newest version
            batches = head["batches"] | ({writer: batch} if batch >= 0 else {})
            made = {"batches": batches, "cursor": head["cursor"] if cursor is None else cursor, "tables": tables}
            if self._publish(now + 1, made):
                self._forget(now + 1)
                return now + 1
            self._drop(own)

    def _publish(self, version: int, made: dict) -> bool:
        """Whether ``made`` is now that version; False if another writer's is."""
        draft = self._path(f".draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(made).encode()))
        finally:
            out.close()
        none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        none[0] = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            self._context.rename(draft, self._path(f"commit-{version}"), none)
        except Py4JJavaError as failed:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" not in str(failed.java_exception):
                raise
            return False
        return True

    def _bytes(self, folder: str) -> int:
        return self._fs.getContentSummary(self._path(folder)).getLength()

    def _folded(self, folder: str, entry: dict | None, new: DataFrame, key: list[str], fold) -> dict:
        keyed = entry is not None and entry["key"] is not None
        if keyed and entry["key"] != key:
            raise ValueError(f"the table is kept by {entry['key']}, not by {key}")
        leaves = [_parts(n) for n in entry["leaves"]] if keyed else [(self.bits, v) for v in range(1 << self.bits)]
        touched = {r[0] for r in new.select(leaf_of(key, leaves)).distinct().collect()}  # names of buckets
        stored = self._of(entry, list(touched) if keyed else None) if entry else None
        if entry and not keyed:  # a whole table becomes a keyed one
            touched = {f"{bits}-{value}" for bits, value in leaves}
        split: dict[str, list[tuple[int, int]]] = {}
        for name in touched:
            bits, value = _parts(name)
            size = entry["bytes"].get(name, 0) if keyed else 0
            more = max(0, math.ceil(math.log2(size / self.leaf_bytes))) if size else 0
            split[name] = [(bits + more, value + (k << bits)) for k in range(1 << more)]
        targets = [leaf for own in split.values() for leaf in own]
        folded = fold(stored, new)
        rows = folded.withColumn(BUCKET, leaf_of(key, targets)) if targets else folded.limit(0).withColumn(BUCKET, F.lit(""))
        rows.repartition(max(1, len(targets)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        made = {n.removeprefix(f"{BUCKET}="): f"{folder}/{n}" for n in self._names(folder) if n.startswith(f"{BUCKET}=")}
        kept = lambda held: {n: v for n, v in held.items() if n not in touched} if keyed else {}
        names = [f"{bits}-{value}" for bits, value in targets]
        return {
            "schema": folded.schema.json(), "key": key, "leaves": sorted({n for n in (entry["leaves"] if keyed else [f"{b}-{v}" for b, v in leaves]) if n not in touched} | set(names)),
            "folders": (kept(entry["folders"]) if keyed else {}) | made, "bytes": (kept(entry["bytes"]) if keyed else {}) | {n: self._bytes(f) for n, f in made.items()},
        }

    def _drop(self, own: str) -> None:
        for name in self._names():
            if name.startswith(f"{own}-"):
                self._fs.delete(self._path(name), True)

    def _forget(self, now: int) -> None:
        """Delete commits older than the kept ones, and folders of their time that no kept commit names."""
        kept = [v for v in self._versions() if v > now - self.keep]
        named = {f.split("/")[0] for v in kept for t in self.head(v)["tables"].values() for f in t["folders"].values()}
        for name in self._names():
            old = name.startswith("commit-") and int(name[7:]) not in kept
            if old or (name.startswith("v-") and name not in named and int(name.split("-")[1]) <= now - self.keep):
                self._fs.delete(self._path(name), True)
