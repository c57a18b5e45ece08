"""Paths of a tree, kept up to date: an edit recomputes the subtrees whose links it changed, and no other.

Two keyed tables stand side by side in one versioned store: ``nodes`` by id (links, path and depth) and
``children`` by parent.  Both are read by key, so only the buckets of touched nodes are opened, and a
commit rewrites only those.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.sources.snapshots import Snapshots, StaleCursor
from concordat.sources.workspace import Workspace, partitions, shuffled

from .tree import climb

#: Parts in which the children of one parent are kept, so that a directory with a third of all rows is not one bucket.
PARTS = 8


#: What tells nodes of one id apart.
ENTRY = 0


def _with_entry(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("entry", F.col("entry").cast("int") if "entry" in nodes.columns else F.lit(ENTRY))


def _part() -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")


def _placed(links: DataFrame, above: DataFrame, roots: DataFrame) -> DataFrame:
    """``links`` with path and depth; ``above``: id, path, depth of nodes outside whose paths stand.

    A node has a row for each path of its parents.  Nodes that lead to neither a root nor such a node (broken chains, cycles) have null in both.
    """
    no_parent = F.lit(None).cast(links.schema["parent_id"].dataType)
    nodes = links.select("id", "entry", "parent_id", "name").union(above.select("id").distinct().select("id", F.lit(ENTRY), no_parent, F.lit("")))
    tops = above.select("id", "path", "depth").union(roots.join(shuffled(above), "id", "left_anti").select("id", F.lit(""), F.lit(0)))
    tops = tops.select(F.col("id").alias("top"), F.col("path").alias("_over"), F.col("depth").alias("_down"))
    path = F.when(F.col("_over") == "", F.col("path")).when(F.col("path") == "", F.col("_over")).otherwise(F.concat_ws("/", "_over", "path"))
    reached = climb(nodes, tops.select(F.col("top").alias("id"))).where("outcome = 'reached'").join(shuffled(tops), "top")
    found = reached.select("id", "entry", path.alias("path"), (F.col("depth") + F.col("_down")).alias("depth"))
    return links.select("id", "entry", "parent_id", "name").join(shuffled(found), ["id", "entry"], "left")


def _fold(stored: DataFrame | None, new: DataFrame, key: list[str]) -> DataFrame:
    kept = new.where("not gone").drop("gone")
    return kept if stored is None else stored.join(shuffled(new.select(key)), key, "left_anti").unionByName(kept)


class PathView:
    """A stored tree below ``root``; ``build`` writes it once, ``apply`` follows changes of links.

    Ids are not null.  Nodes of one id are told apart by ``entry`` (int; 0 where the column is missing): what
    is below such an id has a path by each of them.  Nodes below a missing parent, or on a cycle, are stored
    without a path and get one when a change leads them to a root again.
    """

    def __init__(self, spark: SparkSession, root: str, bits: int | None = None, **options):
        self.spark, self.bits, self.store = spark, bits, Snapshots(spark, root, **options)

    def build(self, nodes: DataFrame, roots: DataFrame) -> int:
        """The first version, from all ``nodes`` (id, parent_id, name, and entry if ids repeat) and the ids of ``roots``."""
        top = roots.select("id").distinct()
        self.store.bits = math.ceil(math.log2(partitions(nodes, self.store.leaf_bytes))) if self.bits is None else self.bits
        nodes = _with_entry(nodes)
        none = nodes.select("id").limit(0).withColumns({"path": F.lit(""), "depth": F.lit(0)})
        rows = _placed(nodes, none, top).withColumn("gone", F.lit(False))
        links = nodes.where("parent_id is not null").select("parent_id", _part().alias("part"), "id", "entry", F.lit(False).alias("gone"))
        return self._commit(rows, links, None, {"roots": top})

    def read(self, version: int | None = None) -> DataFrame:
        """(id, path, depth) of the nodes that lead to a root, a row for each path."""
        return self.store.read(version, "nodes").where("path is not null").select("id", "path", "depth")

    def apply(self, changes: DataFrame) -> int:
        """Follow ``changes`` (id, parent_id, name, removed, and entry if ids repeat) and give the version that has them.

        Rows equal to what is stored, removals of unknown ids and rows without an id change nothing; of several
        rows of one node the least counts, live ones before removals.  A removed node's children stay, without a
        path.  Where another writer commits meanwhile, the work is done again on its version.
        """
        while True:
            try:
                return self._apply(changes, self.store.version())
            except StaleCursor:
                continue

    def _apply(self, changes: DataFrame, now: int) -> int:
        work = Workspace(self.spark, "path-view")
        cursor = self.store.head(now)["cursor"]
        changed = work.save(self._changed(_with_entry(changes), now), "changed")
        if changed.isEmpty():
            return now
        own, link = changed.select("id").distinct(), ["id", "entry", "parent_id", "name"]
        below = self._below(own, now, work)
        stored = self.store.lookup(below.union(own), "nodes", now).select(link).distinct().join(shuffled(changed), ["id", "entry"], "left_anti")
        links = work.save(changed.where("not removed").select(link).unionByName(stored), "links")
        parents = links.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
        outside = parents.join(shuffled(links), "id", "left_anti").join(shuffled(own), "id", "left_anti")
        above = self.store.lookup(outside, "nodes", now).where("path is not null").select("id", "path", "depth")
        rows = _placed(links, above, self.store.read(now, "roots")).withColumn("gone", F.lit(False))
        rows = work.save(rows, "rows")  # a commit reads them twice
        removed = changed.where("removed").select("id", "entry", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("parent_id", "name", "path", "depth")], F.lit(True).alias("gone"))
        left = changed.where("old_parent is not null").select(F.col("old_parent").alias("parent_id"), _part().alias("part"), "id", "entry", F.lit(True).alias("gone"))
        joined = changed.where("not removed and parent_id is not null").select("parent_id", _part().alias("part"), "id", "entry", F.lit(False).alias("gone"))
        return self._commit(rows.unionByName(removed), left.unionByName(joined), cursor, None)

    def _changed(self, changes: DataFrame, now: int) -> DataFrame:
        """(id, entry, parent_id, name, removed, old_parent) of the nodes whose links are not those stored."""
        row = F.struct(F.coalesce("removed", F.lit(False)).alias("removed"), "parent_id", "name")
        new = changes.where("id is not null").groupBy("id", "entry").agg(F.min(row).alias("row")).select("id", "entry", "row.*")
        old = self.store.lookup(new.select("id"), "nodes", now).select("id", "entry", F.col("parent_id").alias("old_parent"), F.col("name").alias("old_name"), F.lit(True).alias("known")).distinct()
        same = F.col("parent_id").eqNullSafe(F.col("old_parent")) & F.col("name").eqNullSafe(F.col("old_name"))
        known = F.col("known").isNotNull()
        return new.join(shuffled(old), ["id", "entry"], "left").where(F.when(F.col("removed"), known).otherwise(~(known & same))).drop("old_name", "known")

    def _below(self, changed: DataFrame, now: int, work: Workspace) -> DataFrame:
        """(id) of what is below the changed nodes and not changed itself.

        Nodes of one id have several parents, so a level may meet an earlier one; it is not followed again.
        """
        level, found = changed, [changed]
        while True:
            wanted = level.select(F.col("id").alias("parent_id"), F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part"))
            children = self.store.lookup(wanted, "children", now).select("id").distinct().join(shuffled(reduce(DataFrame.union, found)), "id", "left_anti")
            level = work.save(children, f"level-{len(found)}")
            found.append(level)
            if level.isEmpty():
                return reduce(DataFrame.union, found[1:])

    def _commit(self, rows: DataFrame, links: DataFrame, cursor: str | None, whole: dict[str, DataFrame] | None) -> int:
        folds = {
            "nodes": (rows, ["id"], lambda stored, new: _fold(stored, new, ["id"])),
            "children": (links, ["parent_id", "part"], lambda stored, new: _fold(stored, new, ["parent_id", "part", "id", "entry"])),
        }
        return self.store.commit_all(whole, folds=folds, cursor=uuid.uuid4().hex, expected=cursor)
