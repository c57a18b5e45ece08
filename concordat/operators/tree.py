"""Queries on a tree stored as parent links.

``climb`` follows all links at once by pointer doubling: after k rounds a node knows its ancestor
2**k steps up and the path from there, so a tree of depth d takes log2(d) equi-joins on the id, not
d, and no round collects anything.  Paths, subtrees, exclusion, readiness and scope are readings of
its result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.paths import depth, rebased, within
from concordat.sources.workspace import Workspace, shuffled

from . import slices
from .pacing import numbered

#: Links that scope resolution follows at most.
MAX_DEPTH = 128


def climb(nodes: DataFrame, stops: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, top, path, depth, ready, outcome) for every node.

    ``nodes``: id, parent_id, name, and optionally ready; ``stops``: id of the nodes at which chains
    end (they need not be roots).  outcome: ``reached`` (top is the first stop at or above the node,
    path leads from it, '' for itself), ``broken`` (top is the last node before the missing parent;
    path then starts with its name),
    or ``deep`` (a cycle, or longer than ``max_depth`` where that is given).  ready: every node from the
    stop down is.  A round doubles the links that are followed; if no chain ends in it, none is that long, so
    what still goes on leads to a cycle.  Paths there are no longer than twice the longest chain that ends.

    Several nodes may share an id: each has its rows, and what is below the id has one for each of their paths.
    ``nodes`` may then have ``entry``, which tells them apart and is handed on.
    """
    work = Workspace(nodes.sparkSession, "climb")
    own_ready = F.col("ready") if "ready" in nodes.columns else F.lit(True)
    entry = ["entry"] if "entry" in nodes.columns else []
    named = nodes.select("id", *entry, "parent_id", "name", own_ready.alias("ready"))
    stop = stops.select(F.col("id").alias("stop_id")).distinct()
    there = nodes.select(F.col("id").alias("there")).distinct()
    is_stop = F.col("stop_id").isNotNull()
    state = (
        named.join(shuffled(stop), F.col("id") == F.col("stop_id"), "left").join(shuffled(there), F.col("parent_id") == F.col("there"), "left")
        .select(
            "id", *entry, F.when(is_stop | F.col("there").isNull(), F.col("id")).otherwise(F.col("parent_id")).alias("top"),
            F.when(is_stop, "").otherwise(F.col("name")).alias("path"), F.when(is_stop | F.col("there").isNull(), 0).otherwise(1).alias("depth"), "ready",
            F.when(is_stop, "reached").when(F.col("there").isNull(), "broken").otherwise("going").alias("outcome"), F.lit(True).alias("fresh"),
        )
    )
    state, step = work.save(state, "step-0"), 0
    longest = state.count() if max_depth is None else max_depth
    while 2**step <= longest and not state.where("outcome = 'going'").limit(1).isEmpty() and not state.where("fresh and outcome <> 'going'").limit(1).isEmpty():
        above = state.select(F.col("id").alias("top"), F.col("top").alias("top_"), F.col("path").alias("path_"), F.col("depth").alias("depth_"), F.col("ready").alias("ready_"), F.col("outcome").alias("outcome_"))
        going = state.where("outcome = 'going'").join(shuffled(above), "top").select(
            "id", *entry, F.col("top_").alias("top"), F.concat_ws("/", F.when(F.col("path_") != "", F.col("path_")), "path").alias("path"),
            (F.col("depth") + F.col("depth_")).alias("depth"), (F.col("ready") & F.col("ready_")).alias("ready"), F.col("outcome_").alias("outcome"),
        )
        step += 1
        state = work.save(state.where("outcome <> 'going'").withColumn("fresh", F.lit(False)).unionByName(going.withColumn("fresh", F.lit(True))), f"step-{step}")
        work.drop(f"step-{step - 1}")
    return state.drop("fresh").withColumn("outcome", F.when((F.col("outcome") == "going") | (F.col("depth") > longest), "deep").otherwise(F.col("outcome")))


def paths(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, path, depth) of the nodes whose chain leads to a root; a broken chain gives no row."""
    return climb(nodes, roots).where("outcome = 'reached'").select("id", "path", "depth")


def subtree(nodes: DataFrame, root: DataFrame, deepest_first: bool = False) -> DataFrame:
    """(id, top, path, depth) of the given nodes and all below them, optionally deepest first."""
    found = climb(nodes, root).where("outcome = 'reached'").select("id", "top", "path", "depth")
    return found.orderBy(F.col("depth").desc(), "id") if deepest_first else found


def excluded(nodes: DataFrame, flagged: DataFrame) -> DataFrame:
    """(id) of flagged nodes and their descendants, once each however the flags nest."""
    return climb(nodes.withColumn("name", F.lit("")), flagged).where("outcome = 'reached'").select("id")


def exclude(nodes: DataFrame, flagged: DataFrame) -> DataFrame:
    """``nodes`` with column excluded rewritten for whole subtrees."""
    return nodes.join(excluded(nodes, flagged).withColumn("excluded", F.lit(True)), "id", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))


def directories(nodes: DataFrame, root: DataFrame, keep_orphans: bool = True) -> DataFrame:
    """(id, path, depth, ready, orphan): paths and readiness of all directories.

    Orphans hang below the root under their own names and are not ready; without ``keep_orphans``
    they and what is below them have no row.
    """
    found = climb(nodes, root)
    if not keep_orphans:
        found = found.where("outcome = 'reached'")
    orphan = F.col("outcome") != "reached"
    return found.where("outcome <> 'deep'").select("id", "path", (F.col("depth") + orphan.cast("int")).alias("depth"), (F.col("ready") & ~orphan).alias("ready"), orphan.alias("orphan"))


def scope(queued: DataFrame, fetched: DataFrame, known: DataFrame, root: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(id, scope) of queued objects: inside, outside, or unknown (they stay queued).

    ``queued`` and ``fetched``: id, parent_id, removed, trashed (of one id, what is queued counts);
    ``known``: ids stored below the root, which are inside unless they are queued themselves.  Links
    are followed up to the root or a known object (inside), or to one that is removed, trashed or has
    no parent (outside).  An object whose chain meets one that was not read, a cycle or more than
    ``max_depth`` links is unknown.
    """
    cols = ["id", "parent_id", "removed", "trashed"]
    inside = known.select("id").join(queued.select("id"), "id", "left_anti").union(root.select("id")).distinct()
    read = queued.select(cols).unionByName(fetched.select(cols).join(queued.select("id"), "id", "left_anti")).join(inside, "id", "left_anti")
    outside = read.where("coalesce(removed, false) or coalesce(trashed, false) or parent_id is null").select("id")
    stops = inside.select("id", F.lit("inside").alias("scope")).union(outside.select("id", F.lit("outside").alias("scope")))
    no_parent = F.lit(None).cast(queued.schema["parent_id"].dataType)
    nodes = read.select("id", "parent_id").union(inside.select("id", no_parent)).withColumn("name", F.lit(""))
    found = climb(nodes, stops, max_depth).where("outcome = 'reached'").join(stops.withColumnRenamed("id", "top"), "top").select("id", "scope")
    return queued.select("id").join(found, "id", "left").select("id", F.coalesce("scope", F.lit("unknown")).alias("scope"))


#: Objects whose parents are read in one run.
PROBES = 64


def to_probe(queued: DataFrame, fetched: DataFrame, known: DataFrame, root: DataFrame, limit: int = PROBES) -> DataFrame:
    """(id) of parents of live objects that nobody has read yet, smallest first; a run reads ``limit`` of them."""
    read = queued.select("id", "parent_id", "removed", "trashed").unionByName(fetched.select("id", "parent_id", "removed", "trashed"))
    wanted = read.where("not coalesce(removed, false) and not coalesce(trashed, false) and parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    have = read.select("id").union(known.select("id")).union(root.select("id"))
    return wanted.join(have, "id", "left_anti").orderBy("id").limit(limit)


def rename(tree: DataFrame, old: str, new: str) -> DataFrame:
    """``tree`` with a directory's path and all paths below it rebased."""
    return tree.withColumn("path", rebased(F.col("path"), F.lit(old), F.lit(new)))


def remove(tree: DataFrame, path: str) -> DataFrame:
    """``tree`` without a directory and what is below it."""
    return tree.where(~within(F.col("path"), F.lit(path)))


def by_depth(tree: DataFrame, deepest_first: bool) -> DataFrame:
    """``tree`` with turn: parents before children (to create), or children before parents (to delete)."""
    at = depth(F.col("path"))
    leveled = tree.withColumn("_level", -at if deepest_first else at)
    return numbered(leveled, ["_level", "path"], 1, ident="turn").drop("_level")


def longest_first(paths: DataFrame) -> DataFrame:
    """Paths with turn: the longest first, so that nothing is removed before what it holds."""
    return numbered(paths.withColumn("_length", -F.length("path")), ["_length", "path"], 1, ident="turn").drop("_length")


def traverse(start: DataFrame, listing: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, parent_id, name, is_directory, path, depth) of all that listings lead to from ``start`` (id).

    ``listing`` gives the children (parent_id, id, name, is_directory) of the folders (id) it is given.
    A level is listed in one job and written before the next; an object met before is not followed
    again, so a cycle ends.
    """
    work, depth_, found = Workspace(start.sparkSession, "traverse"), 0, []
    level = work.save(start.select("id", F.lit("").alias("path")).distinct(), "level-0")
    seen = level.select("id")
    while not level.limit(1).isEmpty():
        depth_ += 1
        children = listing(level.select("id")).join(level.select(F.col("id").alias("parent_id"), F.col("path").alias("_above")), "parent_id")
        children = children.join(seen, "id", "left_anti").groupBy("id").agg(F.min(F.struct("parent_id", "name", "is_directory", "_above")).alias("c")).select("id", "c.*")
        path = F.when(F.col("_above") == "", F.col("name")).otherwise(F.concat_ws("/", "_above", "name"))
        own = work.save(children.select("id", "parent_id", "name", "is_directory", path.alias("path"), F.lit(depth_).alias("depth")), f"found-{depth_}")
        found.append(own)
        level, seen = own.where("is_directory").select("id", "path"), seen.union(own.select("id"))
    return reduce(DataFrame.union, found)


def barrier_groups(events: DataFrame, partition: str, order: list[str], is_barrier: str) -> DataFrame:
    """Add group: every barrier is a group of its own, rows between barriers are one group."""
    by, flag = [partition], F.col(is_barrier)
    met = slices.previous(slices.ranged(events, by, order), by, order, "_before", flag)
    cut = F.when(flag | F.coalesce("_before", F.lit(False)), 1).otherwise(0)
    return slices.running_sum(met, by, order, "group", cut).withColumn("group", F.col("group").cast("bigint")).drop("_before", slices.RANGE)
