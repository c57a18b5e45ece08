"""Which stored item an observed row is: one winner for each, whatever keys could claim it.

A stored item has two unique keys, its place (parent_id, name) and its remote_id, and a weak one, its
inode.  Keys are tried in order: a row or an item that an earlier key has matched is out of reach of
the later ones, so no item is claimed twice and no place or remote object ends in two items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import name_key, valid_name
from concordat.sources.workspace import Workspace, spread

from . import diff, feed, tree


class DuplicateEntity(RuntimeError):
    """Two items would share a place or a remote object."""


def check_unique(items: DataFrame) -> DataFrame:
    """``items``, or an error if a place or a remote_id stands twice; combined on the map side."""
    keys = {"place": (["parent_id", "name"], "parent_id is not null"), "remote_id": (["remote_id"], "remote_id is not null")}
    for what, (key, held) in keys.items():
        twice = items.where(held).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
        if twice:
            raise DuplicateEntity(f"the {what} of two items: {twice[0].asDict()}")
    return items


def local_matches(fresh: DataFrame, items: DataFrame, current: DataFrame) -> DataFrame:
    """(scan_id, item_id, how) of scanned rows that are stored items; how: inPlace, moved, or otherKind.

    ``fresh``: scan_id, kind (file, directory), parent_id, name, device, inode; ``items``: item_id,
    entry_kind and the same; ``current``: all scanned places.  The item of a place is the row's, also
    when the inode is another (a file saved by replacement); if it is of another kind, the row must not
    be written (otherKind).  A row at a new place is a moved item if the item's place is gone and it
    alone has that inode; of two rows with that inode the first by place is it.
    """
    own = items.select("item_id", F.col("entry_kind").alias("stored_kind"), "parent_id", "name")
    placed = fresh.join(own, ["parent_id", "name"]).select("scan_id", "item_id", F.when(F.col("kind") == F.col("stored_kind"), "inPlace").otherwise("otherKind").alias("how"))
    work = Workspace(items.sparkSession, "places")
    placed = work.save(placed, "placed")
    rest = work.save(fresh.join(placed, "scan_id", "left_anti").withColumn("root_id", F.lit(1)), "rest")
    stored = items.withColumns({"root_id": F.lit(1), "kind": F.col("entry_kind")})
    here = current.select(F.col("parent_id"), F.col("name"))
    old = stored.where("parent_id is not null").select("item_id", "parent_id", "name")
    free = diff.renames(rest, stored, here).join(old, "item_id").join(here, ["parent_id", "name"], "left_anti")
    moved = free.groupBy("item_id").agg(F.min("scan_id").alias("scan_id"))
    return placed.unionByName(moved.select("scan_id", "item_id", F.lit("moved").alias("how")))


def remote_matches(items: DataFrame, seen: DataFrame) -> DataFrame:
    """(remote_id, accepted, adopts) for every live observation inside the root: may it be written now.

    ``items``: item_id, parent_id, name, entry_kind, remote_id, remote_version; ``seen``: remote_id, name,
    parent_remote, version, is_directory, placeable, one row an object.  An observation is accepted if

    * its parent is a stored directory, or one that is accepted here (chains of new directories count);
    * no item of another object has its name, compared as ``name_key`` does, in that directory, and no
      item of no object that is spelt differently, of another kind, or in the way of a stored object;
    * of several that want one name it is the stored object, or else the smallest remote_id.

    adopts: the item without a remote object, of the same name and kind, that a new object becomes.
    """
    work = Workspace(items.sparkSession, "identity")  # what is read several times is written once, and a name folded once
    keyed = work.save(items.select("item_id", "parent_id", "name", "entry_kind", "remote_id", "remote_version", name_key("name").alias("name_key")), "keyed")
    stored = keyed.where("remote_id is not null").select("remote_id", F.col("item_id").alias("own_id"), F.col("parent_id").alias("own_parent"), F.col("name").alias("own_name"), "remote_version")
    folders = keyed.where("remote_id is not null and entry_kind = 'directory'").select(F.col("remote_id").alias("parent_remote"), F.col("item_id").alias("to_parent"))
    live = seen.select("remote_id", "name", "parent_remote", "version", "is_directory", (F.coalesce("placeable", F.lit(False)) & valid_name(F.col("name"))).alias("ok"), name_key("name").alias("name_key"))
    asked = work.save(live, "asked")
    live = spread(asked, folders, "parent_remote", "remote_id", "left").join(stored, "remote_id", "left")
    kind = F.when(F.col("is_directory"), "directory").otherwise("file")

    taken = feed.name_conflicts(asked.select("remote_id", "parent_remote", "name", "name_key"), keyed).select("remote_id").distinct().withColumn("taken", F.lit(True))
    alone = keyed.where("remote_id is null").select(F.col("parent_id").alias("to_parent"), "name", F.col("item_id").alias("alone"), F.col("entry_kind").alias("alone_kind"))
    live = live.join(taken, "remote_id", "left").join(alone, ["to_parent", "name"], "left")
    in_the_way = F.col("alone").isNotNull() & (F.col("own_id").isNotNull() | (F.col("alone_kind") != kind))
    live = live.withColumn("ok", F.col("ok") & F.col("taken").isNull() & ~in_the_way)

    live = work.save(live, "live")

    stays = F.col("own_id").isNotNull() & F.col("own_parent").eqNullSafe(F.col("to_parent")) & (F.col("own_name") == F.col("name"))
    stale = F.col("own_id").isNotNull() & ~feed.fresh_enough(F.col("version"), F.col("remote_version"))
    wants = live.where(F.col("ok") & ~stays & ~stale)
    first = wants.groupBy("parent_remote", "name_key").agg(F.min(F.struct(F.col("own_id").isNull(), "remote_id")).alias("first")).select("first.remote_id").withColumn("first", F.lit(True))
    live = work.save(live.join(first, "remote_id", "left").withColumn("ok", F.col("ok") & (stays | stale | F.col("first").isNotNull())), "claimed")

    anchored = F.col("to_parent").isNotNull()
    unsure = live.where(F.col("ok") & ~anchored)
    if unsure.limit(1).isEmpty():
        accepted = live.withColumn("accepted", F.col("ok") & anchored)
    else:  # chains of new directories, up to one below a stored directory
        links = live.where(F.col("ok") & (F.col("is_directory") | ~anchored))
        nodes = links.select(F.col("remote_id").alias("id"), F.col("parent_remote").alias("parent_id"), F.lit("").alias("name"))
        tops = links.where(anchored & F.col("own_id").isNull() & F.col("is_directory")).select(F.col("remote_id").alias("id"))
        held = links.where(~F.col("is_directory")).select(F.col("remote_id").alias("parent_id"))
        nodes = nodes.join(held, "parent_id", "left_anti")  # a file holds nothing
        reached = tree.excluded(nodes, tops).select(F.col("id").alias("remote_id")).withColumn("reached", F.lit(True))
        accepted = live.join(reached, "remote_id", "left").withColumn("accepted", F.col("ok") & (anchored | F.col("reached").isNotNull()))
    return accepted.select("remote_id", "accepted", F.when(F.col("own_id").isNull(), F.col("alone")).alias("adopts"), "own_id", "to_parent", (F.col("own_id").isNotNull() & ~stays).alias("moves"))
