"""Plans to remove an item with all below it on the side that still has it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.sources.workspace import Workspace, shuffled

from .tree import climb

GENERATIONS = ("local_generation", "remote_generation", "dirty_generation")


def root_entries(roots: DataFrame, items: DataFrame) -> DataFrame:
    """The entry of each active root, which has no parent."""
    return roots.where("is_active").join(items.where("parent_id is null"), "root_id")


def plans(wanted: DataFrame, items: DataFrame, roots: DataFrame) -> DataFrame:
    """The wanted cleanups (item_id and the three generations they were decided on) with their state.

    ``roots`` are the few that are set up; without a hint Spark would send all items to meet them.

    state: ``ready`` with what the removal needs, ``stale`` if a generation moved since, or ``notFound``
    without an item below an active root.  path leads from the root entry; it is null where the chain
    of parents is broken.
    """
    expected = wanted.select("item_id", *[F.col(g).alias(f"_{g}") for g in GENERATIONS])
    active = roots.where("is_active").select("root_id", "root_path", "remote_root_id")
    nodes = items.select(F.col("item_id").alias("id"), "parent_id", "name")
    place = climb(nodes, items.where("parent_id is null").select(F.col("item_id").alias("id"))).where("outcome = 'reached'").select(F.col("id").alias("item_id"), "path")
    met = expected.join(shuffled(items.join(F.broadcast(active), "root_id")), "item_id", "left").join(shuffled(place), "item_id", "left")
    same = F.lit(True)
    for g in GENERATIONS:
        same = same & F.coalesce(F.col(g), F.lit(0)).eqNullSafe(F.col(f"_{g}"))
    state = F.when(F.col("root_id").isNull(), "notFound").when(~same, "stale").otherwise("ready")
    return met.withColumn("state", state).drop(*[f"_{g}" for g in GENERATIONS])


def plan_nodes(ready: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, node_id, depth, path): what each ready plan removes, from the item down.

    A plan has its whole subtree, also where other plans lie within it: should the inner one go stale,
    the outer one still covers its nodes.  Nodes find the nearest plan above them by pointer doubling;
    then each round hands them on to the next plan above, so there are as many rounds as plans nest.
    Plans in a circle have no plan above.
    """
    work = Workspace(items.sparkSession, "plans")
    wanted = ready.where("state = 'ready'").select("item_id")
    nodes = items.select(F.col("item_id").alias("id"), "parent_id", "name")
    nearest = climb(nodes, wanted.select(F.col("item_id").alias("id"))).where("outcome = 'reached'").select("id", "top", "path", "depth")
    nearest = work.save(nearest, "nearest")

    planned = nodes.join(shuffled(wanted.select(F.col("item_id").alias("id"))), "id", "left_semi")
    holder = nearest.select(F.col("id").alias("parent_id"), F.col("top").alias("outer"), F.col("path").alias("_path"), F.col("depth").alias("_depth"))
    within = planned.join(shuffled(holder), "parent_id").select("id", "outer", F.concat_ws("/", F.when(F.col("_path") != "", F.col("_path")), "name").alias("way"), (F.col("_depth") + 1).alias("steps"))
    outermost = planned.select("id").join(shuffled(within), "id", "left_anti")
    chain = planned.select("id", "name").join(shuffled(within.select("id", F.col("outer").alias("parent_id"))), "id", "left")
    sound = climb(chain, outermost).where("outcome = 'reached'").select("id")
    within = work.save(within.join(shuffled(sound), "id", "left_semi"), "within")

    found = last = nearest.select(F.col("top").alias("item_id"), F.col("id").alias("node_id"), "depth", "path")
    step = 0
    while True:
        steps = within.select(F.col("id").alias("item_id"), "outer", "way", "steps")
        path = F.concat_ws("/", "way", F.when(F.col("path") != "", F.col("path")))
        last = work.save(last.join(shuffled(steps), "item_id").select(F.col("outer").alias("item_id"), "node_id", (F.col("depth") + F.col("steps")).alias("depth"), path.alias("path")), f"step-{step}")
        if last.limit(1).isEmpty():
            return found
        found, step = found.unionByName(last), step + 1


def conflict_paths(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(item_id, conflict_path): stored conflict copies of the items that a plan removes."""
    held = conflicts.where("conflict_path is not null").select(F.col("item_id").alias("node_id"), "conflict_path")
    return nodes.select("item_id", "node_id").join(shuffled(held), "node_id").select("item_id", "conflict_path").distinct()
