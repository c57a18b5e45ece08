"""Which rows an unfinished or conflicting state holds back; joins on paths without nested loops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.paths import ancestors_or_self, overlapping, parent, parts, within


def blocked(rows: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    """Keys of rows whose path is a gate path or lies below one: an equi-join on ancestor paths."""
    exploded = rows.select(key, F.explode(ancestors_or_self(F.col("path"))).alias("path"))
    return exploded.join(gate.select("path").distinct(), "path", "left_semi").select(key).distinct()


def open_rows(rows: DataFrame, gate: DataFrame, key: str) -> DataFrame:
    return rows.join(blocked(rows, gate, key), key, "left_anti")


def failed_subtrees(rows: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Keys of rows strictly below a failed directory, or that are that directory: its path and its inode."""
    same = rows.where("is_directory").join(failed.select("path", "device", "inode").distinct(), ["path", "device", "inode"], "left_semi").select(key)
    below = rows.select(key, parent(F.col("path")).alias("path"))
    return blocked(below, failed, key).union(same).distinct()


def union_of(sources: list[DataFrame]) -> DataFrame:
    """The distinct ids of several sources: one shuffle after a union, combined on the map side."""
    return reduce(DataFrame.unionByName, [s.select("id", "path") for s in sources]).distinct()


def overlaps(paths: DataFrame, key: str) -> DataFrame:
    """(key, partners, smallest) of rows whose path equals, holds or lies below that of others.

    partners: how many others; smallest: the smallest key of them all, the row itself included, which
    is the claim that came first.  Paths are counted before they meet, by equi-joins on ancestors: the
    rows grow with the depth of paths, however many of them are equal.
    """
    own = paths.select(key, F.array_join(parts(F.col("path")), "/").alias("path"))
    at = own.groupBy("path").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    chain = at.select("path", "n", "least", F.explode(ancestors_or_self(F.col("path"))).alias("p"))
    above = chain.join(at.select(F.col("path").alias("p"), F.col("n").alias("n_"), F.col("least").alias("least_")), "p")
    above = above.groupBy("path").agg(F.sum("n_").alias("n_above"), F.min("least_").alias("least_above"))  # itself included
    below = chain.where("p <> path").groupBy(F.col("p").alias("path")).agg(F.sum("n").alias("n_below"), F.min("least").alias("least_below"))
    met = own.join(above, "path").join(below, "path", "left")
    partners = F.col("n_above") + F.coalesce("n_below", F.lit(0)) - 1
    return met.select(key, partners.cast("bigint").alias("partners"), F.least("least_above", "least_below").alias("smallest")).where("partners > 0")


def claims(wanted: DataFrame, claimed: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner) of wanted folders that overlap a folder which another owner has claimed."""
    up = wanted.select(key, owner, F.explode(ancestors_or_self(F.col("path"))).alias("p"))
    at = wanted.select(key, owner, F.array_join(parts(F.col("path")), "/").alias("p"))
    theirs = claimed.select(F.col(owner).alias("_theirs"), F.col("path").alias("_path"))
    inside = up.join(theirs.withColumn("p", F.array_join(parts(F.col("_path")), "/")), "p")
    around = at.join(theirs.select("_theirs", F.explode(ancestors_or_self(F.col("_path"))).alias("p")), "p")
    return inside.select(key, owner, "_theirs").union(around.select(key, owner, "_theirs")).where(F.col(owner) != F.col("_theirs")).select(key, owner).distinct()


def waiting(items: DataFrame, inbox: DataFrame, scans: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id) of items that nothing may touch now: without evidence, excluded, queued, named like a queued object, being listed, or in conflict.

    ``items``: item_id, parent_id, remote_id, name_key, phase, remote_status, excluded; ``inbox``:
    remote_id, parent_remote, name_key; ``scans``: remote_id, state; ``conflicts``: item_id.
    """
    ids = items.select("item_id", "remote_id")
    parents = items.select(F.col("item_id").alias("parent_id"), F.col("remote_id").alias("parent_remote"))
    places = inbox.join(parents, "parent_remote").select("parent_id", "name_key").distinct()
    sources = [
        items.where("(phase = 'waitingEvidence' and remote_status = 'unknown') or excluded"),
        ids.join(inbox.select("remote_id"), "remote_id", "left_semi"),
        items.join(places, ["parent_id", "name_key"], "left_semi"),
        ids.join(scans.where("state = 'pending'").select("remote_id"), "remote_id", "left_semi"),
        conflicts,
    ]
    return reduce(DataFrame.union, [s.select(F.col("item_id").alias("id")) for s in sources]).distinct()


def binding_conflicts(roots: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active roots that stand against a wanted binding: same remote or overlapping path, not the same pair.

    Roots are a few configured rows, compared with one wanted row at a time.
    """
    w = wanted.select(F.col("path").alias("w_path"), F.col("remote").alias("w_remote"))
    clash = (F.col("remote") == F.col("w_remote")) | overlapping(F.col("path"), F.col("w_path"))
    same = (F.col("remote") == F.col("w_remote")) & (F.col("path") == F.col("w_path"))
    return roots.where("is_active").join(F.broadcast(w.limit(1)), clash & ~same).drop("w_path", "w_remote")


def below_deleted(files: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Files left after those below a directory that one side deleted."""
    return open_rows(files, deleted, key)


def staging_allowed(folders: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, allowed): whether each folder lies outside every active root."""
    active = roots.where("is_active").select(F.array_join(parts(F.col("path")), "/").alias("path"))
    return folders.select(key).join(blocked(folders, active, key).withColumn("_inside", F.lit(True)), key, "left").select(key, F.col("_inside").isNull().alias("allowed"))


def duplicate_names(children: DataFrame, parent: str, key: str, ident: str) -> DataFrame:
    """(parent, key, n): sibling names that more than one object claims."""
    return children.groupBy(parent, key).agg(F.count_distinct(ident).alias("n")).where("n > 1")


def protected(tasks: DataFrame, held: DataFrame, released: DataFrame) -> DataFrame:
    """The distinct task ids, with those held, without those released: (id)."""
    return tasks.select("id").union(held.select("id")).distinct().join(released.select("id"), "id", "left_anti")
