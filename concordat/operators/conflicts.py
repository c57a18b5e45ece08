"""Lists of conflicts, and what a later change of the remote object does to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(conflicts: DataFrame, roots: DataFrame, items: DataFrame, local_conflicts: DataFrame) -> DataFrame:
    """Both kinds of conflict in one list, with root path (null when the root is gone) and item name."""
    present = F.col("remote_status") == "present"
    synced = conflicts.join(roots.select("root_id", "root_path"), "root_id").join(items.select("item_id", "name"), "item_id").select(
        "conflict_id", "root_id", "root_path", F.col("name").alias("item_name"), "relative_path", F.when(present, F.col("conflict_path")).alias("stored_path"), F.lit("content").alias("kind"),
    )
    kept = local_conflicts.join(roots.select("root_id", "root_path"), "root_id", "left").select(
        "conflict_id", "root_id", "root_path", F.lit(None).cast("string").alias("item_name"), F.col("original_path").alias("relative_path"), "stored_path", F.lit("parentRemoved").alias("kind"),
    )
    return synced.unionByName(kept)


#: The order in which conflicts are listed.
LISTED_BY = ["relative_path", "conflict_id"]


def refresh(conflicts: DataFrame, inbox: DataFrame, items: DataFrame) -> DataFrame:
    """Conflicts after the queued changes of their objects, with what becomes of the change.

    ``inbox``: root_id, remote_id, removed, trashed, sha256, size, version, name, parent_remote, is_directory.
    Removed or trashed: the status only.  Present: new digest and size; both raise the revision.
    Without digest or size, or for a directory: an issue, nothing changes.  inbox_done is true if the
    change is settled: for a present object only if the item's name and parent (null-safe) match.
    """
    names = items.select("item_id", F.col("remote_name").alias("i_name"), F.col("remote_parent").alias("i_parent"))
    new = inbox.select(
        "root_id", F.col("remote_id").alias("remote_file_id"), "removed", "trashed", F.lower("sha256").alias("new_sha"), F.col("size").alias("new_size"),
        F.col("version").alias("new_version"), "name", "parent_remote", "is_directory", F.lit(True).alias("_change"),
    )
    joined = conflicts.join(new, ["root_id", "remote_file_id"], "left").join(names, "item_id", "left")
    change = F.col("_change").isNotNull()
    gone = change & (F.coalesce("removed", F.lit(False)) | F.coalesce("trashed", F.lit(False)))
    whole = change & ~gone & ~F.coalesce("is_directory", F.lit(False)) & F.col("new_sha").isNotNull() & F.col("new_size").isNotNull()
    pick = lambda new_, old: F.when(whole, F.col(new_)).otherwise(F.col(old)).alias(old)
    return joined.select(
        "conflict_id", "root_id", "item_id", "remote_file_id", pick("new_sha", "remote_sha256"), pick("new_size", "remote_size"), pick("new_version", "remote_version"),
        F.when(gone, F.when(F.coalesce("trashed", F.lit(False)), "trashed").otherwise("removed")).when(whole, "present").otherwise(F.col("remote_status")).alias("remote_status"),
        (F.col("revision") + (gone | whole).cast("int")).cast("bigint").alias("revision"),
        F.when(change, gone | (whole & F.col("i_name").eqNullSafe(F.col("name")) & F.col("i_parent").eqNullSafe(F.col("parent_remote")))).alias("inbox_done"),
        (change & ~gone & ~whole).alias("issue"),
    )


def refreshed_items(items: DataFrame, refreshed: DataFrame) -> DataFrame:
    """``items`` after their conflicts were refreshed: the remote side as seen, held back, and no longer dirty.

    ``refreshed`` is the result of :func:`refresh`; items whose change was not settled stay as they are.
    """
    seen = refreshed.where("inbox_done is not null and not issue").select("item_id", *[F.col(c).alias(f"_{c}") for c in ("remote_sha256", "remote_size", "remote_version", "remote_status")])
    met = items.join(seen, "item_id", "left")
    hit, present = F.col("_remote_status").isNotNull(), F.col("_remote_status") == "present"
    status = F.when(F.col("_remote_status") == "removed", "absent").otherwise(F.col("_remote_status"))
    new = {c: F.when(hit & present, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("remote_sha256", "remote_size", "remote_version")}
    new |= {"remote_status": F.when(hit, status).otherwise(F.col("remote_status")), "phase": F.when(hit, "blocked").otherwise(F.col("phase")), "dirty_generation": F.when(hit, 0).otherwise(F.col("dirty_generation"))}
    return met.withColumns(new).select(items.columns)


def resolved(conflicts: DataFrame, items: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conflicts left, items) after choices: conflict_id, revision, keep_local.

    A choice counts only for the revision it was made on.  Keeping the local side sends it, keeping the
    remote side fetches it: the other side's present digest becomes the item's baseline, so that the
    next decision is an upload or a download.
    """
    made = conflicts.join(choices.select("conflict_id", F.col("revision").alias("_revision"), "keep_local"), "conflict_id").where("revision = _revision")
    chosen = made.select("item_id", "keep_local", F.col("remote_sha256").alias("_sha"), F.col("remote_size").alias("_size"))
    met = items.join(chosen, "item_id", "left")
    hit = F.col("keep_local").isNotNull()
    base = F.when(hit, F.when(F.col("keep_local"), F.col("_sha")).otherwise(F.col("local_sha256"))).otherwise(F.col("base_sha256"))
    size = F.when(hit, F.when(F.col("keep_local"), F.col("_size")).otherwise(F.col("local_size"))).otherwise(F.col("base_size"))
    new = {"base_sha256": base, "base_size": size, "phase": F.when(hit, "ready").otherwise(F.col("phase")), "dirty_generation": F.col("dirty_generation") + hit.cast("int")}
    return conflicts.join(made.select("conflict_id"), "conflict_id", "left_anti"), met.withColumns(new).select(items.columns)


def preserve(records: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """Records of files kept aside because their remote parent went; a file that is kept already stays as it is."""
    new = files.select(F.concat(F.lit("parent-"), "file_id").alias("conflict_id"), "root_id", F.col("path").alias("original_path"), F.concat_ws("/", F.lit(folder), "path").alias("stored_path"))
    return records.unionByName(new.join(records.select("conflict_id"), "conflict_id", "left_anti").select(records.columns))


def settled(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """Records left after the resolved ones."""
    return records.join(resolved.select("conflict_id"), "conflict_id", "left_anti")
