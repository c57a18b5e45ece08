"""Comparing a scanned tree with a stored baseline: fast skip, renames, missing entries, deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.text import same_digest

from . import slices

IDENTITY = ("device", "inode", "mtime", "ctime", "size")


def decoded(scan: DataFrame) -> DataFrame:
    """Scan rows with the defaults of missing metadata: device 1, inode 0, size 0."""
    defaults = {"device": 1, "inode": 0, "size": 0}
    return scan.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast("bigint")) for c, v in defaults.items()})


def cacheable(items: DataFrame) -> DataFrame:
    """Stored files whose content need not be read again if their metadata did not change."""
    settled = (F.col("phase") == "committed") & (F.col("dirty_generation") == 0) & (F.col("local_status") == "present")
    whole = items.dropna(subset=["base_sha256", "local_sha256", "inode", "mtime"])
    return whole.where((F.col("entry_kind") == "file") & settled)


def unchanged(scan: DataFrame, stored: DataFrame, place: tuple[str, ...] = ("parent_id", "name")) -> DataFrame:
    """Scan rows that a cacheable stored row equals in identity and place: no digest needed."""
    return scan.join(cacheable(stored).select(*IDENTITY, *place), [*IDENTITY, *place], "left_semi")


def changed(scan: DataFrame, stored: DataFrame, place: tuple[str, ...] = ("parent_id", "name")) -> DataFrame:
    """The other scan rows; only these go on to be hashed."""
    return scan.join(cacheable(stored).select(*IDENTITY, *place), [*IDENTITY, *place], "left_anti")


def unchanged_anywhere(scan: DataFrame, stored: DataFrame) -> DataFrame:
    """Without place: compared with the first (smallest item_id) cacheable link of the inode only."""
    first = cacheable(stored).groupBy("device", "inode").agg(F.min_by(F.struct("mtime", "ctime", "size"), "item_id").alias("f")).select("device", "inode", "f.*")
    return scan.join(first, list(IDENTITY), "left_semi")


def same_version(a: str, b: str) -> Column:
    """Two observations of one file are the same version (null-safe over all identity fields)."""
    fields = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in IDENTITY])
    return fields(a).eqNullSafe(fields(b))


def trusted_digest(before: str, after: str, digest: Column) -> Column:
    """A digest counts only if the file was the same version before and after it was read."""
    return F.when(same_version(before, after), digest)


def renames(scan: DataFrame, stored: DataFrame, current: DataFrame) -> DataFrame:
    """For each scan row, the stored item it is: (scan_id, item_id, how).

    ``scan``: scan_id, root_id, kind, device, inode, parent_id, name; ``stored``: item_id and the same;
    ``current``: (parent_id, name) that exist now.  An item at the same place wins.  Otherwise a file
    is taken for moved only if it is the single stored item of its inode and its old place is gone; a
    directory needs no such test (the smallest item_id is taken).  Candidates are counted by a
    grouped aggregate, so hard links in a thousand places stay one row.
    """
    keys = ["root_id", "kind", "device", "inode"]
    old = stored.select("item_id", *keys, F.col("parent_id").alias("old_parent"), F.col("name").alias("old_name"))
    exact = scan.join(old, [*keys], "inner").where((F.col("parent_id") == F.col("old_parent")) & (F.col("name") == F.col("old_name"))).groupBy("scan_id").agg(F.min("item_id").alias("item_id"))
    one = old.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(F.struct("item_id", "old_parent", "old_name"), "item_id").alias("c")).select(*keys, "n", "c.*")
    rest = scan.join(exact, "scan_id", "left_anti").join(one, keys).where("kind = 'directory' or (kind = 'file' and n = 1)").select("scan_id", "kind", "item_id", "old_parent", "old_name")
    there = current.select(F.col("parent_id").alias("old_parent"), F.col("name").alias("old_name")).distinct().withColumn("_there", F.lit(True))
    moved = rest.join(there, ["old_parent", "old_name"], "left").where("kind = 'directory' or _there is null")
    tag = lambda df, how: df.select("scan_id", "item_id", F.lit(how).alias("how"))
    return tag(exact, "inPlace").unionByName(tag(moved, "moved"))


def missing(stored: DataFrame, seen: DataFrame, gated: DataFrame | None = None) -> DataFrame:
    """Stored present entries that a complete scan did not see, marked absent with new generations.

    The entry of the root itself has no parent and no place among the scanned ones: it never counts.
    """
    gone = stored.where("local_status = 'present' and parent_id is not null").join(seen, ["parent_id", "name"], "left_anti")
    if gated is not None:
        gone = gone.join(gated, "item_id", "left_anti")
    return gone.withColumns(_absent())


def _absent() -> dict[str, Column]:
    """What an entry becomes that is not there any more."""
    return {"local_status": F.lit("absent"), "local_generation": F.col("local_generation") + 1, "dirty_generation": F.col("dirty_generation") + 1, "phase": F.lit("ready")}


def without_missing(stored: DataFrame, seen: DataFrame, among: Column, gated: DataFrame | None = None) -> DataFrame:
    """All of ``stored``, with what :func:`missing` gives of the rows ``among`` in place of these; one pass."""
    met = stored.join(seen.select("parent_id", "name").distinct().withColumn("_there", F.lit(True)), ["parent_id", "name"], "left")
    gone = among & (F.col("local_status") == "present") & F.col("parent_id").isNotNull() & F.col("_there").isNull()
    if gated is not None:
        met = met.join(gated.select("item_id").distinct().withColumn("_gated", F.lit(True)), "item_id", "left")
        gone = gone & F.col("_gated").isNull()
    gone = F.coalesce(gone, F.lit(False))
    return met.withColumns({c: F.when(gone, v).otherwise(F.col(c)) for c, v in _absent().items()}).select(stored.columns)


def changed_since(fresh: DataFrame, baselines: DataFrame) -> DataFrame:
    """Files of a directory to delete that are new or whose content differs (digests compare blind to case)."""
    side = lambda df: df.select("*", F.lower("sha256").alias("_key"))
    return side(fresh).join(side(baselines).select("path", "_key"), ["path", "_key"], "left_anti").drop("_key")


def safe_to_delete(kind_now: Column, kind_then: Column, device_now: Column, device_then: Column, inode_now: Column, inode_then: Column) -> Column:
    """A local delete may go on if the entry is of another kind or is the same inode."""
    return (kind_now != kind_then) | ((device_now == device_then) & (inode_now == inode_then))


def publish_outcome(expected: Column, before: Column, written: Column, after_ok: Column) -> Column:
    """How publishing a download ended, from what was seen before and after."""
    return F.when(~expected.eqNullSafe(before), "destinationChanged").when(written & ~after_ok, "failedAfterWriteStarted").otherwise("published")


def delete_outcome(exists: Column, evidence: Column, same: Column, moved: Column, has_url: Column) -> Column:
    """How a recoverable local delete ended."""
    return F.when(~exists, "missing").when(~evidence, "missingEvidence").when(~same, F.when(moved, "restoreFailed").otherwise("changed")).when(has_url, "trashed").otherwise("trashedWithoutURL")


def verify_existing(folder: bool) -> Column:
    """The first evidence that an object that already exists is not the expected one; null if it is.

    Needs trashed, is_directory, name, parents, expected_name, expected_parent and for files size,
    sha256, expected_size, expected_sha256.  Absent evidence counts against it.
    """
    of = lambda ok: ~F.coalesce(ok, F.lit(False))
    found = (
        F.when(of(~F.col("trashed")), "trashed").when(of(F.col("is_directory") if folder else ~F.col("is_directory")), "kind")
        .when(of(F.col("name") == F.col("expected_name")), "name").when(of(F.array_contains("parents", F.col("expected_parent"))), "parent")
    )
    if folder:
        return found
    return found.when(of(F.col("size") == F.col("expected_size")), "size").when(of(same_digest(F.col("sha256"), F.col("expected_sha256"))), "checksum")


def verify_upload() -> Column:
    """The same for an upload's answer: the size may be left out, the digest may not."""
    return F.when(F.col("size").isNotNull() & (F.col("size") != F.col("expected_size")), "size").when(~F.coalesce(same_digest(F.col("sha256"), F.col("expected_sha256")), F.lit(False)), "checksum")


def links_in_order(items: DataFrame) -> DataFrame:
    """``items`` with link: their place (from 1) among the links of their inode, by item_id; numbered in ranges."""
    inode, order = ["device", "inode"], ["item_id"]
    return slices.running_sum(slices.ranged(items, inode, order), inode, order, "link", F.lit(1)).drop(slices.RANGE)


def links(items: DataFrame) -> DataFrame:
    """(device, inode, links, first_item): how often each inode is linked, without gathering the links."""
    return items.groupBy("device", "inode").agg(F.count("*").alias("links"), F.min("item_id").alias("first_item"))


def whole_rows(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows with all required columns; a row with a null among them is skipped, the rest stay."""
    return rows.dropna(subset=required)
