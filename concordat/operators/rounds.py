"""One incremental round over stored items: what changed far away, what a scan found, and what follows.

Items have item_id, parent_id, name, entry_kind, remote_id, parent_remote, base_sha256, base_size,
local_status, local_sha256, local_size, device, inode, mtime, ctime, remote_status, remote_sha256,
remote_size, remote_version, phase, excluded, local_generation, remote_generation, dirty_generation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.sources.snapshots import Snapshots
from concordat.sources.workspace import Workspace, partitions, spread

from . import diff, feed, identity, metrics, reconcile, tree
from .pacing import numbered

_REMOTE = {"sha256": "remote_sha256", "size": "remote_size", "version": "remote_version", "status": "remote_status"}
_METADATA = ["device", "inode", "mtime", "ctime"]
_GENERATIONS = ["local_generation", "remote_generation", "dirty_generation"]


@dataclass(frozen=True)
class Round:
    """What a round leaves: the items, what is to be carried out, and what stays open.

    work: item_id, decision, work, reason; queued: observations that stay in the inbox; listings:
    remote_id of directories to list anew; issues: subject, stage, message.
    """

    items: DataFrame
    work: DataFrame
    statistics: DataFrame
    queued: DataFrame
    listings: DataFrame
    issues: DataFrame


def _next_id(items: DataFrame) -> int:
    return (items.agg(F.max("item_id")).first()[0] or 0) + 1


def _with_default(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df if column in df.columns else df.withColumn(column, value)


def _bumped(column: str, hit: Column) -> Column:
    return (F.coalesce(F.col(column), F.lit(0)) + hit.cast("int")).cast("bigint")


def observe_remote(items: DataFrame, seen: DataFrame, conflicts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, queued, listings) after remote observations, one row an object (see :func:`feed.apply_observations`).

    ``seen`` may have is_directory.  A new object becomes the item without a remote object of its name
    and kind in its directory, or else a new item, absent here; what may not be written now stays
    queued (see :func:`identity.remote_matches`), and so does all that concerns an object of
    ``conflicts`` (remote_id).  Directories that are new, moved or back from exclusion are to be listed.
    """
    seen = _with_default(seen, "is_directory", F.lit(False)).withColumn("is_directory", F.coalesce("is_directory", F.lit(False)))
    work = Workspace(items.sparkSession, "remote")
    held = seen.limit(0) if conflicts is None else seen.join(conflicts.select("remote_id").distinct(), "remote_id", "left_semi")
    free = seen if conflicts is None else seen.join(conflicts.select("remote_id").distinct(), "remote_id", "left_anti")
    live = "not coalesce(removed, false) and not coalesce(trashed, false) and scope = 'inside'"
    match = work.save(identity.remote_matches(items, free.where(live)), "matches")
    found = match.select("remote_id", "accepted", "adopts", "to_parent", "moves")
    free = work.save(free.drop("placeable").join(found, "remote_id", "left").withColumn("placeable", F.coalesce("accepted", F.lit(False))), "free")

    far = items.where("remote_id is not null")
    view = far.select("remote_id", "name", "parent_remote", *[F.col(c).alias(n) for n, c in _REMOTE.items()], "phase", "excluded", "remote_generation", "dirty_generation")
    applied = feed.apply_observations(view, free, "remote_id")
    applied = work.save(applied, "applied")
    if not applied.where("effect = 'excluded'").limit(1).isEmpty():
        applied = feed.exclude_below(applied, "remote_id")
    after = applied.select("*", *[F.col(n).alias(c) for n, c in _REMOTE.items()]).drop(*_REMOTE)
    after = work.save(after.join(free.select("remote_id", "adopts", "to_parent", "moves", "is_directory"), "remote_id", "left"), "after")
    set_ = ["name", "parent_remote", *_REMOTE.values(), "phase", "excluded", "remote_generation", "dirty_generation"]

    def written(rows: DataFrame, key: str) -> DataFrame:
        """``rows`` of items with what the observations of ``after`` set."""
        new = after.select(key, *[F.col(c).alias(f"_{c}") for c in set_], F.col("to_parent").alias("_parent"), F.col("effect").alias("_effect"))
        moved = F.when(F.col("_effect") == "updated", F.col("_parent")).otherwise(F.col("parent_id"))
        return rows.join(new, key).withColumns({c: F.col(f"_{c}") for c in set_} | {"parent_id": moved})

    known = written(far, "remote_id").select(items.columns)
    inserted = after.where("effect = 'inserted'")
    own = inserted.where("adopts is not null").select(F.col("adopts").alias("item_id"), F.col("remote_id").alias("_remote_id"), *[F.col(c).alias(f"_{c}") for c in set_])
    alone = items.where("remote_id is null").join(own, "item_id", "left")
    hit = F.col("_remote_id").isNotNull()
    counted = {c: F.when(hit, _bumped(c, hit)).otherwise(F.col(c)) for c in ("remote_generation", "dirty_generation")}
    alone = alone.withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in set_ if c not in counted} | counted | {"remote_id": F.col("_remote_id")}).select(items.columns)

    kind = F.when(F.col("is_directory"), "directory").otherwise("file")
    unmet = inserted.where("adopts is null").withColumns({"entry_kind": kind, "local_status": F.lit("absent"), "local_generation": F.lit(0).cast("bigint")})
    fresh = numbered(unmet, ["remote_id"], _next_id(items), partitions(unmet), ident="item_id")
    fresh = work.save(fresh, "new")
    parents = fresh.where("entry_kind = 'directory'").select(F.col("remote_id").alias("parent_remote"), F.col("item_id").alias("_new_parent"))
    fresh = spread(fresh, parents, "parent_remote", "remote_id", "left").withColumn("parent_id", F.coalesce("to_parent", "_new_parent"))
    rows = known.unionByName(alone).unionByName(fresh.select([c for c in items.columns if c in fresh.columns]), allowMissingColumns=True).select(items.columns)

    back = far.where("excluded").select("remote_id", F.lit(True).alias("_back"))
    listed = after.where("is_directory and effect in ('inserted', 'updated')").join(back, "remote_id", "left").where("effect = 'inserted' or coalesce(moves, false) or _back is not null")
    return rows, feed.still_queued(free).select(seen.columns).unionByName(held), listed.select("remote_id")


def observe_local(items: DataFrame, scan: DataFrame, digest: Callable[[DataFrame], DataFrame], gated: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, skipped, rejected) after a complete scan: parent_id, name, device, inode, mtime, ctime, size and what ``digest`` reads.

    Files whose metadata are those of a settled item are skipped; only the others reach ``digest``, once and
    before they are numbered, and only what it leaves is written: no content is. It adds sha256, null where the file could not be read: such an item is unknown here and waits.
    Rows are items by place, or moved ones by inode (see :func:`identity.local_matches`), or new; a row
    of another kind than the item at its place is rejected and the item left alone.  ``scan`` may have
    is_directory; without it directories are not looked at.  Items that the scan did not meet become
    absent unless they are ``gated`` (item_id).
    """
    has_folders = "is_directory" in scan.columns
    scan = _with_default(scan, "is_directory", F.lit(False)).withColumn("is_directory", F.coalesce("is_directory", F.lit(False)))
    work = Workspace(items.sparkSession, "local")
    stored = items.withColumn("size", F.col("local_size"))
    files = scan.where("not is_directory")
    skipped = diff.unchanged(files, stored)
    place = ["parent_id", "name"]
    seen = [*place, *_METADATA, "size"]
    places = work.save(scan.select(*seen, "is_directory"), "places")
    read = digest(diff.changed(files, stored)).select(*seen, "sha256")
    fresh = numbered(read, place, 1, ident="scan_id").withColumn("kind", F.lit("file"))
    if has_folders:
        folders = places.where("is_directory")
        folders = numbered(folders, place, 1, partitions(folders), ident="scan_id").withColumns({"kind": F.lit("directory"), "sha256": F.lit(None).cast("string"), "scan_id": -F.col("scan_id")})
        fresh = fresh.unionByName(folders, allowMissingColumns=True)
    local = {"parent_id": "parent_id", "name": "name", **{c: c for c in _METADATA}, "local_sha256": "sha256", "local_size": "size"}
    fresh = work.save(fresh.select("scan_id", "kind", *local.values()), "fresh")
    met = work.save(fresh.join(identity.local_matches(fresh, items, places), "scan_id", "left"), "met")

    found = met.where("how <> 'otherKind'").select("item_id", *[F.col(c).alias(f"_{n}") for n, c in local.items()], F.col("kind").alias("_kind"))
    hit = F.col("_kind").isNotNull()
    failed = (F.col("_kind") == "file") & F.col("_local_sha256").isNull()
    settled = (F.col("_kind") == "directory") & (F.col("local_status") == "present") & F.col("parent_id").eqNullSafe(F.col("_parent_id")) & F.col("name").eqNullSafe(F.col("_name"))
    wrote = hit & ~F.coalesce(settled, F.lit(False))
    values = {n: F.when(hit, F.col(f"_{n}")).otherwise(F.col(n)) for n in local if n != "local_sha256"}
    values |= {"local_sha256": F.when(hit & ~failed, F.col("_local_sha256")).otherwise(F.col("local_sha256"))}
    values |= {"local_status": F.when(failed, "unknown").when(hit, "present").otherwise(F.col("local_status")), "phase": F.when(failed, "waitingEvidence").when(wrote, "ready").otherwise(F.col("phase"))}
    values |= {c: _bumped(c, wrote) for c in ("local_generation", "dirty_generation")}
    known = items.join(found, "item_id", "left").withColumns(values).select(items.columns)
    scanned = F.lit(True) if has_folders else F.col("entry_kind") == "file"
    known = diff.without_missing(known, places, scanned, gated)

    unread = (F.col("kind") == "file") & F.col("sha256").isNull()
    new = met.where("item_id is null").select(*[F.col(c).alias(n) for n, c in local.items()], F.col("kind").alias("entry_kind"), F.when(unread, "unknown").otherwise("present").alias("local_status"), F.when(unread, "waitingEvidence").otherwise("ready").alias("phase"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    new = new.withColumns({"remote_status": F.lit("absent"), "excluded": F.lit(False), "local_generation": one, "remote_generation": none, "dirty_generation": one})
    added = numbered(new, place, _next_id(items), partitions(new), ident="item_id")
    return known.unionByName(added, allowMissingColumns=True).select(items.columns), skipped, met.where("how = 'otherKind'").select("item_id", *place, "kind")


def _decide_directories(due: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item_id of directories that are settled, work): one missing here that never was here is created."""
    never = (F.col("local_status") == "absent") & (F.col("local_generation") == 0) & (F.col("remote_status") == "present")
    outcome = F.when(never, "createDirectory").otherwise(reconcile.directory_outcome(F.col("local_status"), F.col("remote_status"), F.lit(None).cast("string")))
    own = due.withColumn("outcome", outcome)
    todo = own.where("outcome in ('createDirectory', 'delete')").select("item_id", F.col("outcome").alias("decision"), F.when(F.col("outcome") == "delete", "cleanup").otherwise(F.col("outcome")).alias("work"), F.lit(None).cast("string").alias("reason"))
    return own.where("outcome = 'commit'").select("item_id"), todo


def _gated(decided: DataFrame, items: DataFrame, blocked: DataFrame | None, scheduled: DataFrame | None, scanning: bool) -> DataFrame:
    """The decisions that may be carried out now (see :func:`reconcile.schedule`), with paths where they matter."""
    if blocked is None and scheduled is None and not scanning:
        return decided
    ready = (F.col("local_status") == "present") & (F.col("remote_status") == "present")
    nodes = items.where("entry_kind = 'directory'").select(F.col("item_id").alias("id"), "parent_id", "name", ready.alias("ready"))
    roots = nodes.where("parent_id is null").select("id")
    folders = tree.directories(nodes, roots).select(F.col("id").alias("parent_id"), F.col("path").alias("_above"), F.col("ready").alias("parent_ready"))
    placed = decided.join(folders, "parent_id", "left").withColumn("path", F.concat_ws("/", F.when(F.col("_above") != "", F.col("_above")), "name"))
    placed = placed.withColumn("parent_ready", F.coalesce("parent_ready", F.lit(False))).drop("_above")
    none = items.limit(0)
    return reconcile.schedule(placed, none.select(F.col("name").alias("path")) if blocked is None else blocked, none.select("item_id") if scheduled is None else scheduled, "item_id", scanning).select(decided.columns)


def run(
    items: DataFrame, seen: DataFrame, scan: DataFrame, digest: Callable[[DataFrame], DataFrame], gate: DataFrame | None = None, conflicts: DataFrame | None = None,
    blocked: DataFrame | None = None, scheduled: DataFrame | None = None, scanning: bool = False, state: Snapshots | None = None,
) -> Round:
    """A round: remote observations, the scan, a decision for every dirty item, and its receipt.

    Items that are excluded or ``gate``-d (item_id) are not decided on.  ``blocked`` (path), ``scheduled``
    (item_id) and ``scanning`` hold decisions back.  Decisions that only change a row are committed to
    it; the others are work.  No two items end with one place or remote_id: such a round is an error.
    With ``state`` the items are its next version.
    """
    work_ = Workspace(items.sparkSession, "round")
    items, seen = work_.save(items, "items"), work_.save(seen, "seen")  # read in every step
    gate = items.limit(0).select("item_id") if gate is None else gate
    far, queued, listings = observe_remote(items, seen, conflicts)
    far, queued, listings = work_.save(far, "far"), work_.save(queued, "queued"), work_.save(listings, "listings")
    near, skipped, rejected = observe_local(far, scan, digest, gate)
    near = identity.check_unique(work_.save(near, "near"))

    due = reconcile.dirty(near).where("not excluded").join(gate, "item_id", "left_anti")
    decided = reconcile.decide(due.where("entry_kind = 'file'").withColumn("pending_create", F.lit(None).cast("string")))
    applied = work_.save(reconcile.apply_decisions(_gated(decided, near, blocked, scheduled, scanning)), "applied")
    settled, folder_work = _decide_directories(due.where("entry_kind = 'directory'"))
    after = reconcile.commit_decisions(near, applied, "item_id").drop("outcome").join(settled.withColumn("_settled", F.lit(True)), "item_id", "left")
    done = F.col("_settled").isNotNull()
    after = after.withColumns({"phase": F.when(done, "committed").otherwise(F.col("phase")), "dirty_generation": F.when(done, 0).otherwise(F.col("dirty_generation")).cast("bigint")}).select(items.columns)
    after = work_.save(after, "after")
    if state is not None:
        state.commit(after)

    todo = applied.where("work is not null").select("item_id", "decision", "work", "reason").unionByName(folder_work)
    named = feed.name_conflicts(_keyed(queued), _keyed(near))
    issues = named.select(F.col("remote_id").alias("subject"), F.lit("pathUpdate").alias("stage"), F.concat(F.lit("the name is taken: "), "name").alias("message"))
    issues = issues.unionByName(rejected.select(F.col("item_id").cast("string").alias("subject"), F.lit("localScan").alias("stage"), F.concat(F.lit("replaced by a "), "kind", F.lit(": "), "name").alias("message")))
    action = lambda df, name: df.select(F.lit(name).alias("action"), F.lit(None).cast("bigint").alias("bytes"))
    size = F.when(F.col("work") == "upload", F.col("local_size")).when(F.col("work") == "download", F.col("remote_size"))
    did = applied.where("work is not null").select(F.when(F.col("work") == "safetyBlocked", "failed").otherwise(F.col("work")).alias("action"), size.alias("bytes"))
    actions = did.union(action(skipped, "skipped")).union(action(diff.changed(scan, far.withColumn("size", F.col("local_size"))), "scanned")).union(action(queued, "pending"))
    return Round(after, todo, metrics.run_statistics(actions), queued, listings, issues)


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("name_key", identity.name_key("name"))


def incremental(items: DataFrame, seen: DataFrame, scan: DataFrame, digest: Callable[[DataFrame], DataFrame], gate: DataFrame, state: Snapshots | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, work, statistics) of :func:`run`."""
    done = run(items, seen, scan, digest, gate, state=state)
    return done.items, done.work, done.statistics
