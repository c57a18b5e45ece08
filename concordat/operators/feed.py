"""A durable change feed: latest payload by key, version checks, invalidation, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.sources.workspace import spread

from .tree import excluded

#: Rows of one round.
BATCH = 1000

CHANGE = "fileId string, removed boolean, file struct<id: string, name: string, mimeType: string, parents: array<string>, size: string, sha256Checksum: string, version: string, trashed: boolean>"


def parsed(changes: DataFrame, column: str = "payload") -> DataFrame:
    """Change payloads as columns; sizes and versions that are no numbers are null."""
    df = changes.withColumn("_c", F.from_json(column, CHANGE))
    file = F.col("_c.file")
    return df.select(
        *changes.columns, F.col("_c.fileId").alias("remote_id"), F.coalesce("_c.removed", F.lit(False)).alias("removed"), file["name"].alias("name"), F.get(file["parents"], 0).alias("parent_remote"),
        file["size"].try_cast("bigint").alias("size"), F.lower(file["sha256Checksum"]).alias("sha256"), file["version"].try_cast("bigint").alias("version"), F.coalesce(file["trashed"], F.lit(False)).alias("trashed"),
    )


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: a map-side combined ``max_by``, no window over a hot key."""
    rest = [c for c in events.columns if c not in key]
    by = F.struct(*order)
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), by).alias("_r"), F.count("*").alias("n_events")).select(*key, "_r.*", "n_events")


def enqueue(inbox: DataFrame, events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The inbox after new events: the latest event replaces the entry and resets attempted_at."""
    new = latest(events, key, order).drop("n_events").withColumn("attempted_at", F.lit(0.0))
    return inbox.join(new.select(*key), key, "left_anti").unionByName(new.select(inbox.columns))


def reschedule(jobs: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """Jobs with another scan_id start anew (no page, pending); the same scan_id changes nothing."""
    w = wanted.select(*key, F.col("scan_id").alias("new_scan")).distinct()
    joined = jobs.join(w, key, "full_outer")
    anew = F.col("new_scan").isNotNull() & ~F.col("new_scan").eqNullSafe(F.col("scan_id"))
    return joined.select(*key, F.when(anew, F.col("new_scan")).otherwise(F.col("scan_id")).alias("scan_id"), F.when(~anew, F.col("page_token")).alias("page_token"), F.when(anew, "pending").otherwise(F.col("state")).alias("state"))


def fresh_enough(incoming: Column, stored: Column) -> Column:
    """Not older than what is stored; an unknown version on either side passes."""
    return incoming.isNull() | stored.isNull() | (incoming >= stored)


def apply_observations(items: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Items after remote observations (one row a key), with what each observation did.

    ``items``: key, name, parent_remote, sha256, size, version, status, phase, excluded,
    remote_generation, dirty_generation; ``seen``: key, name, parent_remote, sha256, size, version,
    removed, trashed, scope (inside, outside, unknown) and placeable (its parent is a known folder and
    its name can stand there).

    A removed object excludes the stored one and leaves its status; a trashed one is marked, whatever
    its version; one that is not inside is excluded.  A present one is written unless it is older than
    what is stored, and is then no longer excluded.  An object that is not stored is inserted only if
    it is present.  effect: inserted, updated, trashed, excluded, stale, or kept.
    """
    cols = ["name", "parent_remote", "sha256", "size", "version"]
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    new = seen.select(
        key, *[F.col(c).alias(f"new_{c}") for c in cols],
        flag("removed").alias("_removed"), flag("trashed").alias("_trashed"), (F.col("scope") == "inside").alias("_inside"), flag("placeable").alias("_placeable"), F.lit(True).alias("_seen"),
    )
    joined = items.join(new, key, "full_outer")
    known, has = F.col("status").isNotNull(), flag("_seen")
    gone = has & known & (flag("_removed") | (~flag("_trashed") & ~flag("_inside")))
    trash = has & known & ~flag("_removed") & flag("_trashed")
    present = has & ~flag("_removed") & ~flag("_trashed") & flag("_inside") & flag("_placeable")
    write = present & (~known | fresh_enough(F.col("new_version"), F.col("version")))
    effect = (
        F.when(write, F.when(known, "updated").otherwise("inserted")).when(trash, "trashed").when(gone, "excluded")
        .when(present, "stale").otherwise("kept")
    )
    count = lambda c, did: (F.coalesce(F.col(c), F.lit(0)) + did.cast("int")).cast("bigint").alias(c)
    return joined.where(known | write).select(
        key, *[F.when(write, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
        F.when(write, "present").when(trash, "trashed").otherwise(F.col("status")).alias("status"),
        F.when(write | trash, "ready").otherwise(F.col("phase")).alias("phase"),
        F.when(write, False).when(gone, True).otherwise(flag("excluded")).alias("excluded"),
        count("remote_generation", write), count("dirty_generation", write | trash), effect.alias("effect"),
    )


def exclude_below(applied: DataFrame, key: str) -> DataFrame:
    """``applied`` with everything below an excluded row excluded too, but what was written just now."""
    nodes = applied.select(F.col(key).alias("id"), F.col("parent_remote").alias("parent_id"), "name")
    below = excluded(nodes, applied.where("effect = 'excluded'").select(F.col(key).alias("id"))).select(F.col("id").alias(key), F.lit(True).alias("_below"))
    hit = F.col("_below").isNotNull() & ~F.col("effect").isin("inserted", "updated")
    return applied.join(below, key, "left").withColumn("excluded", F.when(hit, True).otherwise(F.col("excluded"))).drop("_below")


def still_queued(seen: DataFrame) -> DataFrame:
    """The observations that stay in the inbox: of unknown scope, or inside but without a place yet."""
    live = ~F.coalesce("removed", F.lit(False)) & ~F.coalesce("trashed", F.lit(False))
    return seen.where(live & ((F.col("scope") == "unknown") | ((F.col("scope") == "inside") & ~F.coalesce("placeable", F.lit(False)))))


def invalidate(items: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Items whose observation a change makes unknown until it is read again."""
    hit = changed.select(key).distinct().withColumn("_hit", F.lit(True))
    flag = F.coalesce("_hit", F.lit(False))
    joined = items.join(hit, key, "left")
    return joined.withColumns({"remote_status": F.when(flag, "unknown").otherwise(F.col("remote_status")), "remote_generation": F.col("remote_generation") + flag.cast("int"), "dirty_generation": F.col("dirty_generation") + flag.cast("int")}).drop("_hit")


def root_lost(changes: DataFrame, root: Column) -> DataFrame:
    """One row: whether the root itself was removed or trashed, which stops the run."""
    return changes.agg(F.coalesce(F.max((F.col("remote_id") == root) & (F.col("removed") | F.col("trashed"))), F.lit(False)).alias("root_lost"))


def page_problem(incomplete: Column, token: Column, previous: Column) -> Column:
    """Why a listing page cannot be used; null if it can."""
    return F.when(incomplete, "incompleteSearch").when(token == "", "emptyToken").when(token == previous, "tokenDidNotAdvance")


def cursor_rejected(status: Column, body: Column) -> Column:
    """A cursor that the service no longer knows: everything is listed anew."""
    return (status == 410) | ((status == 400) & F.lower(body).contains("pagetoken"))


def retry_page(inbox: DataFrame, started: float, limit: int = BATCH) -> DataFrame:
    """The next entries to try: least recently attempted first, ties by id."""
    return inbox.where(F.col("attempted_at") < started).orderBy("attempted_at", "id").limit(limit)


def unobserved(items: DataFrame, excluded: DataFrame, inbox: DataFrame, pending_scans: DataFrame, limit: int = 64) -> DataFrame:
    """Items to read again when no listing is pending: not excluded, not queued."""
    open_ = items.where("remote_status = 'unknown'").join(excluded, "id", "left_anti").join(inbox.select("id"), "id", "left_anti")
    return open_.join(pending_scans.limit(1).select(F.lit(True).alias("p")), F.lit(True), "left_anti").orderBy("id").limit(limit)


def pending_count(inbox: DataFrame, scans: DataFrame, unknown: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: queued changes, pending listings and unknown items outside excluded subtrees."""
    parts = inbox.select(F.lit(1).alias("one")).unionByName(scans.where("state = 'pending'").select(F.lit(1).alias("one"))).unionByName(unknown.join(excluded, "id", "left_anti").select(F.lit(1).alias("one")))
    return parts.agg(F.count("*").alias("pending"))


def name_conflicts(inbox: DataFrame, items: DataFrame) -> DataFrame:
    """(remote_id, name, parent_id): queued changes whose folded name is taken in their folder, once each.

    ``inbox``: remote_id, parent_remote, name, name_key; ``items``: item_id, remote_id, parent_id, name,
    name_key.  Taken means: by an item of another remote object, or by one of none that is spelt
    differently.  Items are counted by place before they meet the changes, so no pairs are formed.
    """
    place = ["parent_id", "name_key"]
    parents = items.select(F.col("item_id").alias("parent_id"), F.col("remote_id").alias("parent_remote"))
    wanted = spread(inbox, parents, "parent_remote", "remote_id").select("remote_id", "name", *place).distinct()
    taken = items.groupBy(*place).agg(F.count("remote_id").alias("remote"), F.count_if(F.col("remote_id").isNull()).alias("local"))
    own = items.where("remote_id is not null").groupBy(*place, "remote_id").agg(F.count("*").alias("own"))
    spelt = items.where("remote_id is null").groupBy(*place, "name").agg(F.count("*").alias("spelt"))
    met = wanted.join(taken, place).join(own, [*place, "remote_id"], "left").join(spelt, [*place, "name"], "left")
    none = F.lit(0)
    return met.where((F.col("remote") > F.coalesce("own", none)) | (F.col("local") > F.coalesce("spelt", none))).select("remote_id", "name", "parent_id")


def lookup(wanted: DataFrame, objects: DataFrame, key: str) -> DataFrame:
    """The wanted keys with what is known of them and outcome: found, or notFound."""
    return wanted.select(key).join(objects.withColumn("_found", F.lit(True)), key, "left").withColumn("outcome", F.when(F.col("_found"), "found").otherwise("notFound")).drop("_found")


def advance(jobs: DataFrame, pages: DataFrame, key: str = "id") -> DataFrame:
    """Listing jobs after a wave of pages: the next token, complete without one, from the start if it was stale.

    ``pages``: key, requested_token, next_token, stale.  A page of another token than the job's is late
    and does not count; a job that is not pending stays as it is.
    """
    joined = jobs.join(pages.select(key, "requested_token", "next_token", "stale", F.lit(True).alias("_page")), key, "left")
    hit = F.coalesce("_page", F.lit(False)) & (F.col("state") == "pending") & F.col("requested_token").eqNullSafe(F.col("page_token"))
    stale = hit & F.coalesce("stale", F.lit(False))
    done = hit & ~stale & F.col("next_token").isNull()
    return joined.select(key, "scan_id", F.when(stale | done, None).when(hit, F.col("next_token")).otherwise(F.col("page_token")).alias("page_token"), F.when(done, "complete").when(stale, "pending").otherwise(F.col("state")).alias("state"))


def wave(jobs: DataFrame, limit: int) -> DataFrame:
    """The pending jobs of one wave: 1 to 64, smallest ids first."""
    return jobs.where("state = 'pending'").orderBy("id").limit(max(1, min(64, limit)))
