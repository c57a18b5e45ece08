"""Three-way reconciliation of a baseline with two observed sides, as one Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.functions.paths import ancestors_or_self
from concordat.functions.text import missing

from .store import compare_and_swap

# The reasons that decisions carry.
UNSTABLE = "Local file body is unstable, writing"
BOTH_UNKNOWN = "Observation status unknown at both ends"
LOCAL_UNKNOWN = "Local observation status is unknown, no evidence decision is rejected"
REMOTE_UNKNOWN = "The remote observation status is unknown, refuse to make an unsubstantiated decision"
LOCAL_DIGEST = "Local file body SHA-256 To be acquired"
REMOTE_DIGEST = "Remote file body SHA-256 To be acquired"
NEW_LOCAL, NEW_REMOTE = "New local file", "New remote file"
LOCAL_CHANGED, REMOTE_CHANGED = "Only local content changed", "Only remote content changed"
PENDING_CREATE = "Restore persistent small file creation intent"


def align(baseline: DataFrame, local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """One row for each key of any side, which holds a key once: a union, and one shuffle on the key."""
    names = [c for side in (baseline, local, remote) for c in side.columns if c != key]
    stacked = baseline.unionByName(local, allowMissingColumns=True).unionByName(remote, allowMissingColumns=True)
    return stacked.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in names])


def dirty(items: DataFrame) -> DataFrame:
    """Items to decide on: changed since they were settled and not held back."""
    return items.where("dirty_generation > 0 and phase <> 'blocked'")


def changes() -> dict[str, Column]:
    """What each side did since the baseline, from the columns of an aligned row."""
    base, local, remote = (F.lower(f"{s}_sha256") for s in ("base", "local", "remote"))
    here, there = F.col("local_status") == "present", F.col("remote_status") == "present"
    return {
        "local_changed": here & (local != base), "remote_changed": there & (remote != base),
        "local_same": here & (local == base), "remote_same": there & (remote == base),
        "local_gone": F.col("local_status") == "absent", "remote_gone": F.col("remote_status").isin("absent", "trashed"),
    }


def decide(aligned: DataFrame) -> DataFrame:
    """Add decision, reason, sha256, size and prefer_local to aligned rows.

    Needs base_sha256, local_status, local_sha256, local_size, remote_status and remote_sha256; a
    null status is an unobserved side.  The first rule that holds decides; no evidence never deletes
    or overwrites.
    """
    df = aligned.withColumn("local_status", F.coalesce("local_status", F.lit("unknown"))).withColumn("remote_status", F.coalesce("remote_status", F.lit("unknown")))
    local, remote = F.col("local_status"), F.col("remote_status")
    here, there, no_base = local == "present", remote == "present", F.col("base_sha256").isNull()
    equal = F.lower("local_sha256") == F.lower("remote_sha256")
    did = changes()
    wait = (
        F.when(local == "unstable", UNSTABLE)
        .when((local == "unknown") & (remote == "unknown"), BOTH_UNKNOWN)
        .when(local == "unknown", LOCAL_UNKNOWN)
        .when(remote == "unknown", REMOTE_UNKNOWN)
        .when(here & missing(F.col("local_sha256")), LOCAL_DIGEST)
        .when(there & missing(F.col("remote_sha256")), REMOTE_DIGEST)
    )
    match = F.when(equal, "matchUpdateBaseline").otherwise("conflict")
    first_time = (
        F.when(here & (remote == "absent"), "upload").when(there & did["local_gone"], "download").when(here & there, match)
        .when(did["local_gone"] & did["remote_gone"], "unchanged").when(here & (remote == "trashed"), "keepModified")
    )
    later = (
        F.when(did["local_gone"] & did["remote_gone"], "unchanged")
        .when(did["local_gone"], F.when(did["remote_changed"], "conflict").otherwise("trashRemote"))
        .when(did["remote_gone"], F.when(did["local_changed"], "conflict").otherwise("deleteLocal"))
        .when(did["local_changed"] & did["remote_same"], "upload").when(did["remote_changed"] & did["local_same"], "download")
        .when(did["local_same"] & did["remote_same"], "unchanged").otherwise(match)
    )
    df = df.withColumn("_wait", wait).withColumn("decision", F.when(F.col("_wait").isNotNull(), "waitingEvidence").otherwise(F.when(no_base, first_time).otherwise(later)))
    said = F.when(F.col("decision") == "upload", F.when(no_base, NEW_LOCAL).otherwise(LOCAL_CHANGED)).when(F.col("decision") == "download", F.when(no_base, NEW_REMOTE).otherwise(REMOTE_CHANGED))
    adopted = F.col("decision") == "matchUpdateBaseline"
    return (
        df.withColumn("reason", F.coalesce("_wait", said)).withColumn("sha256", F.when(adopted, F.lower("local_sha256")))
        .withColumn("size", F.when(adopted, F.coalesce(F.col("local_size"), F.lit(0)).cast("bigint"))).withColumn("prefer_local", F.when(F.col("decision") == "keepModified", F.lit(True))).drop("_wait")
    )


def redecide(aligned: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Decide again for the rows that ``fresh`` observes anew (columns like the local ones of ``aligned``)."""
    names = [c for c in fresh.columns if c != key]
    return decide(aligned.drop(*names).join(fresh, key))


def schedule(decided: DataFrame, blocked: DataFrame, scheduled: DataFrame, key: str, scanning: bool) -> DataFrame:
    """The decisions that may be carried out now.

    Needs path, parent_ready and pending_create beside the decision.  Rows on or below a path of
    ``blocked`` (column path) and keys of ``scheduled`` drop out; a pending create is an upload;
    while the scan is unfinished nothing happens below a parent that is not ready, and decisions that
    delete, keep both or wait are put off.
    """
    gate = blocked.select("path").distinct()
    stopped = decided.select(key, F.explode(ancestors_or_self(F.col("path"))).alias("path")).join(gate, "path", "left_semi").select(key).distinct()
    pending = F.col("pending_create").isNotNull()
    out = decided.join(stopped, key, "left_anti").join(scheduled.select(key).distinct(), key, "left_anti")
    out = out.withColumn("reason", F.when(pending, PENDING_CREATE).otherwise(F.col("reason"))).withColumn("decision", F.when(pending, "upload").otherwise(F.col("decision")))
    if scanning:
        out = out.where(F.col("parent_ready") & F.col("decision").isin("upload", "download", "keepModified", "matchUpdateBaseline", "unchanged"))
    return out


def apply_decisions(decided: DataFrame) -> DataFrame:
    """The row each decision leaves: new baseline, statuses, phase, dirty_generation, and what is put to work.

    An upload over an existing remote object (remote_id without pending_create) is never carried
    out: the row is blocked and stays dirty.  A match marks both sides present.  A conflict keeps the
    remote digest and size, or the baseline's.
    """
    d = F.col("decision")
    sends = (d == "upload") | (d == "keepModified")
    guarded = sends & F.col("remote_id").isNotNull() & F.col("pending_create").isNull()
    match = d == "matchUpdateBaseline"
    cleanup = (d == "unchanged") & (F.col("local_status") == "absent") & (F.col("remote_status") == "trashed")
    done = match | ((d == "unchanged") & ~cleanup)
    known = ~missing(F.coalesce("remote_sha256", F.lit("")))
    kept = lambda new, old, name: F.when(match, new).otherwise(F.col(old)).alias(name)
    return decided.select(
        "*",
        kept(F.col("sha256"), "base_sha256", "new_base_sha256"), kept(F.col("size"), "base_size", "new_base_size"),
        kept(F.lit("present"), "local_status", "new_local_status"), kept(F.lit("present"), "remote_status", "new_remote_status"),
        F.when(guarded, "blocked").when(done, "committed").otherwise(F.col("phase")).alias("new_phase"),
        F.when(done, F.lit(0)).otherwise(F.col("dirty_generation")).cast("bigint").alias("new_dirty_generation"),
        F.when(guarded, "safetyBlocked").when(cleanup, "cleanup").when(sends, "upload").when(d.isin("download", "trashRemote", "deleteLocal", "conflict"), d).alias("work"),
        F.when(d == "conflict", F.when(known, F.col("remote_sha256")).otherwise(F.col("base_sha256"))).alias("conflict_sha256"),
        F.when(d == "conflict", F.when(known, F.col("remote_size")).otherwise(F.col("base_size"))).cast("bigint").alias("conflict_size"),
    )


#: What a decision's receipt compares with the stored row, and what it sets.
EXPECTED = ("local_generation", "remote_generation", "dirty_generation")
SETS = ("base_sha256", "base_size", "local_status", "remote_status", "phase", "dirty_generation")


def commit_decisions(items: DataFrame, applied: DataFrame, key: str) -> DataFrame:
    """``items`` after the applied decisions, with outcome: applied, or stale if a generation moved meanwhile.

    Only decisions that change the row by themselves have a receipt; what is put to work commits later.
    """
    own = applied.where(F.col("new_phase").isin("committed", "blocked") & (F.col("work").isNull() | (F.col("work") == "safetyBlocked")))
    receipts = own.select(key, *[F.col(e).alias(f"expected_{e}") for e in EXPECTED], *[F.col(f"new_{s}") for s in SETS])
    return compare_and_swap(items, receipts, key, list(EXPECTED), list(SETS))


def directory_outcome(local: Column, remote: Column, pending: Column) -> Column:
    """``delete`` candidates, ``commit``, or null (unknown on a side, or a create is pending)."""
    gone = ((local == "absent") & (remote == "present")) | ((remote == "trashed") & local.isin("present", "absent"))
    return F.when(gone, "delete").when(pending.isNotNull() | (local == "unknown") | (remote == "unknown"), None).otherwise("commit")


def route(known: Column, state: Column, direction: Column, local_empty: Column, remote_empty: Column) -> Column:
    """Which kind of run a root needs: incremental, a resumed or first transfer one way, nothing, or an error."""
    resumed = F.when(direction == "remoteToLocalEmpty", "remoteToLocalEmpty").otherwise("localToRemoteEmpty")
    first = F.when(~local_empty & remote_empty, "localToRemoteEmpty").when(local_empty & ~remote_empty, "remoteToLocalEmpty").when(local_empty & remote_empty, "emptyBaseline").otherwise("error")
    return F.when(known, F.when(state == "existingKnown", "incremental").otherwise(resumed)).otherwise(first)


def summary(applied: DataFrame) -> DataFrame:
    """Counts and bytes by decision, from one partial aggregate."""
    return applied.groupBy("decision").agg(F.count("*").alias("n"), F.coalesce(F.sum("local_size"), F.lit(0)).cast("bigint").alias("local_bytes"), F.count("reason").alias("with_reason"))
