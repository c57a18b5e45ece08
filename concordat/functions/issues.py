"""What an error means for whoever reads the list of issues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stages, and category and action by kind of error.
STAGES = ("localScan", "createDirectory", "upload", "download", "pathUpdate", "delete", "conflictRefresh")
MEANING = {
    "localScan": ("localIO", "inspectLocalFile"),
    "nameConflict": ("remoteConflict", "renameRemote"),
    "typeReplacementDeferred": ("staleState", "retry"),
    "publicationRecovery": ("localIO", "inspectLocalFile"),
    "rateLimited": ("rateLimited", "retryLater"),
    "notFound": ("remoteMissing", "retry"),
    "conflict": ("remoteConflict", "retry"),
    "checksumMismatch": ("integrityMismatch", "retry"),
    "sizeMismatch": ("integrityMismatch", "retry"),
    "invalidResponse": ("invalidResponse", "retry"),
    "unsafeOverwrite": ("safetyBlocked", "resolveManually"),
    "stableInputUnavailable": ("unsupportedFilesystem", "inspectLocalFile"),
    "network": ("network", "retryLater"),
    "localFileModified": ("localChanged", "retry"),
    "publicationFailed": ("localIO", "inspectLocalFile"),
    "fileSystem": ("localIO", "inspectLocalFile"),
}
STALE_WORDS = ("stale", "expired", "unavailable")


def _pick(kind: Column, status: Column, message: Column, place: int) -> Column:
    denied, stale, other = (("permissionDenied", "checkPermissions"), ("staleState", "retry"), ("unknown", "retry"))
    said = F.lower(message)
    found = F.when((kind == "server") & status.isin(401, 403), denied[place]).when(kind == "server", MEANING["network"][place])
    for name, meaning in MEANING.items():
        found = found.when(kind == name, meaning[place])
    for word in STALE_WORDS:
        found = found.when((kind == "general") & said.contains(word), stale[place])
    return found.otherwise(other[place])


def category(kind: Column, status: Column, message: Column) -> Column:
    return _pick(kind, status, message, 0)


def action(kind: Column, status: Column, message: Column) -> Column:
    return _pick(kind, status, message, 1)


def retry_delay(kind: Column, delay: Column) -> Column:
    return F.when(kind == "rateLimited", delay)
