"""Column functions on transfers: ranges, chunks, retries and what went wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
CHUNK = 8 * 1024 * 1024
RANGE_PREFIX = "bytes=0-"
RATE_REASONS = ("userRateLimitExceeded", "rateLimitExceeded", "quotaExceeded", "sharingRateLimitExceeded", "dailyLimitExceeded")
MAX_BACKOFF = 16.0
RETRIES = 5
REASON_WAIT = 2.0
TRANSIENT = (500, 502, 504)


def confirmed_offset(header: Column, total: Column) -> Column:
    """Bytes that a range header confirms: none without a header, null if it is not valid."""
    digits = F.regexp_extract(header, "^bytes=0-([0-9]+)$", 1)
    last = F.when(digits != "", digits.try_cast("bigint"))
    return F.when(header.isNull(), F.lit(0).cast("bigint")).when((last >= 0) & (last < total), last + 1)


def transport(size: Column) -> Column:
    return F.when(size <= CHUNK, "multipart").otherwise("resumable")


def chunk_starts(offset: Column, size: Column, chunk: int = CHUNK) -> Column:
    """Where the chunks after ``offset`` begin; no chunk if nothing is left."""
    return F.when(offset < size, F.sequence(offset, size - 1, F.lit(chunk).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def upload_state(status: Column) -> Column:
    return F.when(status.isin(200, 201), "complete").when(status == 308, "incomplete").when(status == 404, "expired").otherwise("error")


def rate_limit(status: Column, body: Column) -> Column:
    """``429``, ``503``, or the reason of a 403 that limits the rate; null otherwise.

    The parsed reason counts first, then the first of the known reasons that the body mentions.
    """
    parsed = F.get_json_object(body, "$.error.errors[0].reason")
    mentioned = F.coalesce(*[F.when(body.contains(r), r) for r in RATE_REASONS])
    return F.when(status == 429, "429").when(status == 503, "503").when(status == 403, F.when(parsed.isin(*RATE_REASONS), parsed).otherwise(mentioned))


def answer(status: Column, body: Column) -> Column:
    """What an answer asks for: a pause (``rateLimited``), another try (``transient``), or null."""
    return F.when(rate_limit(status, body).isNotNull(), "rateLimited").when(status.isin(*TRANSIENT), "transient")


def asked_wait(status: Column, body: Column, retry_after: Column) -> Column:
    """Seconds that the answer itself asks to wait: a limiting 403 without a header asks for two."""
    limited = (status == 403) & rate_limit(status, body).isNotNull()
    return F.coalesce(retry_after, F.when(limited, F.lit(REASON_WAIT)))


def may_resume(size: Column, sha256: Column, session_size: Column, session_sha256: Column) -> Column:
    """Whether an unfinished transfer goes on: its session is for the same size and content."""
    return F.coalesce((size == session_size) & (F.lower(sha256) == F.lower(session_sha256)), F.lit(False))


def backoff(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait after a limited request; the jitter (0.2 to 0.8) is an input."""
    return F.greatest(F.coalesce(retry_after, F.lit(0.0)), F.least(F.lit(MAX_BACKOFF), F.pow(F.lit(2.0), attempt) + jitter))


def network_backoff(attempt: Column, jitter: Column) -> Column:
    """Seconds to wait after a failed connection; the jitter (0.1 to 0.5) is an input."""
    return F.least(F.lit(MAX_BACKOFF), F.pow(F.lit(2.0), attempt - 1) + jitter)


def may_retry(attempt: Column, retries: int = RETRIES) -> Column:
    return attempt <= retries
