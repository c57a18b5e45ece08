"""Issues: one row for each root, subject and stage; pages of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.functions.issues import STAGES

#: Rows of a page at most.
MAX_PAGE = 1000


def rollup(reports: DataFrame, key: list[str], at: str, order: list[str], values: list[str]) -> DataFrame:
    """Reports of one key as one issue: first and last seen, count, and the latest values."""
    latest = F.max_by(F.struct(*values), F.struct(*order))
    return reports.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("occurrence_count"), latest.alias("v")).select(*key, "first_seen", "last_seen", "occurrence_count", "v.*")


def merge(stored: DataFrame, new: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Stored issues after a round's: first seen stays, counts add up, the later values stay."""
    both = stored.unionByName(new)
    counts = (F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("occurrence_count").alias("occurrence_count"))
    return both.groupBy(*key).agg(*counts, F.max_by(F.struct(*values), F.col("last_seen")).alias("v")).select(*key, "first_seen", "last_seen", "occurrence_count", "v.*")


def clear(stored: DataFrame, root: int) -> DataFrame:
    """The issues of other roots; in storage, one partition is overwritten."""
    return stored.where(F.col("root_id") != root)


def page(issues: DataFrame, limit: int, offset: int, id_col: str = "issue_id") -> tuple[DataFrame, int, int | None]:
    """(rows, total, next offset): newest first; rows with an unknown stage are scanned but left out.

    The next offset counts scanned rows and is None on the last page.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError("a page has 1 to 1000 rows and starts at 0 or later")
    total = issues.count()
    scanned = issues.orderBy(F.col("last_seen").desc(), F.col(id_col)).offset(offset).limit(limit)
    following = offset + min(limit, max(0, total - offset))
    return scanned.where(F.col("stage").isin(*STAGES)), total, following if following < total else None
