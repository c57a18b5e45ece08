"""Column functions on names, digests and keys."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# A file name's longest UTF-8 form and the names that no file can have.
MAX_NAME_BYTES = 255
RESERVED_NAMES = (".", "..")


def digest(content: Column) -> Column:
    """SHA-256 as 64 lower-case hexadecimal digits; null stays null."""
    return F.sha2(content.cast("binary"), 256)


def same_digest(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def range_digest(content: Column, offset: Column, length: Column) -> Column:
    """SHA-256 of ``length`` bytes of the content from ``offset``; of fewer where it ends before."""
    return F.sha2(F.substring(content.cast("binary"), offset + 1, length), 256)


def epoch_seconds(at: Column) -> Column:
    """A timestamp as seconds since 1970, the form in which rows keep their times."""
    return F.unix_micros(at.cast("timestamp")) / 1e6


def missing(value: Column) -> Column:
    """No evidence: null or empty."""
    return value.isNull() | (value == "")


def valid_name(name: Column) -> Column:
    slashes = name.contains("/") | name.contains("\0")
    return name.isNotNull() & (name != "") & ~name.isin(*RESERVED_NAMES) & ~slashes & (F.octet_length(name) <= MAX_NAME_BYTES)


@F.pandas_udf(StringType())
def name_key(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Names that a case- and normalisation-blind file system takes for one: case folded, then NFC.

    Spark has no Unicode normalisation among its functions, hence Arrow batches; equal names of a
    batch are folded once.
    """
    for part in names:
        seen = {n: unicodedata.normalize("NFC", n.casefold()) for n in part.dropna().unique()}
        yield part.map(seen)


def subject_key(item: Column, remote: Column, path: Column) -> Column:
    """What an issue is about: the item if known, else the remote object, else the path."""
    return F.when(item.isNotNull(), F.concat(F.lit("item:"), item.cast("string"))).when(remote.isNotNull(), F.concat(F.lit("remote:"), remote)).otherwise(F.concat(F.lit("path:"), path))


def conflict_key(kind: str, root: Column, other: Column) -> Column:
    return F.concat_ws("-", F.lit(kind), root.cast("string"), other.cast("string"))


def cache_key(remote: Column, sha256: Column) -> Column:
    return F.concat_ws(":", remote, F.lower(sha256))


def byte_size(n: Column) -> Column:
    """Binary megabytes below a gigabyte, else gigabytes, with two decimals."""
    giga = 1024.0**3
    return F.when(n >= giga, F.format_string("%.2f GB", n / giga)).otherwise(megabytes(n))


def megabytes(n: Column) -> Column:
    """Whole bytes as binary megabytes with two decimals, however many; halves go to the even digit."""
    mega = 1 << 20
    whole = n.cast("decimal(30,0)") * 100
    left = whole % mega
    floor = ((whole - left) / mega).cast("decimal(30,0)")
    up = (left * 2 > mega) | ((left * 2 == mega) & (floor % 2 == 1))
    cents = (floor + up.cast("int")).cast("decimal(30,0)")
    return F.concat((cents / 100).cast("decimal(30,2)").cast("string"), F.lit(" MB"))
