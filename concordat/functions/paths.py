"""Column functions on slash-separated relative paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The greatest code point; a prefix followed by it is above every string with that prefix.
LAST = "\U0010ffff"


def parts(path: Column) -> Column:
    """Non-empty components."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(parts(path))


def base_name(path: Column) -> Column:
    return F.coalesce(F.element_at(parts(path), -1), F.lit(""))


def parent(path: Column) -> Column:
    own = parts(path)
    return F.array_join(F.slice(own, 1, F.greatest(F.size(own) - 1, F.lit(0))), "/")


def joined(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def normalised(path: Column) -> Column:
    """Without empty and ``.`` components, ``..`` resolved, absolute if it was; purely lexical."""
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def within(path: Column, folder: Column) -> Column:
    """The path is the folder or lies below it."""
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def overlapping(a: Column, b: Column) -> Column:
    return within(a, b) | within(b, a)


def with_prefix(path: Column, prefix: str) -> Column:
    """As a half-open range, so that row group statistics prune."""
    return (path >= prefix) & (path < prefix + LAST)


def ancestors_or_self(path: Column) -> Column:
    """``a``, ``a/b``, ``a/b/c``: an equi-join on these replaces a prefix join."""
    own = parts(path)
    return F.transform(F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own))).otherwise(F.array().cast("array<int>")), lambda n: F.array_join(F.slice(own, F.lit(1), n), "/"))


def rebased(path: Column, old: Column, new: Column) -> Column:
    """The path after ``old`` was renamed to ``new``."""
    return F.when(within(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)


def stays_below(root: Column, path: Column) -> Column:
    """Whether ``root``/``path`` is lexically a place below ``root`` (links on disk are not looked at)."""
    root = normalised(root)
    whole = normalised(F.concat(root, F.lit("/"), path))
    return within(whole, root) & (whole != root)


def not_version_control(path: Column) -> Column:
    """Whether a scan keeps the path: the folder .git and all below it are left out."""
    return ~((path == ".git") | path.startswith(".git/"))
