"""A round in which every kind of row meets an item by another key: place, remote object, inode, or none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.text import digest
from concordat.operators import rounds
from concordat.sources.workspace import Workspace, spread

from .registry import query, table

#: Of ten documents each, the case of a row is the last digit of its number; odd tens vary it.
_CASES = """
WITH d AS (SELECT doc_id + 10 AS i, (doc_id + 10) % 10 AS k, ((doc_id + 10) // 10) % 2 = 1 AS odd, sha256(text) AS s, sha256(text || 'L') AS l, sha256(text || 'R') AS r FROM documents)
"""

_ITEM_COLUMNS = ["name", "parent", "entry_kind", "remote_id", "base_sha256", "local_status", "local_sha256", "remote_status", "remote_sha256", "phase", "dirty_generation"]


def _round(spark: SparkSession, sf_dir: str) -> rounds.Round:
    texts = table(spark, sf_dir, "documents").select((F.col("doc_id") + 10).alias("i"), "text", F.col("n_chars").cast("bigint").alias("n"))
    digests = [digest(F.col("text")).alias("plain"), digest(F.concat("text", F.lit("R"))).alias("there")]
    docs = Workspace(spark, "merges").save(texts.select("i", "n", *digests), "docs")  # only the scan reads texts again
    i, k, odd = F.col("i"), F.col("i") % 10, F.floor(F.col("i") / 10) % 2 == 1
    plain, there = F.col("plain"), F.col("there")
    long = lambda v: F.lit(v).cast("bigint")
    string = F.lit(None).cast("string")

    def named(letter: str, number: Column = i) -> Column:
        return F.concat(F.lit(letter), number.cast("string"))

    settled = docs.where(k.isin(0, 5, 6, 8, 9)).select(
        i.alias("item_id"), long(1).alias("parent_id"), named("f").alias("name"), F.lit("file").alias("entry_kind"), named("r").alias("remote_id"), F.lit("r1").alias("parent_remote"),
        *[plain.alias(f"{s}_sha256") for s in ("base", "local", "remote")], *[F.col("n").alias(f"{s}_size") for s in ("base", "local", "remote")], F.lit("present").alias("local_status"), F.lit("present").alias("remote_status"),
        long(1).alias("device"), *[i.alias(c) for c in ("inode", "mtime", "ctime")], long(3).alias("remote_version"), F.lit("committed").alias("phase"), F.lit(False).alias("excluded"),
        long(1).alias("local_generation"), long(1).alias("remote_generation"), long(0).alias("dirty_generation"),
    )
    alone = docs.where(k.isin(1, 4)).select(
        i.alias("item_id"), long(1).alias("parent_id"), F.when(k == 4, named("A")).otherwise(named("a")).alias("name"), F.lit("file").alias("entry_kind"), plain.alias("local_sha256"), F.col("n").alias("local_size"), F.lit("present").alias("local_status"),
        F.lit("absent").alias("remote_status"), long(1).alias("device"), *[i.alias(c) for c in ("inode", "mtime", "ctime")], F.lit("ready").alias("phase"), F.lit(False).alias("excluded"), long(1).alias("local_generation"), long(0).alias("remote_generation"), long(1).alias("dirty_generation"),
    )
    root = spark.range(1, 2).select(F.col("id").alias("item_id"), F.lit("").alias("name"), F.lit("directory").alias("entry_kind"), F.lit("r1").alias("remote_id"), F.lit("present").alias("local_status"), F.lit("present").alias("remote_status"), F.lit("committed").alias("phase"), F.lit(False).alias("excluded"), *[long(0).alias(c) for c in ("local_generation", "remote_generation", "dirty_generation")])
    items = settled.unionByName(alone, allowMissingColumns=True).unionByName(root, allowMissingColumns=True)

    def far(rows: DataFrame, remote: Column, name: Column, sha: Column, parent: Column = F.lit("r1"), version: int = 4, folder: bool = False) -> DataFrame:
        return rows.select(remote.alias("remote_id"), name.alias("name"), parent.alias("parent_remote"), sha.alias("sha256"), F.col("n").alias("size"), long(version).alias("version"), F.lit(False).alias("removed"), F.lit(False).alias("trashed"), F.lit("inside").alias("scope"), F.lit(True).alias("placeable"), F.lit(folder).alias("is_directory"))

    either = F.when(odd, there).otherwise(plain)
    seen = [
        far(docs.where(k == 1), named("o"), named("a"), either),
        far(docs.where(k == 2), named("o"), named("b"), either),
        far(docs.where(k == 3), named("o"), named("d"), string, folder=True),
        far(docs.where(k == 3), named("p"), named("e"), plain, parent=named("o")),
        far(docs.where(k == 4), named("o"), named("a"), plain),
        far(docs.where(k == 7), named("o"), named("c"), plain),
        far(docs.where(k == 7), named("q"), named("c"), there),
        far(docs.where(k == 8), named("r"), named("f", i + 1), there),
        far(docs.where((k == 9) & odd), named("r"), named("f"), there),
    ]
    found = seen[0]
    for more in seen[1:]:
        found = found.unionByName(more)

    def near(at: Column, name: Column, inode: Column = i, changed: int = 0, held: str = "text", folder: bool = False) -> Column:
        return F.when(at, F.struct(name.alias("name"), inode.alias("inode"), (i + changed).alias("mtime"), F.lit(held).alias("held"), F.lit(folder).alias("is_directory")))

    places = F.array_compact(F.array(
        near(k == 0, named("f"), i + 10_000_000, 1, "edited"),
        near(k.isin(1, 2), F.when(k == 1, named("a")).otherwise(named("b"))),
        near((k == 3) & odd, named("d"), folder=True),
        near(k == 4, named("A")),
        near(k == 5, named("f"), i, 1, "unread"),
        near(k == 6, named("m")),
        near((k == 6) & odd, named("f"), i + 10_000_000, 1, "edited"),
        near(k.isin(8, 9), named("f")),
    ))
    content = F.when(F.col("at.held") == "text", F.col("text")).when(F.col("at.held") == "edited", F.concat("text", F.lit("L")))
    scan = texts.select("*", F.explode(places).alias("at")).select(long(1).alias("parent_id"), "at.name", long(1).alias("device"), "at.inode", "at.mtime", i.alias("ctime"), F.col("n").alias("size"), content.alias("content"), "at.is_directory")
    conflicts = docs.where((k == 9) & odd).select(named("r").alias("remote_id"))
    return rounds.run(items, found, scan, lambda changed: changed.withColumn("sha256", digest(F.col("content"))), conflicts=conflicts)


@query(
    _CASES
    + """, f AS (
SELECT 'f' || i AS name, '' AS parent, 'file' AS entry_kind, 'r' || i AS remote_id, s AS base_sha256, 'present' AS local_status, l AS local_sha256, 'present' AS remote_status, s AS remote_sha256, 'blocked' AS phase, 1 AS dirty_generation, 'safetyBlocked' AS work FROM d WHERE k = 0
UNION ALL SELECT 'a' || i, '', 'file', 'o' || i, CASE WHEN NOT odd THEN s END, 'present', s, 'present', CASE WHEN odd THEN r ELSE s END, CASE WHEN odd THEN 'ready' ELSE 'committed' END, CASE WHEN odd THEN 3 ELSE 0 END, CASE WHEN odd THEN 'conflict' END FROM d WHERE k = 1
UNION ALL SELECT 'b' || i, '', 'file', 'o' || i, CASE WHEN NOT odd THEN s END, 'present', s, 'present', CASE WHEN odd THEN r ELSE s END, CASE WHEN odd THEN 'ready' ELSE 'committed' END, CASE WHEN odd THEN 2 ELSE 0 END, CASE WHEN odd THEN 'conflict' END FROM d WHERE k = 2
UNION ALL SELECT 'd' || i, '', 'directory', 'o' || i, NULL, CASE WHEN odd THEN 'present' ELSE 'absent' END, NULL, 'present', NULL, CASE WHEN odd THEN 'committed' ELSE 'ready' END, CASE WHEN odd THEN 0 ELSE 1 END, CASE WHEN NOT odd THEN 'createDirectory' END FROM d WHERE k = 3
UNION ALL SELECT 'e' || i, 'd' || i, 'file', 'p' || i, NULL, 'absent', NULL, 'present', s, 'ready', 1, 'download' FROM d WHERE k = 3
UNION ALL SELECT 'A' || i, '', 'file', NULL, NULL, 'present', s, 'absent', NULL, 'ready', 2, 'upload' FROM d WHERE k = 4
UNION ALL SELECT 'f' || i, '', 'file', 'r' || i, s, 'unknown', s, 'present', s, 'waitingEvidence', 1, NULL FROM d WHERE k = 5
UNION ALL SELECT 'm' || i, '', 'file', CASE WHEN NOT odd THEN 'r' || i END, CASE WHEN NOT odd THEN s END, 'present', s, CASE WHEN odd THEN 'absent' ELSE 'present' END, CASE WHEN NOT odd THEN s END, CASE WHEN odd THEN 'ready' ELSE 'committed' END, CASE WHEN odd THEN 1 ELSE 0 END, CASE WHEN odd THEN 'upload' END FROM d WHERE k = 6
UNION ALL SELECT 'f' || i, '', 'file', 'r' || i, s, 'present', l, 'present', s, 'blocked', 1, 'safetyBlocked' FROM d WHERE k = 6 AND odd
UNION ALL SELECT 'c' || i, '', 'file', 'o' || i, NULL, 'absent', NULL, 'present', s, 'ready', 1, 'download' FROM d WHERE k = 7
UNION ALL SELECT 'f' || i, '', 'file', 'r' || i, s, 'present', s, 'present', s, 'committed', 0, NULL FROM d WHERE k IN (8, 9)
UNION ALL SELECT '', NULL, 'directory', 'r1', NULL, 'present', NULL, 'present', NULL, 'committed', 0, NULL)
SELECT * REPLACE (dirty_generation::BIGINT AS dirty_generation) FROM f"""
)
def merged_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All items after a round over ``documents``, with what is to be done: one item for each place and object.

    By the last digit of a row: 0 saved by replacement (another inode); 1 local only, adopted by a remote
    object; 2 new on both sides; 3 a new remote folder with a file in it; 4 a remote name that differs in
    case only; 5 not readable; 6 moved, in odd tens with a new file at its old place; 7 two remote objects
    of one name; 8 moved far away onto the name of 9; 9 at rest, in odd tens in conflict.
    """
    done = _round(spark, sf_dir)
    above = done.items.select(F.col("item_id").alias("parent_id"), F.col("name").alias("parent"))
    return spread(done.items, above, "parent_id", "item_id", "left").join(done.work.select("item_id", "work"), "item_id", "left").select(*_ITEM_COLUMNS, "work")


@query(
    _CASES
    + """SELECT CASE k WHEN 7 THEN 'q' WHEN 4 THEN 'o' ELSE 'r' END || i AS remote_id, 'queued' AS state, CASE WHEN k IN (4, 7, 8) THEN 'the name is taken: ' || CASE k WHEN 4 THEN 'a' || i WHEN 7 THEN 'c' || i ELSE 'f' || (i + 1) END END AS message
FROM d WHERE k = 4 OR k = 7 OR (k = 8 AND (i + 1 IN (SELECT i FROM d))) OR (k = 9 AND odd) UNION ALL SELECT 'o' || i, 'listing', NULL FROM d WHERE k = 3"""
)
def merged_round_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such a round leaves open: observations that stay queued, with their issue, and directories to list."""
    done = _round(spark, sf_dir)
    queued = done.queued.select("remote_id", F.lit("queued").alias("state")).join(done.issues.select(F.col("subject").alias("remote_id"), "message"), "remote_id", "left")
    return queued.unionByName(done.listings.select("remote_id", F.lit("listing").alias("state"), F.lit(None).cast("string").alias("message")))
