"""Queries of one round: what is dirty, held back, planned, listed, ordered and committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import issues as meaning
from concordat.functions import paths
from concordat.functions.text import digest, epoch_seconds, range_digest
from concordat.operators import cleanup, conflicts, diff, feed, gates, metrics, operations, pacing, reconcile, rounds, store, tree
from concordat.sources.workspace import shuffled

from .feeds import EVENTS, events
from .registry import query, table
from .sides import CONFLICTS, _conflicts

OBJECTS = """
WITH RECURSIVE i AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey > 1 THEN p_partkey // 4 END AS parent_id, p_partkey % 2 AS root_of, 'n' || p_partkey AS name, 'r' || p_partkey AS remote_id, p_size AS size,
 CASE WHEN p_size % 6 = 0 THEN 'blocked' WHEN p_size % 6 = 1 THEN 'waitingEvidence' ELSE 'ready' END AS phase, CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'present' END AS remote_status, p_size % 10 = 3 AS excluded,
 p_size % 3 AS local_generation, p_size % 5 AS remote_generation, p_size % 4 AS dirty_generation FROM part)
"""


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as stored items: a tree with parent = key div 4 below the entries 0 and 1."""
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k.alias("item_id"), F.when(k > 1, F.floor(k / 4)).alias("parent_id"), F.concat(F.lit("n"), k).alias("name"), F.concat(F.lit("r"), k).alias("remote_id"), size.alias("size"),
        F.when(size % 6 == 0, "blocked").when(size % 6 == 1, "waitingEvidence").otherwise("ready").alias("phase"), F.when(size % 4 == 0, "unknown").otherwise("present").alias("remote_status"), (size % 10 == 3).alias("excluded"),
        (size % 3).alias("local_generation"), (size % 5).alias("remote_generation"), (size % 4).alias("dirty_generation"),
    )


@query(OBJECTS + "SELECT item_id FROM i WHERE dirty_generation > 0 AND phase <> 'blocked'")
def dirty_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.dirty(objects(spark, sf_dir)).select("item_id")


@query("SELECT s_suppkey AS root_id, o.item_id FROM supplier JOIN (SELECT p_partkey AS item_id, p_partkey % 7 AS root_id FROM part WHERE p_size = 9) o ON o.root_id = s_suppkey WHERE s_suppkey % 2 = 0")
def root_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("root_id"), (F.col("s_suppkey") % 2 == 0).alias("is_active"))
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), (F.col("p_partkey") % 7).alias("root_id"), F.when(F.col("p_size") != 9, 1).alias("parent_id"))
    return cleanup.root_entries(roots, items).select("root_id", "item_id")


PLANS = (
    OBJECTS
    + """, t AS (SELECT item_id, '' AS path FROM i WHERE parent_id IS NULL UNION ALL SELECT i.item_id, CASE WHEN t.path = '' THEN i.name ELSE t.path || '/' || i.name END FROM i JOIN t ON i.parent_id = t.item_id),
w AS (SELECT p_partkey * 7 AS item_id, 1 AS lg, 1 AS rg, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 3 END AS dg FROM part WHERE p_size > 20),
p AS (SELECT w.item_id, CASE WHEN i.item_id IS NULL OR i.item_id % 9 = 4 THEN 'notFound' WHEN local_generation = lg AND remote_generation = rg AND dirty_generation = dg THEN 'ready' ELSE 'stale' END AS state, t.path,
 CASE WHEN i.item_id % 9 <> 4 THEN i.remote_id END AS remote_id FROM w LEFT JOIN i USING (item_id) LEFT JOIN t USING (item_id))
"""
)


def _plans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = objects(spark, sf_dir).withColumn("root_id", F.when(F.col("item_id") % 9 == 4, 2).otherwise(1))
    roots = spark.createDataFrame([(1, "/a", "ra", True), (2, "/b", "rb", False)], "root_id int, root_path string, remote_root_id string, is_active boolean")
    k = F.col("p_partkey")
    wanted = table(spark, sf_dir, "part").where("p_size > 20").select((k * 7).alias("item_id"), F.lit(1).alias("local_generation"), F.lit(1).alias("remote_generation"), F.when(k % 2 == 0, 1).otherwise(3).alias("dirty_generation"))
    return cleanup.plans(wanted, items, roots), items


@query(PLANS + "SELECT item_id, state, path, remote_id FROM p")
def cleanup_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plans(spark, sf_dir)[0].select("item_id", "state", "path", "remote_id")


@query(
    PLANS
    + """, r AS (SELECT item_id FROM p WHERE state = 'ready'),
u AS (SELECT item_id, item_id AS node_id, 0::BIGINT AS depth, '' AS path FROM r UNION ALL SELECT u.item_id, i.item_id, u.depth + 1, CASE WHEN u.path = '' THEN i.name ELSE u.path || '/' || i.name END FROM i JOIN u ON i.parent_id = u.node_id)
SELECT u.*, CASE WHEN node_id % 5 = 0 THEN '/kept/' || node_id END AS conflict_path FROM u"""
)
def cleanup_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the ready plans remove, with the conflict copies that go too."""
    plans, items = _plans(spark, sf_dir)
    nodes = cleanup.plan_nodes(plans, items)
    held = items.where("item_id % 5 = 0").select("item_id", F.concat(F.lit("/kept/"), "item_id").alias("conflict_path"))
    paths_ = cleanup.conflict_paths(nodes, held).withColumn("node_id", F.substring("conflict_path", 7, 20).cast("bigint"))
    return nodes.join(shuffled(paths_), ["item_id", "node_id"], "left").select("item_id", "node_id", F.col("depth").cast("bigint").alias("depth"), "path", "conflict_path")


@query("SELECT o_custkey * 2 AS id, c_name AS name, CASE WHEN c_custkey IS NULL THEN 'notFound' ELSE 'found' END AS outcome FROM (SELECT DISTINCT o_custkey FROM orders) LEFT JOIN customer ON c_custkey = o_custkey * 2")
def object_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select((F.col("o_custkey") * 2).alias("id")).distinct()
    return feed.lookup(wanted, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), "id")


@query("SELECT o_custkey AS item_id, c_name FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') JOIN customer ON c_custkey = o_custkey")
def staged_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item_id"), "c_name")
    return operations.staged_items(items, table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("item_id")), "item_id")


@query(
    OBJECTS
    + """, q AS (SELECT 'r' || (user_id % 90) AS remote_id, 'r' || (user_id % 50) AS parent_remote, 'n' || event_id AS name_key FROM events WHERE event_type = 'error')
SELECT item_id AS id FROM i WHERE (phase = 'waitingEvidence' AND remote_status = 'unknown') OR excluded UNION SELECT item_id FROM i JOIN q USING (remote_id)
UNION SELECT i.item_id FROM q JOIN i p ON p.remote_id = q.parent_remote JOIN i ON i.parent_id = p.item_id AND i.name = q.name_key
UNION SELECT item_id FROM i JOIN nation ON remote_id = 'r' || (n_nationkey * 3) WHERE n_regionkey = 2 UNION SELECT s_suppkey FROM supplier"""
)
def waiting_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run may not touch: the union of six sources."""
    items = objects(spark, sf_dir).withColumn("name_key", F.col("name"))
    error = table(spark, sf_dir, "events").where("event_type = 'error'")
    r = lambda n: F.concat(F.lit("r"), n)
    inbox = error.select(r(F.col("user_id") % 90).alias("remote_id"), r(F.col("user_id") % 50).alias("parent_remote"), F.concat(F.lit("n"), "event_id").alias("name_key"))
    scans = table(spark, sf_dir, "nation").select(r(F.col("n_nationkey") * 3).alias("remote_id"), F.when(F.col("n_regionkey") == 2, "pending").otherwise("complete").alias("state"))
    return gates.waiting(items, inbox, scans, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id")))


@query("""
WITH w AS (SELECT s_suppkey AS folder_id, s_nationkey AS root_id, 'data/' || (s_suppkey % 9) || '/x' AS path FROM supplier), c AS (SELECT n_nationkey AS root_id, 'data/' || (n_nationkey % 12) || CASE n_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN '/x' ELSE '/x/y/z' END AS path FROM nation)
SELECT DISTINCT folder_id, w.root_id FROM w JOIN c ON w.root_id <> c.root_id AND (w.path = c.path OR starts_with(w.path, c.path || '/') OR starts_with(c.path, w.path || '/'))""")
def folder_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    wanted = table(spark, sf_dir, "supplier").select(s.alias("folder_id"), F.col("s_nationkey").alias("root_id"), F.concat(F.lit("data/"), s % 9, F.lit("/x")).alias("path"))
    claimed = table(spark, sf_dir, "nation").select(n.alias("root_id"), F.concat(F.lit("data/"), n % 12, F.when(n % 3 == 0, "").when(n % 3 == 1, "/x").otherwise("/x/y/z")).alias("path"))
    return gates.claims(wanted, claimed, "folder_id", "root_id")


@query(r"""
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 6 = 0 THEN 2 ELSE 1 END AS inode FROM documents)
SELECT doc_id, CASE WHEN inode = 1 THEN sha256(text) END AS sha256, sha256(regexp_replace(text, '[^\x00-\x7f]', '?', 'g')[11:30]) AS head_sha256 FROM d""")
def trusted_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests that count because the file did not change while it was read, and digests of a range."""
    one = F.lit(1)
    observed = {f"{side}_{c}": one for side in ("before", "after") for c in ("device", "inode", "mtime", "ctime", "size")}
    docs = table(spark, sf_dir, "documents").withColumns(observed | {"after_inode": F.when(F.col("doc_id") % 6 == 0, 2).otherwise(1)})
    plain = F.regexp_replace("text", "[^\\x00-\\x7f]", "?")
    return docs.select("doc_id", diff.trusted_digest("before", "after", digest(F.col("text"))).alias("sha256"), range_digest(plain, F.lit(10), F.lit(20)).alias("head_sha256"))


@query(
    EVENTS
    + """, m AS (SELECT *, event_type = 'error' AS d, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS segment FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 AS alone FROM m WHERE NOT d)
SELECT event_id, segment::BIGINT AS segment, CASE WHEN alone THEN -1 ELSE (row_number() OVER (PARTITION BY user_id, segment, alone ORDER BY event_id) - 1) // 4 END::BIGINT AS chunk FROM f"""
)
def observation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = events(spark, sf_dir).withColumn("is_directory", F.col("event_type") == "error")
    return metrics.observation_batches(entries, ["user_id"], ["event_id"], "is_directory", 4).select("event_id", "segment", "chunk")


@query(EVENTS + "SELECT event_id AS id, row_number() OVER (PARTITION BY user_id % 2, k % 3 ORDER BY at_us, event_id) AS place, at_us / 1e6 AS began FROM e")
def transfer_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select(F.col("event_id").alias("id"), (F.col("user_id") % 2).alias("direction"), (F.col("k") % 3).alias("state"), epoch_seconds(F.timestamp_micros("at_us")).alias("began"))
    return metrics.transfers_in_order(own).select("id", F.col("place").cast("bigint").alias("place"), "began")


@query(r"""
WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), d AS (SELECT path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM p)
SELECT path, row_number() OVER (ORDER BY depth, path) AS create_turn, row_number() OVER (ORDER BY depth DESC, path) AS delete_turn, row_number() OVER (ORDER BY length(path) DESC, path) AS unlink_turn FROM d""")
def path_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders in the orders in which they are created, deleted and unlinked."""
    own = table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")).distinct()
    create = tree.by_depth(own, False).withColumnRenamed("turn", "create_turn")
    delete = tree.by_depth(own, True).withColumnRenamed("turn", "delete_turn")
    return create.join(delete, "path").join(tree.longest_first(own).withColumnRenamed("turn", "unlink_turn"), "path")


@query("WITH o AS (SELECT o_orderkey AS operation_id, epoch_us(o_orderdate) AS created_at FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderkey % 3 = 0) SELECT operation_id, row_number() OVER (ORDER BY created_at, operation_id) AS turn FROM o")
def replay_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") == "O", "inFlight").when(F.col("o_orderstatus") == "P", "verify").otherwise("completed")
    kind = F.when(F.col("o_orderkey") % 3 == 0, "trashRemote").otherwise("uploadMultipart")
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("created_at"), state.alias("state"), kind.alias("operation_type"))
    return operations.to_replay(own, ("trashRemote", "deleteLocal")).select("operation_id", "turn")


@query(CONFLICTS + "SELECT conflict_id, row_number() OVER (ORDER BY relative_path, conflict_id) AS place FROM c")
def conflict_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pacing.numbered(_conflicts(spark, sf_dir)[2].select("conflict_id", "relative_path"), conflicts.LISTED_BY, 1, ident="place").select("conflict_id", "place")


@query("SELECT doc_id AS item_id, row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id)::BIGINT AS link FROM documents")
def inode_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.lit(1).alias("device"), F.floor(F.col("doc_id") / 4).alias("inode"))
    return diff.links_in_order(items).select("item_id", F.col("link").cast("bigint").alias("link"))


KINDS = [*meaning.MEANING, "server", "general", "other"]


@query(
    EVENTS
    + f""", r AS (SELECT event_id, {KINDS}[k % {len(KINDS)} + 1] AS kind, CASE WHEN event_id % 3 = 0 THEN 401 ELSE 500 END AS status, CASE WHEN event_id % 2 = 0 THEN 'Cursor EXPIRED' ELSE 'x' END AS message FROM e)
SELECT event_id, CASE kind WHEN 'localScan' THEN 'localIO' WHEN 'publicationRecovery' THEN 'localIO' WHEN 'publicationFailed' THEN 'localIO' WHEN 'fileSystem' THEN 'localIO' WHEN 'nameConflict' THEN 'remoteConflict' WHEN 'conflict' THEN 'remoteConflict'
  WHEN 'typeReplacementDeferred' THEN 'staleState' WHEN 'rateLimited' THEN 'rateLimited' WHEN 'notFound' THEN 'remoteMissing' WHEN 'checksumMismatch' THEN 'integrityMismatch' WHEN 'sizeMismatch' THEN 'integrityMismatch' WHEN 'invalidResponse' THEN 'invalidResponse'
  WHEN 'unsafeOverwrite' THEN 'safetyBlocked' WHEN 'stableInputUnavailable' THEN 'unsupportedFilesystem' WHEN 'network' THEN 'network' WHEN 'localFileModified' THEN 'localChanged' WHEN 'server' THEN CASE WHEN status = 401 THEN 'permissionDenied' ELSE 'network' END
  WHEN 'general' THEN CASE WHEN event_id % 2 = 0 THEN 'staleState' ELSE 'unknown' END ELSE 'unknown' END AS category,
 CASE WHEN kind IN ('localScan', 'publicationRecovery', 'stableInputUnavailable', 'publicationFailed', 'fileSystem') THEN 'inspectLocalFile' WHEN kind = 'nameConflict' THEN 'renameRemote' WHEN kind IN ('rateLimited', 'network') OR (kind = 'server' AND status <> 401) THEN 'retryLater'
  WHEN kind = 'unsafeOverwrite' THEN 'resolveManually' WHEN kind = 'server' THEN 'checkPermissions' ELSE 'retry' END AS action, CASE WHEN kind = 'rateLimited' THEN event_id END AS retry_delay FROM r"""
)
def issue_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("k") % len(KINDS)).cast("int"))
    what = (kind, F.when(i % 3 == 0, 401).otherwise(500), F.when(i % 2 == 0, "Cursor EXPIRED").otherwise("x"))
    return events(spark, sf_dir).select("event_id", meaning.category(*what).alias("category"), meaning.action(*what).alias("action"), meaning.retry_delay(kind, i).alias("retry_delay"))


@query("""
WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS remote_id, 7::BIGINT AS version FROM orders WHERE o_orderkey % 4 <> 0),
n AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS remote_id, CASE WHEN o_orderkey % 2 = 0 THEN 9 END::BIGINT AS version FROM orders),
j AS (SELECT n.id, c.id IS NULL AS fresh, c.remote_id IS NULL OR c.remote_id = n.remote_id AS same, c.remote_id AS old_remote, n.remote_id, c.version AS old_version, n.version FROM n LEFT JOIN c USING (id))
SELECT id, CASE WHEN fresh OR same THEN remote_id ELSE old_remote END AS remote_id, CASE WHEN fresh THEN version WHEN same THEN coalesce(version, old_version) ELSE old_version END AS version, CASE WHEN fresh THEN 'inserted' WHEN same THEN 'updated' ELSE 'refused' END AS effect FROM j""")
def upsert_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of another remote object are refused; a version that is not known keeps the stored one."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    current = orders.where("o_orderkey % 4 <> 0").select(k.alias("id"), F.when(k % 3 != 0, F.col("o_custkey")).alias("remote_id"), F.lit(7).cast("bigint").alias("version"))
    new = orders.select(k.alias("id"), (F.col("o_custkey") + F.when(k % 5 == 0, 1).otherwise(0)).alias("remote_id"), F.when(k % 2 == 0, 9).cast("bigint").alias("version"))
    guard = F.col("remote_id").isNull() | (F.col("remote_id") == F.col("new_remote_id"))
    return store.upsert(current, new, ["id"], keep_known=("version",), guard=guard)


@query("SELECT page_id, regexp_matches(name, '^(a|a/b|b)$') AS below FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN '../x' WHEN 3 THEN 'a/../b' ELSE '' END AS given, CASE page_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 3 THEN 'b' ELSE '..' END AS name FROM pages)")
def destination_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    given = F.when(k == 0, "a").when(k == 1, "a/b").when(k == 2, "../x").when(k == 3, "a/../b").otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", paths.stays_below(F.lit("/data/root"), given).alias("below"))


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id, 'n' || p_partkey AS name, p_size % 5 <> 0 AS is_directory FROM part),
t AS (SELECT id, parent_id, name, is_directory, name AS path, 1 AS depth FROM n WHERE parent_id = 0 UNION ALL SELECT n.id, n.parent_id, n.name, n.is_directory, t.path || '/' || n.name, t.depth + 1 FROM n JOIN t ON n.parent_id = t.id WHERE t.is_directory)
SELECT id, parent_id, name, is_directory, path, depth FROM t""")
def listed_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that listings lead to from the root, one level in each job."""
    k = F.col("p_partkey")
    children = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 4)).alias("parent_id"), F.concat(F.lit("n"), k).alias("name"), (F.col("p_size") % 5 != 0).alias("is_directory"))
    start = spark.createDataFrame([(0,)], "id long")
    return tree.traverse(start, lambda folders: children.join(folders.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi"))


@query(
    CONFLICTS
    + """, s AS (SELECT c.*, CASE WHEN item_id % 3 = 0 THEN 'none' WHEN item_id % 5 = 0 THEN 'removed' WHEN item_id % 7 = 0 THEN 'trashed' WHEN item_id % 11 = 0 THEN 'bad' ELSE 'whole' END AS s, j.text FROM c JOIN j ON j.doc_id = c.item_id)
SELECT d.doc_id AS item_id, CASE WHEN s = 'whole' THEN sha256(s.text || 'n') END AS remote_sha256, CASE s WHEN 'removed' THEN 'absent' WHEN 'trashed' THEN 'trashed' ELSE 'present' END AS remote_status,
 CASE WHEN s IN ('removed', 'trashed', 'whole') THEN 'blocked' ELSE 'ready' END AS phase, CASE WHEN s IN ('removed', 'trashed', 'whole') THEN 0 ELSE 2 END AS dirty_generation FROM j d LEFT JOIN s ON s.item_id = d.doc_id"""
)
def conflict_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items after their conflicts were refreshed by queued changes."""
    _, labelled, own = _conflicts(spark, sf_dir)
    i = F.col("doc_id")
    none = F.lit(None)
    inbox = labelled.where("doc_id % 3 <> 0").select(
        "root_id", F.concat(F.lit("r"), i).alias("remote_id"), (i % 5 == 0).alias("removed"), ((i % 5 != 0) & (i % 7 == 0)).alias("trashed"), F.when(i % 11 != 0, digest(F.concat("text", F.lit("n")))).alias("sha256"),
        (F.col("n_chars") + 1).alias("size"), F.lit(2).cast("bigint").alias("version"), F.concat(F.lit("n"), i).alias("name"), none.cast("string").alias("parent_remote"), F.lit(False).alias("is_directory"),
    )
    items = labelled.select(
        i.alias("item_id"), F.concat(F.lit("n"), i).alias("remote_name"), none.cast("string").alias("remote_parent"), none.cast("string").alias("remote_sha256"), none.cast("bigint").alias("remote_size"), none.cast("bigint").alias("remote_version"),
        F.lit("present").alias("remote_status"), F.lit("ready").alias("phase"), F.lit(2).alias("dirty_generation"),
    )
    refreshed = conflicts.refresh(own.withColumns({"remote_version": F.lit(1).cast("bigint"), "revision": F.lit(1)}), inbox, items)
    return conflicts.refreshed_items(items, refreshed).select("item_id", "remote_sha256", "remote_status", "phase", "dirty_generation")


@query()
def group_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes by user in commits of at most three, an hour or until an error; sequential, so beyond SQL."""
    own = events(spark, sf_dir).select(F.col("user_id").alias("writer"), F.col("event_id").alias("write"), "at_us", (F.col("event_type") == "error").alias("immediate"))
    return pacing.flushes(own, 3, 3_600_000_000)


@query("""
WITH d AS (SELECT doc_id + 1 AS i, text FROM documents), s AS (SELECT i, i % 11 = 0 AS gone, i % 11 <> 0 AND i % 5 = 0 AS edited, i % 11 <> 0 AND i % 13 = 0 AS moved, i % 7 = 0 AS changed, i % 7 <> 0 AND i % 17 = 0 AS removed, i % 7 <> 0 AND i % 17 <> 0 AND i % 19 = 0 AS trashed FROM d),
k AS (SELECT CASE WHEN moved THEN 'm' ELSE 'f' END || i AS name, CASE
  WHEN gone THEN CASE WHEN trashed THEN 'unchanged' WHEN changed THEN 'conflict' ELSE 'trashRemote' END
  WHEN trashed THEN CASE WHEN edited THEN 'conflict' ELSE 'deleteLocal' END
  WHEN edited AND changed THEN 'conflict' WHEN edited THEN 'upload' WHEN changed THEN 'download' END AS decision FROM s WHERE NOT removed AND i % 29 <> 0)
SELECT name, decision, CASE decision WHEN 'unchanged' THEN 'cleanup' WHEN 'upload' THEN 'safetyBlocked' ELSE decision END AS work FROM k WHERE decision IS NOT NULL
UNION ALL SELECT 'n' || i, 'download', 'download' FROM d WHERE i % 23 = 0""")
def incremental_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a whole round over ``documents`` puts to work: files that were edited, moved or removed on either side."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("i"), "text", F.col("n_chars").cast("bigint").alias("n"))
    i, sha = F.col("i"), digest(F.col("text"))
    fixed = {"entry_kind": "file", "local_status": "present", "remote_status": "present", "phase": "committed", "parent_remote": "r0"}
    numbers = {"parent_id": 0, "device": 1, "remote_version": 1, "local_generation": 1, "remote_generation": 1, "dirty_generation": 0}
    files = docs.select(
        i.alias("item_id"), F.concat(F.lit("f"), i).alias("name"), F.concat(F.lit("r"), i).alias("remote_id"), *[sha.alias(f"{s}_sha256") for s in ("base", "local", "remote")], *[F.col("n").alias(f"{s}_size") for s in ("base", "local", "remote")],
        *[i.alias(c) for c in ("inode", "mtime", "ctime")], F.lit(False).alias("excluded"), *[F.lit(v).alias(c) for c, v in fixed.items()], *[F.lit(v).cast("bigint").alias(c) for c, v in numbers.items()],
    )
    folder = spark.range(1).select(F.col("id").alias("item_id"), F.lit("").alias("name"), F.lit("r0").alias("remote_id"), F.lit("directory").alias("entry_kind"), F.lit("present").alias("local_status"), F.lit("present").alias("remote_status"), F.lit("committed").alias("phase"), F.lit(False).alias("excluded"), *[F.lit(0).cast("bigint").alias(c) for c in ("local_generation", "remote_generation", "dirty_generation")])
    items = files.unionByName(folder, allowMissingColumns=True)

    def observed(rows: DataFrame, letter: str, edit: str) -> DataFrame:
        name = F.concat(F.lit("n" if letter == "n" else "f"), i)
        return rows.select(
            F.concat(F.lit(letter), i).alias("remote_id"), name.alias("name"), F.lit("r0").alias("parent_remote"), digest(F.concat("text", F.lit(edit))).alias("sha256"), F.col("n").alias("size"), F.lit(2).cast("bigint").alias("version"),
            ((i % 7 != 0) & (i % 17 == 0) & (F.lit(letter) == "r")).alias("removed"), ((i % 7 != 0) & (i % 17 != 0) & (F.lit(letter) == "r")).alias("trashed"), F.lit("inside").alias("scope"), F.lit(True).alias("placeable"),
        )

    seen = observed(docs.where("i % 7 = 0 or i % 17 = 0 or i % 19 = 0"), "r", "R").unionByName(observed(docs.where("i % 23 = 0"), "n", "N"))
    scan = docs.where("i % 11 <> 0").select(
        F.lit(0).cast("bigint").alias("parent_id"), F.concat(F.when(i % 13 == 0, "m").otherwise("f"), i).alias("name"), F.lit(1).cast("bigint").alias("device"), i.alias("inode"), (i + F.when(i % 5 == 0, 1).otherwise(0)).alias("mtime"), i.alias("ctime"),
        F.col("n").alias("size"), F.when(i % 5 == 0, F.concat("text", F.lit("L"))).otherwise(F.col("text")).alias("content"),
    )
    gate = docs.where("i % 29 = 0").select(i.alias("item_id"))
    after, work, _ = rounds.incremental(items, seen, scan, lambda changed: changed.withColumn("sha256", digest(F.col("content"))), gate)
    return work.join(after.select("item_id", "name"), "item_id").select("name", "decision", "work")
