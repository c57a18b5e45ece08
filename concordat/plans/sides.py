"""Reconciliation, diff and conflict queries over three derived sides of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions.text import cache_key, conflict_key, digest
from concordat.operators import conflicts, diff, gates, reconcile

from .registry import query, table


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Baseline, local and remote rows of every document; states follow from the id."""
    docs = table(spark, sf_dir, "documents")
    every = lambda n: F.col("doc_id") % n == 0
    text = F.col("text")
    base = docs.where(~every(11)).select("doc_id", digest(text).alias("base_sha256"), F.col("n_chars").alias("base_size"))
    status = F.when(every(13), "unstable").when(every(17), "unknown").when(every(7), "absent").otherwise("present")
    local = docs.where(~every(37)).select("doc_id", status.alias("local_status"), F.when(status == "present", digest(F.when(every(5), F.concat(text, F.lit("L"))).otherwise(text))).alias("local_sha256"), F.col("n_chars").alias("local_size"))
    status = F.when(every(29), "unknown").when(every(23), "trashed").when(every(8), "absent").otherwise("present")
    edit = F.when(every(15), F.concat(text, F.lit("L"))).when(every(3), F.concat(text, F.lit("R"))).otherwise(text)
    remote = docs.where(~every(41)).select("doc_id", status.alias("remote_status"), F.when((status == "present") & ~every(19), F.upper(digest(edit))).alias("remote_sha256"), F.col("n_chars").alias("remote_size"))
    return base, local, remote


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.align(*sides(spark, sf_dir), "doc_id")


ALIGNED = """
WITH b AS (SELECT doc_id, sha256(text) AS base_sha256, n_chars AS base_size FROM documents WHERE doc_id % 11 <> 0),
l0 AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'unstable' WHEN doc_id % 17 = 0 THEN 'unknown' WHEN doc_id % 7 = 0 THEN 'absent' ELSE 'present' END AS local_status FROM documents WHERE doc_id % 37 <> 0),
l AS (SELECT doc_id, local_status, CASE WHEN local_status = 'present' THEN sha256(CASE WHEN doc_id % 5 = 0 THEN text || 'L' ELSE text END) END AS local_sha256, n_chars AS local_size FROM l0),
r0 AS (SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'unknown' WHEN doc_id % 23 = 0 THEN 'trashed' WHEN doc_id % 8 = 0 THEN 'absent' ELSE 'present' END AS remote_status FROM documents WHERE doc_id % 41 <> 0),
r AS (SELECT doc_id, remote_status, CASE WHEN remote_status = 'present' AND doc_id % 19 <> 0 THEN upper(sha256(CASE WHEN doc_id % 15 = 0 THEN text || 'L' WHEN doc_id % 3 = 0 THEN text || 'R' ELSE text END)) END AS remote_sha256, n_chars AS remote_size FROM r0),
a AS (SELECT doc_id, base_sha256, base_size, coalesce(local_status, 'unknown') AS ls, local_sha256, local_size, coalesce(remote_status, 'unknown') AS rs, remote_sha256, remote_size
      FROM b FULL JOIN l USING (doc_id) FULL JOIN r USING (doc_id)),
w AS (SELECT *, CASE WHEN ls = 'unstable' THEN 'Local file body is unstable, writing'
      WHEN ls = 'unknown' AND rs = 'unknown' THEN 'Observation status unknown at both ends'
      WHEN ls = 'unknown' THEN 'Local observation status is unknown, no evidence decision is rejected'
      WHEN rs = 'unknown' THEN 'The remote observation status is unknown, refuse to make an unsubstantiated decision'
      WHEN ls = 'present' AND coalesce(local_sha256, '') = '' THEN 'Local file body SHA-256 To be acquired'
      WHEN rs = 'present' AND coalesce(remote_sha256, '') = '' THEN 'Remote file body SHA-256 To be acquired' END AS wait,
      lower(local_sha256) AS lh, lower(remote_sha256) AS rh, lower(base_sha256) AS bh FROM a),
d AS (SELECT *, CASE WHEN wait IS NOT NULL THEN 'waitingEvidence'
      WHEN bh IS NULL THEN CASE WHEN ls = 'present' AND rs = 'absent' THEN 'upload' WHEN rs = 'present' AND ls = 'absent' THEN 'download'
        WHEN ls = 'present' AND rs = 'present' THEN CASE WHEN lh = rh THEN 'matchUpdateBaseline' ELSE 'conflict' END
        WHEN ls = 'absent' THEN 'unchanged' ELSE 'keepModified' END
      WHEN ls = 'absent' AND rs IN ('absent', 'trashed') THEN 'unchanged'
      WHEN ls = 'absent' THEN CASE WHEN rh <> bh THEN 'conflict' ELSE 'trashRemote' END
      WHEN rs IN ('absent', 'trashed') THEN CASE WHEN lh <> bh THEN 'conflict' ELSE 'deleteLocal' END
      WHEN lh <> bh AND rh = bh THEN 'upload' WHEN lh = bh AND rh <> bh THEN 'download' WHEN lh = bh THEN 'unchanged'
      WHEN lh = rh THEN 'matchUpdateBaseline' ELSE 'conflict' END AS decision FROM w),
decided AS (SELECT *, coalesce(wait, CASE decision WHEN 'upload' THEN CASE WHEN bh IS NULL THEN 'New local file' ELSE 'Only local content changed' END
      WHEN 'download' THEN CASE WHEN bh IS NULL THEN 'New remote file' ELSE 'Only remote content changed' END END) AS reason,
      CASE WHEN decision = 'matchUpdateBaseline' THEN lh END AS sha256, CASE WHEN decision = 'matchUpdateBaseline' THEN coalesce(local_size, 0) END AS size,
      CASE WHEN decision = 'keepModified' THEN true END AS prefer_local FROM d)
"""


@query(ALIGNED + "SELECT doc_id, decision, reason, sha256, size, prefer_local FROM decided")
def reconcile_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.decide(aligned(spark, sf_dir)).select("doc_id", "decision", "reason", "sha256", "size", "prefer_local")


@query(ALIGNED + "SELECT decision, count(*) AS n, coalesce(sum(local_size), 0)::BIGINT AS local_bytes, count(reason) AS with_reason FROM decided GROUP BY decision")
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summary(reconcile.decide(aligned(spark, sf_dir)))


@query(
    ALIGNED
    + """SELECT doc_id,
 coalesce(ls = 'present' AND lh <> bh, false)::BIGINT AS local_changed, coalesce(rs = 'present' AND rh <> bh, false)::BIGINT AS remote_changed,
 coalesce(ls = 'present' AND lh = bh, false)::BIGINT AS local_same, coalesce(rs = 'present' AND rh = bh, false)::BIGINT AS remote_same,
 (ls = 'absent')::BIGINT AS local_gone, (rs IN ('absent', 'trashed'))::BIGINT AS remote_gone FROM d"""
)
def change_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reconcile.decide(aligned(spark, sf_dir))
    return df.select("doc_id", *[F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in reconcile.changes().items()])


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = reconcile.decide(aligned(spark, sf_dir))
    return df.withColumns({
        "remote_id": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("r"), F.col("doc_id"))), "pending_create": F.when(F.col("doc_id") % 6 == 0, F.lit("op")),
        "phase": F.lit("ready"), "dirty_generation": F.lit(1), "parent_ready": F.col("doc_id") % 9 != 0,
        "path": F.concat_ws("/", F.lit("documents"), (F.col("doc_id") % 4).cast("string"), F.col("doc_id").cast("string")),
    })


APPLIED = (
    ALIGNED
    + """, p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END AS remote_id, CASE WHEN doc_id % 6 = 0 THEN 'op' END AS pending FROM decided),
g AS (SELECT *, decision IN ('upload', 'keepModified') AS sends, decision IN ('upload', 'keepModified') AND remote_id IS NOT NULL AND pending IS NULL AS guarded,
      decision = 'matchUpdateBaseline' AS matched, decision = 'unchanged' AND ls = 'absent' AND rs = 'trashed' AS cleanup, decision IN ('matchUpdateBaseline', 'unchanged') AS settled FROM p),
applied AS (SELECT doc_id, CASE WHEN matched THEN sha256 ELSE base_sha256 END AS new_base_sha256, CASE WHEN matched THEN size ELSE base_size END AS new_base_size,
 CASE WHEN matched THEN 'present' ELSE ls END AS new_local_status, CASE WHEN matched THEN 'present' ELSE rs END AS new_remote_status,
 CASE WHEN guarded THEN 'blocked' WHEN settled AND NOT cleanup THEN 'committed' ELSE 'ready' END AS new_phase, CASE WHEN settled AND NOT cleanup THEN 0 ELSE 1 END::BIGINT AS new_dirty_generation,
 CASE WHEN guarded THEN 'safetyBlocked' WHEN cleanup THEN 'cleanup' WHEN sends THEN 'upload' WHEN decision IN ('download', 'trashRemote', 'deleteLocal', 'conflict') THEN decision END AS work,
 CASE WHEN decision = 'conflict' THEN coalesce(nullif(remote_sha256, ''), base_sha256) END AS conflict_sha256,
 CASE WHEN decision = 'conflict' THEN CASE WHEN coalesce(remote_sha256, '') <> '' THEN remote_size ELSE base_size END END AS conflict_size, base_sha256, base_size, ls, rs FROM g)
"""
)
_NEW = ["new_base_sha256", "new_base_size", "new_local_status", "new_remote_status", "new_phase", "new_dirty_generation", "work", "conflict_sha256", "conflict_size"]


@query(APPLIED + f"SELECT doc_id, {', '.join(_NEW)} FROM applied")
def reconcile_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.apply_decisions(prepared(spark, sf_dir)).select("doc_id", *_NEW)


@query(
    APPLIED
    + """, c AS (SELECT *, new_phase IN ('committed', 'blocked') AND coalesce(work, 'safetyBlocked') = 'safetyBlocked' AS has, doc_id % 10 = 0 AS moved FROM applied)
SELECT doc_id, CASE WHEN has AND NOT moved THEN new_base_sha256 ELSE base_sha256 END AS base_sha256, CASE WHEN has AND NOT moved THEN new_base_size ELSE base_size END AS base_size,
 CASE WHEN has AND NOT moved THEN new_local_status ELSE ls END AS local_status, CASE WHEN has AND NOT moved THEN new_phase ELSE 'ready' END AS phase,
 CASE WHEN has AND NOT moved THEN new_dirty_generation ELSE 1 + moved::INT END::BIGINT AS dirty_generation, CASE WHEN has THEN CASE WHEN moved THEN 'stale' ELSE 'applied' END END AS outcome FROM c"""
)
def decision_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions committed against rows of which a tenth got new generations meanwhile."""
    decided = prepared(spark, sf_dir).withColumns({"local_generation": F.lit(3), "remote_generation": F.lit(4)})
    applied = reconcile.apply_decisions(decided)
    items = decided.select("doc_id", "base_sha256", "base_size", "local_status", "remote_status", "phase", "local_generation", "remote_generation", (F.col("dirty_generation") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).cast("bigint").alias("dirty_generation"))
    return reconcile.commit_decisions(items, applied, "doc_id").select("doc_id", "base_sha256", "base_size", "local_status", "phase", "dirty_generation", "outcome")


@query(
    ALIGNED
    + """, p AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'upload' ELSE decision END AS decision, CASE WHEN doc_id % 6 = 0 THEN 'Restore persistent small file creation intent' ELSE reason END AS reason,
 'documents/' || (doc_id % 4) || '/' || doc_id AS path FROM decided),
gate AS (SELECT DISTINCT 'documents/' || (p_partkey % 4) || '/' || p_partkey AS path FROM part WHERE p_size > 40 UNION SELECT 'documents/3')
SELECT doc_id, decision, reason FROM p WHERE NOT EXISTS (SELECT 1 FROM gate g WHERE p.path = g.path OR (g.path = 'documents/3' AND p.path LIKE 'documents/3/%'))
 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND doc_id % 9 <> 0 AND decision IN ('upload', 'download', 'keepModified', 'matchUpdateBaseline', 'unchanged')"""
)
def schedule_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat_ws("/", F.lit("documents"), (F.col("p_partkey") % 4).cast("string"), F.col("p_partkey").cast("string")).alias("path"))
    gate = part.unionByName(spark.createDataFrame([("documents/3",)], "path string"))
    running = table(spark, sf_dir, "labels").where("toxic = 1")
    return reconcile.schedule(prepared(spark, sf_dir), gate, running, "doc_id", scanning=True).select("doc_id", "decision", "reason")


@query(
    ALIGNED
    + """SELECT doc_id, CASE WHEN (ls = 'absent' AND rs = 'present') OR (rs = 'trashed' AND ls IN ('present', 'absent')) THEN 'delete'
 WHEN doc_id % 6 = 0 OR ls = 'unknown' OR rs = 'unknown' THEN NULL ELSE 'commit' END AS outcome FROM d"""
)
def directory_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("doc_id", reconcile.directory_outcome(F.col("local_status"), F.col("remote_status"), F.col("pending_create")).alias("outcome"))


@query(
    ALIGNED
    + """, f AS (SELECT doc_id, bh, rh, CASE doc_id % 3 WHEN 0 THEN rh WHEN 1 THEN coalesce(bh, sha256('occupied')) ELSE sha256('occupied') END AS nh FROM decided WHERE decision = 'download')
SELECT doc_id, CASE WHEN bh IS NOT NULL AND nh = bh THEN 'download' WHEN nh = rh THEN 'matchUpdateBaseline' ELSE 'conflict' END AS decision, CASE WHEN bh IS NOT NULL AND nh = bh THEN 'Only remote content changed' END AS reason FROM f"""
)
def redecide_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads that met an occupied place are decided again with a fresh local observation."""
    own = aligned(spark, sf_dir)
    met = reconcile.decide(own).where("decision = 'download'")
    other = F.sha2(F.lit("occupied"), 256)
    found = F.when(F.col("doc_id") % 3 == 0, F.col("remote_sha256")).when(F.col("doc_id") % 3 == 1, F.coalesce("base_sha256", other)).otherwise(other)
    fresh = met.select("doc_id", F.lit("present").alias("local_status"), found.alias("local_sha256"))
    return reconcile.redecide(own, fresh, "doc_id").select("doc_id", "decision", "reason")


@query("""
SELECT source, CASE WHEN known THEN CASE WHEN state = 'existingKnown' THEN 'incremental' WHEN direction = 'remoteToLocalEmpty' THEN direction ELSE 'localToRemoteEmpty' END
 WHEN NOT le AND re THEN 'localToRemoteEmpty' WHEN le AND NOT re THEN 'remoteToLocalEmpty' WHEN le AND re THEN 'emptyBaseline' ELSE 'error' END AS mode
FROM (SELECT source, count(*) % 3 = 0 AS known, CASE WHEN max(doc_id) % 2 = 0 THEN 'existingKnown' ELSE 'freshCreated' END AS state, CASE WHEN min(doc_id) % 2 = 0 THEN 'remoteToLocalEmpty' ELSE 'localToRemoteEmpty' END AS direction,
 count_if(lang = 'de') = 0 AS le, count_if(lang = 'es') = 0 AS re FROM documents GROUP BY source)""")
def route_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots = table(spark, sf_dir, "documents").groupBy("source").agg(
        (F.count("*") % 3 == 0).alias("known"), F.when(F.max("doc_id") % 2 == 0, "existingKnown").otherwise("freshCreated").alias("state"), F.when(F.min("doc_id") % 2 == 0, "remoteToLocalEmpty").otherwise("localToRemoteEmpty").alias("direction"),
        (F.count_if(F.col("lang") == "de") == 0).alias("le"), (F.count_if(F.col("lang") == "es") == 0).alias("re"),
    )
    return roots.select("source", reconcile.route(F.col("known"), F.col("state"), F.col("direction"), F.col("le"), F.col("re")).alias("mode"))


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        i.alias("item_id"), F.lit("file").alias("entry_kind"), F.lit(1).cast("bigint").alias("device"), (i / 2).cast("bigint").alias("inode"), (i * 1_000_000_007).alias("mtime"), (i * 1_000_000_009).alias("ctime"), F.col("n_chars").alias("size"),
        (i % 50).alias("parent_id"), F.concat(F.lit("f"), i).alias("name"), F.when(i % 12 == 0, "inFlight").otherwise("committed").alias("phase"), F.when(i % 14 == 0, 1).otherwise(0).alias("dirty_generation"), F.lit("present").alias("local_status"), digest(F.col("text")).alias("base_sha256"), digest(F.col("text")).alias("local_sha256"), F.lit(0).alias("local_generation"),
    )


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return diff.decoded(table(spark, sf_dir, "documents").where("doc_id % 31 <> 0").select(
        i.alias("scan_id"), F.when(i % 3 > 0, 1).cast("bigint").alias("device"), (i / 2).cast("bigint").alias("inode"), (i * 1_000_000_007).alias("mtime"), (i * 1_000_000_009 + F.when(i % 21 == 0, 1).otherwise(0)).alias("ctime"), F.col("n_chars").alias("size"),
        ((i + F.when(i % 25 == 0, 1).otherwise(0)) % 50).alias("parent_id"), F.concat(F.lit("f"), i).alias("name"), F.lit(1).alias("root_id"), F.lit("file").alias("kind"),
    ))


SCAN = """
WITH st AS (SELECT doc_id AS item_id, 1 AS device, doc_id // 2 AS inode, doc_id * 1000000007 AS mtime, doc_id * 1000000009 AS ctime, n_chars AS size, doc_id % 50 AS parent_id, 'f' || doc_id AS name,
 doc_id % 12 <> 0 AND doc_id % 14 <> 0 AS ok FROM documents),
sc AS (SELECT doc_id AS scan_id, 1 AS device, doc_id // 2 AS inode, doc_id * 1000000007 AS mtime, doc_id * 1000000009 + CASE WHEN doc_id % 21 = 0 THEN 1 ELSE 0 END AS ctime, n_chars AS size,
 (doc_id + CASE WHEN doc_id % 25 = 0 THEN 1 ELSE 0 END) % 50 AS parent_id, 'f' || doc_id AS name FROM documents WHERE doc_id % 31 <> 0)
"""
_SAME = "st.ok AND st.device = sc.device AND st.inode = sc.inode AND st.mtime = sc.mtime AND st.ctime = sc.ctime AND st.size = sc.size"


@query(SCAN + f"SELECT scan_id, parent_id, name FROM sc WHERE EXISTS (SELECT 1 FROM st WHERE {_SAME} AND st.parent_id = sc.parent_id AND st.name = sc.name)")
def fast_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.unchanged(scanned(spark, sf_dir), stored(spark, sf_dir)).select("scan_id", "parent_id", "name")


@query(SCAN + f"SELECT scan_id, parent_id, name FROM sc WHERE NOT EXISTS (SELECT 1 FROM st WHERE {_SAME} AND st.parent_id = sc.parent_id AND st.name = sc.name)")
def changed_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.changed(scanned(spark, sf_dir), stored(spark, sf_dir)).select("scan_id", "parent_id", "name")


@query(SCAN + ", f AS (SELECT * FROM st WHERE ok QUALIFY row_number() OVER (PARTITION BY device, inode ORDER BY item_id) = 1) SELECT scan_id FROM sc WHERE EXISTS (SELECT 1 FROM f st WHERE " + _SAME + ")")
def fast_skip_first_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.unchanged_anywhere(scanned(spark, sf_dir), stored(spark, sf_dir)).select("scan_id")


@query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, doc_id % 50 AS parent_id, 'f' || doc_id AS name FROM documents),
st AS (SELECT doc_id AS item_id, h, parent_id, name FROM d), sc AS (SELECT doc_id AS scan_id, h, parent_id, CASE WHEN doc_id % 4 = 0 THEN 'moved' || doc_id ELSE name END AS name FROM d),
ex AS (SELECT scan_id, min(item_id) AS item_id FROM sc JOIN st USING (h, parent_id, name) GROUP BY scan_id),
one AS (SELECT h, min(item_id) AS item_id FROM st GROUP BY h HAVING count(*) = 1)
SELECT scan_id, item_id, 'inPlace' AS how FROM ex UNION ALL
SELECT sc.scan_id, one.item_id, 'moved' FROM sc JOIN one USING (h) JOIN st ON st.item_id = one.item_id WHERE sc.scan_id NOT IN (SELECT scan_id FROM ex)
 AND NOT EXISTS (SELECT 1 FROM sc c WHERE c.parent_id = st.parent_id AND c.name = st.name)""")
def rename_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved files by content identity: equal texts stand for links of one inode."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(i, digest(F.coalesce("text", F.lit(""))).alias("inode"), (i % 50).alias("parent_id"), F.lit(1).alias("root_id"), F.lit("file").alias("kind"), F.lit(1).alias("device"))
    old = docs.withColumnRenamed("doc_id", "item_id").withColumn("name", F.concat(F.lit("f"), F.col("item_id")))
    scan = docs.withColumnRenamed("doc_id", "scan_id").withColumn("name", F.concat(F.when(F.col("scan_id") % 4 == 0, "moved").otherwise("f"), F.col("scan_id")))
    return diff.renames(scan, old, scan.select("parent_id", "name"))


@query("""
SELECT doc_id AS item_id, 'absent' AS local_status, 1::BIGINT AS local_generation, CASE WHEN doc_id % 14 = 0 THEN 2 ELSE 1 END::BIGINT AS dirty_generation, 'ready' AS phase FROM documents
WHERE (doc_id % 31 = 0 OR doc_id % 25 = 0) AND doc_id % 4 <> 1 AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def missing_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"))
    rows = stored(spark, sf_dir).withColumn("parent_id", F.when(F.col("item_id") % 4 != 1, F.col("parent_id")))  # entries of roots have no parent
    found = diff.missing(rows, scanned(spark, sf_dir).select("parent_id", "name"), gated)
    return found.select("item_id", "local_status", F.col("local_generation").cast("bigint"), F.col("dirty_generation").cast("bigint"), "phase")


@query("""
WITH d AS (SELECT source || '/' || doc_id AS path, doc_id, text FROM documents)
SELECT path, upper(sha256(CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END)) AS sha256 FROM d f
WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.doc_id % 8 <> 0 AND b.path = f.path AND sha256(b.text) = sha256(CASE WHEN f.doc_id % 6 = 0 THEN f.text || '!' ELSE f.text END))""")
def deletion_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    fresh = docs.select("path", F.upper(digest(F.when(F.col("doc_id") % 6 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))).alias("sha256"))
    return diff.changed_since(fresh, docs.where("doc_id % 8 <> 0").select("path", digest(F.col("text")).alias("sha256")))


CONFLICTS = """
WITH roots AS (SELECT DISTINCT source, CAST(substr(source, 4) AS BIGINT) AS root_id, '/roots/' || source AS root_path FROM documents),
j AS (SELECT d.doc_id, CAST(substr(source, 4) AS BIGINT) AS root_id, source, text, n_chars, quality, toxic FROM documents d JOIN labels USING (doc_id)),
c AS (SELECT 'sync-' || root_id || '-' || doc_id AS conflict_id, root_id, doc_id AS item_id, 'r' || doc_id AS remote_file_id, source || '/' || doc_id AS relative_path, '/kept/' || doc_id AS conflict_path,
 sha256(text) AS remote_sha256, n_chars AS remote_size, CASE WHEN toxic = 1 THEN 'trashed' ELSE 'present' END AS remote_status FROM j WHERE quality = 1)
"""


def _conflicts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    root = F.expr("cast(substr(source, 4) as bigint)")
    roots = docs.select("source").distinct().select(root.alias("root_id"), F.concat(F.lit("/roots/"), "source").alias("root_path"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("root_id", root)
    own = labelled.where("quality = 1").select(
        conflict_key("sync", F.col("root_id"), F.col("doc_id")).alias("conflict_id"), "root_id", F.col("doc_id").alias("item_id"), F.concat(F.lit("r"), "doc_id").alias("remote_file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("relative_path"), F.concat(F.lit("/kept/"), "doc_id").alias("conflict_path"),
        digest(F.col("text")).alias("remote_sha256"), F.col("n_chars").alias("remote_size"), F.when(F.col("toxic") == 1, "trashed").otherwise("present").alias("remote_status"),
    )
    return roots, labelled, own


@query(
    CONFLICTS
    + """SELECT conflict_id, c.root_id, root_path, 'f' || item_id AS item_name, relative_path, CASE WHEN remote_status = 'present' THEN conflict_path END AS stored_path, 'content' AS kind FROM c JOIN roots USING (root_id)
UNION ALL SELECT 'parent-' || doc_id, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE j.root_id END, root_path, NULL, '/lost/' || doc_id, '/stored/' || doc_id, 'parentRemoved' FROM j LEFT JOIN roots r ON r.root_id = CASE WHEN doc_id % 5 = 0 THEN -1 ELSE j.root_id END WHERE quality = 0"""
)
def conflict_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    roots, labelled, own = _conflicts(spark, sf_dir)
    items = labelled.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("f"), "doc_id").alias("name"))
    kept = labelled.where("quality = 0").select(F.concat(F.lit("parent-"), "doc_id").alias("conflict_id"), F.when(F.col("doc_id") % 5 == 0, -1).otherwise(F.col("root_id")).cast("bigint").alias("root_id"), F.concat(F.lit("/lost/"), "doc_id").alias("original_path"), F.concat(F.lit("/stored/"), "doc_id").alias("stored_path"))
    return conflicts.listing(own, roots, items, kept)


@query(
    CONFLICTS
    + """SELECT conflict_id, CASE WHEN s = 'whole' THEN sha256(text || 'n') ELSE remote_sha256 END AS remote_sha256, CASE WHEN s = 'whole' THEN n_chars + 1 ELSE remote_size END AS remote_size,
 CASE s WHEN 'removed' THEN 'removed' WHEN 'trashed' THEN 'trashed' WHEN 'whole' THEN 'present' ELSE remote_status END AS remote_status, CASE WHEN s IN ('removed', 'trashed', 'whole') THEN 2 ELSE 1 END::BIGINT AS revision,
 CASE WHEN s IN ('removed', 'trashed') THEN true WHEN s = 'whole' THEN item_id % 2 = 0 WHEN s = 'bad' THEN false END AS inbox_done, s = 'bad' AS issue
FROM (SELECT c.*, j.text, j.n_chars, CASE WHEN item_id % 3 = 0 THEN 'none' WHEN item_id % 5 = 0 THEN 'removed' WHEN item_id % 7 = 0 THEN 'trashed' WHEN item_id % 11 = 0 THEN 'bad' ELSE 'whole' END AS s FROM c JOIN j ON j.doc_id = c.item_id)"""
)
def conflict_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labelled, own = _conflicts(spark, sf_dir)
    i = F.col("doc_id")
    inbox = labelled.where("doc_id % 3 <> 0").select(
        "root_id", F.concat(F.lit("r"), i).alias("remote_id"), (i % 5 == 0).alias("removed"), ((i % 5 != 0) & (i % 7 == 0)).alias("trashed"), F.when(i % 11 != 0, F.upper(digest(F.concat("text", F.lit("n"))))).alias("sha256"), (F.col("n_chars") + 1).alias("size"), F.lit(2).cast("bigint").alias("version"),
        F.concat(F.lit("n"), i).alias("name"), F.lit(None).cast("string").alias("parent_remote"), F.lit(False).alias("is_directory"),
    )
    items = labelled.select(i.alias("item_id"), F.concat(F.when(i % 2 == 0, "n").otherwise("o"), i).alias("remote_name"), F.lit(None).cast("string").alias("remote_parent"))
    own = own.withColumns({"remote_version": F.lit(1).cast("bigint"), "revision": F.lit(1)})
    return conflicts.refresh(own, inbox, items).select("conflict_id", "remote_sha256", "remote_size", "remote_status", "revision", "inbox_done", "issue")


@query("""
SELECT doc_id, CASE WHEN doc_id % 10 = 0 OR doc_id % 10 = 1 THEN 'trashed' WHEN doc_id % 9 = 0 THEN 'kind' WHEN quality = 0 THEN 'name' WHEN doc_id % 7 = 0 THEN 'parent' WHEN doc_id % 6 = 0 THEN 'size' WHEN doc_id % 5 = 0 THEN 'checksum' END AS problem,
 CASE WHEN doc_id % 12 = 0 THEN NULL WHEN doc_id % 6 = 0 THEN 'size' WHEN doc_id % 5 = 0 THEN 'checksum' END AS upload_problem FROM documents JOIN labels USING (doc_id) WHERE doc_id % 60 <> 0
UNION ALL SELECT doc_id, 'trashed', 'checksum' FROM documents JOIN labels USING (doc_id) WHERE doc_id % 60 = 0""")
def verify_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    df = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        i, F.when(i % 10 != 1, i % 10 == 0).alias("trashed"), (i % 9 == 0).alias("is_directory"), F.when(F.col("quality") == 1, "n").alias("name"), F.lit("n").alias("expected_name"), F.when(i % 14 != 0, F.array(F.lit("p"), F.when(i % 7 == 0, "x").otherwise("q"))).alias("parents"), F.lit("q").alias("expected_parent"),
        F.when(i % 12 != 0, F.col("n_chars") + F.when(i % 6 == 0, 1).otherwise(0)).alias("size"), F.col("n_chars").alias("expected_size"), F.when(i % 5 != 0, F.upper(digest(F.col("text")))).alias("sha256"), digest(F.col("text")).alias("expected_sha256"),
    )
    return df.select("doc_id", diff.verify_existing(folder=False).alias("problem"), diff.verify_upload().alias("upload_problem"))


@query("""
WITH o AS (SELECT doc_id, doc_id % 4 <> 0 AS here, CASE WHEN doc_id % 4 <> 0 THEN doc_id % 6 <> 0 END AS same, doc_id % 5 = 0 AS wrote_badly FROM documents)
SELECT d.doc_id, CASE WHEN here AND same THEN CASE WHEN wrote_badly THEN 'failedAfterWriteStarted' ELSE 'published' END ELSE 'destinationChanged' END AS published,
 CASE WHEN NOT here THEN 'missing' WHEN text = '' THEN 'missingEvidence' WHEN NOT same THEN CASE WHEN d.doc_id % 5 = 0 THEN 'restoreFailed' ELSE 'changed' END WHEN d.doc_id % 3 = 0 THEN 'trashed' ELSE 'trashedWithoutURL' END AS deleted,
 (d.doc_id % 9 = 0) OR (d.doc_id % 8 <> 0) AS may_delete, 'r' || d.doc_id || ':' || sha256(text) AS cache_key FROM documents d JOIN o USING (doc_id)""")
def outcome_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    then = F.struct(F.lit(1).alias("device"), i.alias("inode"), i.alias("mtime"))
    now = F.when(i % 4 != 0, F.struct(F.lit(1).alias("device"), i.alias("inode"), (i + F.when(i % 6 == 0, 1).otherwise(0)).alias("mtime")))
    one = F.lit(1)
    return table(spark, sf_dir, "documents").select(
        "doc_id", diff.publish_outcome(then, now, F.lit(True), i % 5 != 0).alias("published"), diff.delete_outcome(now.isNotNull(), F.col("text") != "", now.eqNullSafe(then), i % 5 == 0, i % 3 == 0).alias("deleted"),
        diff.safe_to_delete(F.when(i % 9 == 0, "directory").otherwise("file"), F.lit("file"), one, one, i, i + F.when(i % 8 == 0, 1).otherwise(0)).alias("may_delete"),
        cache_key(F.concat(F.lit("r"), i), F.upper(digest(F.col("text")))).alias("cache_key"),
    )


@query("""
WITH f AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents)
SELECT f.doc_id FROM f WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source || '/' || lang AS path FROM documents WHERE lang = 'de') g WHERE f.path = g.path OR f.path LIKE g.path || '/%')""")
def below_deleted_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return gates.below_deleted(files, docs.where("lang = 'de'").select(F.concat_ws("/", "source", "lang").alias("path")), "doc_id").select("doc_id")


@query("""
SELECT 'parent-' || doc_id AS conflict_id, CAST(substr(source, 4) AS BIGINT) AS root_id, source || '/' || doc_id AS original_path, CASE WHEN quality = 1 THEN '/old' ELSE '/kept/' || source || '/' || doc_id END AS stored_path
FROM documents JOIN labels USING (doc_id) WHERE toxic = 0""")
def preserved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labelled, _ = _conflicts(spark, sf_dir)
    files = labelled.select(F.col("doc_id").alias("file_id"), "root_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    old = files.join(labelled.where("quality = 1").select(F.col("doc_id").alias("file_id")), "file_id", "left_semi").select(F.concat(F.lit("parent-"), "file_id").alias("conflict_id"), "root_id", F.col("path").alias("original_path"), F.lit("/old").alias("stored_path"))
    return conflicts.settled(conflicts.preserve(old, files, "/kept"), labelled.where("toxic = 1").select(F.concat(F.lit("parent-"), "doc_id").alias("conflict_id")))


@query("SELECT doc_id AS id FROM labels WHERE quality = 1 AND toxic = 0 UNION SELECT doc_id FROM documents WHERE lang = 'de' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def protected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return gates.protected(labels.where("quality = 1"), table(spark, sf_dir, "documents").where("lang = 'de'").withColumnRenamed("doc_id", "id"), labels.where("toxic = 1"))


@query("SELECT 1::BIGINT AS device, doc_id // 2 AS inode, count(*) AS links, min(doc_id) AS first_item FROM documents GROUP BY ALL")
def links_by_inode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.links(diff.whole_rows(stored(spark, sf_dir), ["device", "inode"]))
