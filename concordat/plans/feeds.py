"""Change-feed, issue and metric queries over ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordat.functions import issues as meaning
from concordat.functions import transfer
from concordat.functions.text import name_key, subject_key
from concordat.operators import feed, issues, metrics, pacing, tree
from concordat.sources.files import write_files
from concordat.sources.snapshots import Snapshots
from concordat.sources.workspace import Workspace, shuffled
from concordat.streaming.feed_stream import folding, replay
from concordat.streaming.keyed_inbox import follow
from concordat.streaming.listing_stream import FOLDER, list_all

from .registry import query, table


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their time in microseconds and the number of their payload."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props", at.alias("at_us"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS at_us, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
LATEST = EVENTS + ", l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)"


@query(EVENTS + "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(k, event_id) AS k, count(*) AS n_events FROM e GROUP BY user_id")
def feed_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "k"), ["user_id"], ["event_id"])


@query(
    LATEST
    + """, inbox AS (SELECT c_custkey AS user_id, -1::BIGINT AS event_id, 'old' AS event_type, 9.0::DOUBLE AS attempted_at FROM customer)
SELECT user_id, coalesce(l.event_id, inbox.event_id) AS event_id, coalesce(l.event_type, inbox.event_type) AS event_type, CASE WHEN l.event_id IS NULL THEN attempted_at ELSE 0.0 END AS attempted_at FROM inbox FULL JOIN l USING (user_id)"""
)
def feed_enqueue(spark: SparkSession, sf_dir: str) -> DataFrame:
    inbox = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("old").alias("event_type"), F.lit(9.0).alias("attempted_at"))
    return feed.enqueue(inbox, events(spark, sf_dir).select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"])


@query(
    EVENTS
    + """, h AS (SELECT DISTINCT user_id FROM e WHERE event_type = 'error')
SELECT c_custkey AS user_id, CASE WHEN h.user_id IS NULL THEN 'present' ELSE 'unknown' END AS remote_status, (c_custkey % 3 + CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END)::BIGINT AS remote_generation, CASE WHEN h.user_id IS NULL THEN 0 ELSE 1 END::BIGINT AS dirty_generation,
 (SELECT coalesce(bool_or(user_id = 7 AND event_type = 'error'), false) FROM e) AS root_lost FROM customer LEFT JOIN h ON c_custkey = h.user_id"""
)
def feed_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir)
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit("present").alias("remote_status"), (F.col("c_custkey") % 3).alias("remote_generation"), F.lit(0).cast("bigint").alias("dirty_generation"))
    lost = feed.root_lost(own.select(F.col("user_id").alias("remote_id"), (F.col("event_type") == "error").alias("removed"), F.lit(False).alias("trashed")), F.lit(7))
    return feed.invalidate(items, own.where("event_type = 'error'"), "user_id").join(F.broadcast(lost))


@query(
    LATEST.replace("WITH e", "WITH RECURSIVE e")
    + """, i AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey > 1 THEN c_custkey // 3 END AS parent_remote, c_custkey % 40 AS version, c_custkey % 33 = 5 AS excluded FROM customer),
s AS (SELECT user_id AS id, event_type, CASE WHEN user_id % 9 <> 0 THEN k END AS version, user_id // 3 AS parent_remote, event_type = 'error' AS removed, k % 5 = 0 AS trashed,
  CASE WHEN k % 7 = 0 THEN 'outside' WHEN k % 11 = 0 THEN 'unknown' ELSE 'inside' END AS scope, k % 13 <> 0 AS placeable FROM l),
o AS (SELECT id, i.name, s.event_type, i.parent_remote, s.parent_remote AS new_parent, i.version, s.version AS new_version, i.excluded, i.id IS NOT NULL AS known,
  CASE WHEN s.id IS NULL THEN 'kept'
   WHEN removed THEN CASE WHEN i.id IS NULL THEN 'none' ELSE 'excluded' END
   WHEN trashed THEN CASE WHEN i.id IS NULL THEN 'none' ELSE 'trashed' END
   WHEN scope <> 'inside' THEN CASE WHEN i.id IS NULL THEN 'none' ELSE 'excluded' END
   WHEN NOT placeable THEN CASE WHEN i.id IS NULL THEN 'none' ELSE 'kept' END
   WHEN i.id IS NULL THEN 'inserted' WHEN s.version < i.version THEN 'stale' ELSE 'updated' END AS effect FROM i FULL JOIN s USING (id)),
a AS (SELECT id, effect, effect IN ('inserted', 'updated') AS written, CASE WHEN effect IN ('inserted', 'updated') THEN new_parent ELSE parent_remote END AS parent_remote,
  CASE WHEN effect IN ('inserted', 'updated') THEN event_type ELSE name END AS name, CASE WHEN effect IN ('inserted', 'updated') THEN new_version ELSE version END AS version, coalesce(excluded, false) AS excluded FROM o WHERE effect <> 'none'),
x AS (SELECT id FROM a WHERE effect = 'excluded' UNION SELECT a.id FROM a JOIN x ON a.parent_remote = x.id)
SELECT id, name, parent_remote, version, CASE WHEN effect = 'trashed' THEN 'trashed' ELSE 'present' END AS status, CASE WHEN written OR effect = 'trashed' THEN 'ready' ELSE 'committed' END AS phase,
 CASE WHEN written THEN false ELSE excluded OR id IN (SELECT id FROM x) END AS excluded, written::BIGINT AS remote_generation, (written OR effect = 'trashed')::BIGINT AS dirty_generation, effect FROM a"""
)
def feed_apply_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a stored tree (parent = key div 3) after the latest event of each as its observation."""
    items = _stored_objects(spark, sf_dir)
    return feed.exclude_below(feed.apply_observations(items, _observed(spark, sf_dir), "id"), "id").select(
        "id", "name", "parent_remote", "version", "status", "phase", "excluded", "remote_generation", "dirty_generation", "effect"
    )


def _stored_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, zero = F.col("c_custkey"), F.lit(0).cast("bigint")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_name").alias("name"), F.when(key > 1, F.floor(key / 3)).alias("parent_remote"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("bigint").alias("size"),
        (key % 40).alias("version"), F.lit("present").alias("status"), F.lit("committed").alias("phase"), (key % 33 == 5).alias("excluded"), zero.alias("remote_generation"), zero.alias("dirty_generation"),
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = feed.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "k"), ["user_id"], ["event_id"])
    k = F.col("k")
    return new.select(
        F.col("user_id").alias("id"), F.col("event_type").alias("name"), F.floor(F.col("user_id") / 3).alias("parent_remote"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("bigint").alias("size"),
        F.when(F.col("user_id") % 9 != 0, k).alias("version"), (F.col("event_type") == "error").alias("removed"), (k % 5 == 0).alias("trashed"),
        F.when(k % 7 == 0, "outside").when(k % 11 == 0, "unknown").otherwise("inside").alias("scope"), (k % 13 != 0).alias("placeable"),
    )


@query(
    LATEST
    + """SELECT user_id AS id, CASE WHEN k % 7 <> 0 AND k % 11 = 0 THEN 'unknown' ELSE 'inside' END AS scope FROM l
WHERE event_type <> 'error' AND k % 5 <> 0 AND k % 7 <> 0 AND (k % 11 = 0 OR k % 13 = 0)"""
)
def feed_still_queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed.still_queued(_observed(spark, sf_dir)).select("id", "scope")


@query("SELECT user_id AS id, min(value) AS attempted_at FROM events GROUP BY user_id HAVING min(value) < 5.0 ORDER BY 2, 1 LIMIT 1000")
def retry_queue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round of the retry queue; its size is the feature."""
    inbox = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.min("value").alias("attempted_at"))
    return feed.retry_page(inbox, 5.0)


@query("""
WITH j AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 's1' ELSE 's0' END AS scan_id, 't' AS page_token, 'complete' AS state FROM nation), w AS (SELECT DISTINCT s_nationkey AS id, 's1' AS scan_id FROM supplier)
SELECT id, coalesce(w.scan_id, j.scan_id) AS scan_id, CASE WHEN w.scan_id IS NULL OR w.scan_id = j.scan_id THEN page_token END AS page_token, CASE WHEN w.scan_id IS NULL OR w.scan_id = j.scan_id THEN state ELSE 'pending' END AS state FROM j FULL JOIN w USING (id)""")
def feed_reschedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    jobs = table(spark, sf_dir, "nation").select(k.alias("id"), F.when(k % 2 == 0, "s1").otherwise("s0").alias("scan_id"), F.lit("t").alias("page_token"), F.lit("complete").alias("state"))
    return feed.reschedule(jobs, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("s1").alias("scan_id")), ["id"])


@query("""
WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id, p_size FROM part), x AS (SELECT id FROM n WHERE id % 50 = 11 UNION ALL SELECT n.id FROM n JOIN x ON n.parent_id = x.id)
SELECT id FROM n WHERE p_size > 10 AND id NOT IN (SELECT id FROM x) AND id NOT IN (SELECT user_id FROM events) ORDER BY id LIMIT 64""")
def unobserved_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items to read again next; 64 at a time is the feature."""
    k = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 0, F.floor(k / 4)).alias("parent_id"), F.concat(F.lit("n"), k).alias("name"), F.when(F.col("p_size") > 10, "unknown").otherwise("present").alias("remote_status"))
    none = spark.createDataFrame([], "id long")
    return feed.unobserved(own, tree.excluded(own, own.where("id % 50 = 11")), table(spark, sf_dir, "events").select(F.col("user_id").alias("id")), none).select("id")


@query(
    EVENTS
    + """, f AS (SELECT *, event_type = 'error' AS b, lag(event_type = 'error') OVER w AS p FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, sum(CASE WHEN b OR coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS "group" FROM f"""
)
def barrier_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).withColumn("barrier", F.col("event_type") == "error")
    return tree.barrier_groups(own, "user_id", ["event_id"], "barrier").select("event_id", "user_id", "group")


@query(
    EVENTS
    + """, q AS (SELECT DISTINCT event_id AS remote_id, k % 20 AS parent_remote, upper(event_type) AS name, nfc_normalize(lower(event_type)) AS name_key FROM e),
i AS (SELECT p_partkey AS item_id, CASE WHEN p_partkey % 4 <> 1 THEN p_partkey END AS remote_id, p_partkey // 4 AS parent_id, CASE WHEN p_partkey % 8 = 1 THEN upper(name_key) ELSE name_key END AS name, name_key
  FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'x' END AS name_key FROM part))
SELECT DISTINCT q.remote_id, q.name, s.parent_id FROM q JOIN i p ON q.parent_remote = p.remote_id JOIN i s ON s.parent_id = p.item_id AND s.name_key = q.name_key WHERE s.remote_id <> q.remote_id OR (s.remote_id IS NULL AND s.name <> q.name)"""
)
def name_conflict_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).withColumn("name", F.upper("event_type"))
    keys = own.select("name").distinct().withColumn("name_key", name_key("name"))
    inbox = own.join(keys, "name").select(F.col("event_id").alias("remote_id"), (F.col("k") % 20).alias("parent_remote"), "name", "name_key")
    k = F.col("p_partkey")
    key = F.when(k % 3 == 0, "click").when(k % 3 == 1, "view").otherwise("x")
    items = table(spark, sf_dir, "part").select(k.alias("item_id"), F.when(k % 4 != 1, k).alias("remote_id"), F.floor(k / 4).alias("parent_id"), F.when(k % 8 == 1, F.upper(key)).otherwise(key).alias("name"), key.alias("name_key"))
    return feed.name_conflicts(inbox, items)


@query(
    EVENTS
    + """SELECT event_id, 'f' || user_id AS remote_id, event_type = 'error' AS removed, 'n' || k AS name, 'p' || (user_id % 10) AS parent_remote, CASE WHEN event_id % 3 <> 0 THEN k END AS size, lower(CASE WHEN event_id % 4 <> 0 THEN md5(props) END) AS sha256, event_id AS version, event_id % 5 = 0 AS trashed FROM e"""
)
def json_payload_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    file = F.struct(F.concat(F.lit("n"), "k").alias("name"), F.array(F.concat(F.lit("p"), F.col("user_id") % 10)).alias("parents"), F.when(i % 3 == 0, "none").otherwise(F.col("k").cast("string")).alias("size"), F.when(i % 4 != 0, F.upper(F.md5("props"))).alias("sha256Checksum"), i.cast("string").alias("version"), F.when(i % 5 == 0, True).alias("trashed"))
    change = F.to_json(F.struct(F.concat(F.lit("f"), "user_id").alias("fileId"), F.when(F.col("event_type") == "error", True).alias("removed"), file.alias("file")))
    raw = events(spark, sf_dir).select("event_id", change.alias("payload"))
    return feed.parsed(raw).drop("payload")


ISSUES = (
    EVENTS
    + """, r AS (SELECT user_id % 5 AS root_id, CASE user_id % 3 WHEN 0 THEN 'item:' || user_id WHEN 1 THEN 'remote:r' || user_id ELSE 'path:p/' || user_id END AS subject,
 ['localScan', 'createDirectory', 'upload', 'download', 'pathUpdate', 'delete', 'unknownStage'][k % 7 + 1] AS stage, at_us, event_id, CASE k % 4 WHEN 0 THEN 'rateLimited' WHEN 1 THEN 'server' WHEN 2 THEN 'general' ELSE 'checksumMismatch' END AS kind, CASE k % 3 WHEN 0 THEN 403 ELSE 500 END AS status, CASE k % 5 WHEN 0 THEN 'Token EXPIRED' ELSE 'other' END AS message FROM e WHERE event_type = 'error'),
i AS (SELECT root_id, subject, stage, min(at_us) AS first_seen, max(at_us) AS last_seen, count(*) AS occurrence_count, arg_max(kind, event_id) AS kind, arg_max(status, event_id) AS status, arg_max(message, event_id) AS message FROM r GROUP BY ALL),
c AS (SELECT *, CASE WHEN kind = 'rateLimited' THEN 'rateLimited' WHEN kind = 'server' THEN CASE WHEN status = 403 THEN 'permissionDenied' ELSE 'network' END WHEN kind = 'general' THEN CASE WHEN message = 'Token EXPIRED' THEN 'staleState' ELSE 'unknown' END ELSE 'integrityMismatch' END AS category,
 CASE WHEN kind = 'rateLimited' OR (kind = 'server' AND status <> 403) THEN 'retryLater' WHEN kind = 'server' THEN 'checkPermissions' ELSE 'retry' END AS action FROM i)
"""
)


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, k = F.col("user_id"), F.col("k")
    stages = ["localScan", "createDirectory", "upload", "download", "pathUpdate", "delete", "unknownStage"]
    reports = events(spark, sf_dir).where("event_type = 'error'").select(
        (u % 5).alias("root_id"), subject_key(F.when(u % 3 == 0, u), F.when(u % 3 == 1, F.concat(F.lit("r"), u)), F.concat(F.lit("p/"), u)).alias("subject"), F.get(F.array(*map(F.lit, stages)), (k % 7).cast("int")).alias("stage"), "at_us", "event_id",
        F.when(k % 4 == 0, "rateLimited").when(k % 4 == 1, "server").when(k % 4 == 2, "general").otherwise("checksumMismatch").alias("kind"), F.when(k % 3 == 0, 403).otherwise(500).alias("status"), F.when(k % 5 == 0, "Token EXPIRED").otherwise("other").alias("message"),
    )
    found = issues.rollup(reports, ["root_id", "subject", "stage"], "at_us", ["event_id"], ["kind", "status", "message"])
    what = (F.col("kind"), F.col("status"), F.col("message"))
    return found.select("root_id", "subject", "stage", "first_seen", "last_seen", "occurrence_count", meaning.category(*what).alias("category"), meaning.action(*what).alias("action"))


@query(ISSUES + "SELECT root_id, subject, stage, first_seen, last_seen, occurrence_count, category, action FROM c WHERE root_id <> 4")
def issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.clear(_issues(spark, sf_dir), 4)


@query(ISSUES + "SELECT root_id, subject, stage, last_seen, (SELECT count(*) FROM c) AS total FROM (SELECT * FROM c ORDER BY last_seen DESC, root_id || '/' || subject || '/' || stage LIMIT 20 OFFSET 10) WHERE stage <> 'unknownStage'")
def issue_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of issues: a page is the feature."""
    found = Workspace(spark, "issues").save(_issues(spark, sf_dir).withColumn("issue_id", F.concat_ws("/", F.col("root_id").cast("string"), "subject", "stage")), "all")
    rows, total, _ = issues.page(found, 20, 10)
    return rows.select("root_id", "subject", "stage", "last_seen", F.lit(total).cast("bigint").alias("total"))


@query(EVENTS + "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY at_us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window, greatest(at_us + 15384, coalesce(lag(at_us, 64) OVER (PARTITION BY user_id ORDER BY at_us, event_id) + 1010000, at_us + 15384)) AS next_us FROM e")
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = metrics.in_window(events(spark, sf_dir), ["user_id"], "at_us", 3_600_000_000)
    return metrics.next_start(counted, ["user_id"], "at_us", ["at_us", "event_id"]).select("event_id", "in_window", "next_us")


@query(EVENTS + ", r AS (SELECT *, (at_us - lag(at_us) OVER w) / 1e6 AS s, k - lag(k) OVER w AS m FROM e WINDOW w AS (PARTITION BY user_id ORDER BY at_us, event_id)) SELECT event_id, CASE WHEN s >= 0.1 THEN round(greatest(m / s, 0), 6) END AS rate, round(CASE WHEN k > 0 THEN greatest(0, least(1, value / k)) ELSE 0 END, 6)::DOUBLE AS fraction FROM r")
def sampled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.sampled_rate(events(spark, sf_dir), ["user_id"], "at_us", "k", ["at_us", "event_id"])
    return found.select("event_id", F.round("rate", 6).alias("rate"), F.round(metrics.fraction(F.col("value"), F.col("k")), 6).alias("fraction"))


@query(EVENTS + "SELECT event_id, user_id, event_type FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1 OR event_type IS DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id)")
def distinct_until_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.distinct_until_changed(events(spark, sf_dir), ["user_id"], ["event_id"], ["event_type"]).select("event_id", "user_id", "event_type")


@query(EVENTS + "SELECT event_id, greatest(k - coalesce(max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS fresh FROM e")
def high_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.high_water(events(spark, sf_dir), ["user_id"], ["event_id"], "k").select("event_id", "fresh")


@query(EVENTS + "SELECT event_id, max(at_us + CASE WHEN k % 10 = 0 THEN 1.5 ELSE least(greatest(k * 100.0, 1), 3600) END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS until FROM e")
def cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).withColumn("delay", F.when(F.col("k") % 20 == 0, F.lit(float("nan"))).when(F.col("k") % 10 != 0, F.col("k") * 100.0))
    return metrics.cooldown(own, ["user_id"], ["event_id"], "at_us", "delay").select("event_id", "until")


@query(EVENTS + ", n AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM e) SELECT event_id, CASE WHEN n < 1 THEN 0 ELSE 1 + (n - 1) // 64 END::BIGINT AS batch FROM n")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.batches(events(spark, sf_dir), ["user_id"], ["event_id"]).select("event_id", "batch")


@query(
    EVENTS
    + """, p AS (SELECT event_id, user_id, k // 20 AS o FROM e), b AS (SELECT *, coalesce(lag(o) OVER w, 0) AS before FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, o < before AS went_back, o = before AND coalesce(lag(o = before) OVER (PARTITION BY user_id ORDER BY event_id), false) AS stalled FROM b"""
)
def stalled_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    offsets = events(spark, sf_dir).withColumn("offset", F.floor(F.col("k") / 20))
    return metrics.stalled(offsets, ["user_id"], ["event_id"], "offset").select("event_id", "went_back", "stalled")


@query(
    EVENTS
    + """, p AS (SELECT event_id, user_id, k // 7 AS o, 2 + event_id % 5 AS sent, 9 + user_id % 6 AS size FROM e), b AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM p)
SELECT event_id, NOT (o >= before AND o <= before + sent AND o < size) AS invalid FROM b"""
)
def upload_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledged offsets that cannot be: less than before, more than was sent, or the end of the file."""
    answers = events(spark, sf_dir).withColumns({"offset": F.floor(F.col("k") / 7), "sent": F.col("event_id") % 5 + 2, "size": F.col("user_id") % 6 + 9})
    return metrics.stalled(answers, ["user_id"], ["event_id"], "offset", sent="sent", total="size").select("event_id", "invalid")


@query(
    EVENTS
    + """SELECT event_id, CASE k % 7 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN 'quotaExceeded' WHEN 3 THEN 'rateLimitExceeded' WHEN 5 THEN 'userRateLimitExceeded' END AS reason, k % 7 = 4 AND event_id % 2 = 0 AS rejected,
 CASE WHEN k % 7 IN (0, 1, 2, 3, 5) THEN 'rateLimited' WHEN k % 7 = 6 THEN 'transient' END AS answer, CASE WHEN event_id % 3 = 0 THEN 7.5 WHEN k % 7 IN (2, 3, 5) THEN 2.0 END::DOUBLE AS asked_wait FROM e"""
)
def rate_limit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("k") % 7
    status = F.when(n == 0, 429).when(n == 1, 503).when(n == 4, F.when(F.col("event_id") % 2 == 0, 400).otherwise(404)).when(n == 6, F.when(F.col("event_id") % 2 == 0, 500).otherwise(504)).otherwise(403)
    body = (
        F.when(n == 2, '{"error": {"errors": [{"reason": "quotaExceeded"}], "message": "userRateLimitExceeded"}}').when(n == 3, "plain rateLimitExceeded and dailyLimitExceeded")
        .when(n == 4, "Invalid PageToken").when(n == 5, '{"error": {"errors": [{"reason": "other userRateLimitExceeded"}]}}')
    )
    header = F.when(F.col("event_id") % 3 == 0, 7.5)
    return events(spark, sf_dir).select(
        "event_id", transfer.rate_limit(status, body).alias("reason"), F.coalesce(feed.cursor_rejected(status, body), F.lit(False)).alias("rejected"),
        transfer.answer(status, body).alias("answer"), transfer.asked_wait(status, body, header).alias("asked_wait"),
    )


@query(EVENTS + "SELECT event_id, round(greatest(CASE WHEN k % 3 = 0 THEN k::DOUBLE ELSE 0 END, least(16.0, pow(2, event_id % 7) + 0.2 + (k % 7) / 10.0)), 6) AS wait, round(least(16.0, pow(2, event_id % 7 - 1) + 0.1), 6) AS network_wait, event_id % 7 <= 5 AS retry FROM e")
def backoff_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt, k = (F.col("event_id") % 7), F.col("k")
    return events(spark, sf_dir).select("event_id", F.round(transfer.backoff(attempt, F.when(k % 3 == 0, k.cast("double")), 0.2 + (k % 7) / 10.0), 6).alias("wait"), F.round(transfer.network_backoff(attempt, F.lit(0.1)), 6).alias("network_wait"), transfer.may_retry(attempt).alias("retry"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS median, min(value) AS smallest, count(*) AS n FROM events GROUP BY event_type")
def median_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.middle(table(spark, sf_dir, "events"), ["event_type"], "value")


ACTIONS = ["upload", "download", "trashRemote", "deleteLocal", "conflict", "failed", "scanFailed", "pending", "enumerated", "scanned", "skipped", "directoryCreated", "issue", "nameConflict"]


@query(
    EVENTS
    + f""", a AS (SELECT {ACTIONS}[k % {len(ACTIONS)} + 1] AS a, k FROM e)
SELECT count_if(a = 'upload')::BIGINT AS uploaded, coalesce(sum(k) FILTER (a = 'upload'), 0)::BIGINT AS uploaded_bytes, count_if(a = 'download')::BIGINT AS downloaded, coalesce(sum(k) FILTER (a = 'download'), 0)::BIGINT AS downloaded_bytes,
 count_if(a IN ('scanned', 'skipped'))::BIGINT AS scanned, count_if(a = 'skipped')::BIGINT AS skipped, count_if(a = 'directoryCreated')::BIGINT AS directories_created, count_if(a = 'issue')::BIGINT AS issues, count_if(a = 'nameConflict')::BIGINT AS name_conflicts,
 count_if(a IN ('trashRemote', 'deleteLocal'))::BIGINT AS deleted, count_if(a = 'conflict')::BIGINT AS conflicts, count_if(a IN ('failed', 'scanFailed'))::BIGINT AS failures,
 (greatest(count_if(a = 'pending'), max((a = 'enumerated')::INT)) + count_if(a = 'conflict'))::BIGINT AS remote_work_pending FROM a"""
)
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.get(F.array(*map(F.lit, ACTIONS)), (F.col("k") % len(ACTIONS)).cast("int"))
    return metrics.run_statistics(events(spark, sf_dir).select(action.alias("action"), F.col("k").alias("bytes")))


@query(EVENTS + "SELECT event_id, CASE WHEN k % 5 = 0 THEN 'incompleteSearch' WHEN k % 7 = 0 THEN 'emptyToken' WHEN k % 11 = 0 THEN 'tokenDidNotAdvance' END AS problem FROM e")
def page_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return events(spark, sf_dir).select("event_id", feed.page_problem(k % 5 == 0, F.when(k % 7 == 0, "").when(k % 3 != 1, F.concat(F.lit("t"), k)).when(k % 11 == 0, F.concat(F.lit("t"), k)), F.when(k % 11 == 0, F.concat(F.lit("t"), k)).otherwise("t")).alias("problem"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files: one file, or a folder of part files, as Spark writes tables."""
    files = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("maxFilesPerTrigger", 1)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return files.parquet(f"{sf_dir}/events.parquet")
    return files.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query(EVENTS + "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(k, event_id) AS k, count(*) AS n_events FROM e GROUP BY user_id")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed as a stream of files, folded batch by batch; equal to the batch query."""
    work = Workspace(spark, "replay")
    stream = event_stream(spark, sf_dir).select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    inbox = Snapshots(spark, f"{work.root}/inbox")
    replay(stream, inbox, f"{work.root}/checkpoint", ["user_id"], ["event_id"])
    return inbox.read()


@query(
    EVENTS
    + """, w AS (SELECT max(at_us) // 1000 - 600000 AS w FROM e), l AS (SELECT user_id, max(event_id) AS number, arg_max(event_type, event_id) AS payload, arg_max(at_us, event_id) // 1000 AS at_ms, count(*) AS n_events FROM e GROUP BY user_id),
t AS (SELECT l.*, len([j FOR j IN range(1, 6) IF at_ms + 3600000 * ((1 << j) - 1) <= w]) AS tried FROM l, w)
SELECT user_id, number, payload, tried::BIGINT AS tried, CASE WHEN tried = 5 THEN 'given up' ELSE 'pending' END AS state, n_events FROM t"""
)
def keyed_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest change of each user and how often it was tried by the end of the feed: keyed state with timers."""
    work = Workspace(spark, "keyed")
    changes = event_stream(spark, sf_dir).select("user_id", F.col("event_id").alias("number"), F.col("event_type").alias("payload"), F.col("ts").cast("timestamp").alias("at"))
    inbox = Snapshots(spark, f"{work.root}/inbox")
    follow(changes, inbox, f"{work.root}/checkpoint", "user_id")
    return inbox.read()


@query(EVENTS + "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS n_events, 3 AS version FROM e GROUP BY user_id")
def raced_inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inbox after two writers of one version: the one that loses folds its changes onto the winner's."""
    key, order = ["user_id"], ["event_id"]
    own = events(spark, sf_dir).select("user_id", "event_id", "event_type")
    third = F.col("event_id") % 3
    first, even, odd = (feed.latest(own.where(third == k), key, order) for k in range(3))
    work, fold = Workspace(spark, "race"), folding(key, order)
    one, other = (Snapshots(spark, f"{work.root}/inbox") for _ in range(2))
    one.commit_all(batch=0, folds={"table": (first, key, fold)}, writer="one")

    def overtaken(stored: DataFrame | None, new: DataFrame) -> DataFrame:
        if other.version() == 1:
            other.commit_all(batch=0, folds={"table": (odd, key, fold)}, writer="other")
        return fold(stored, new)

    one.commit_all(batch=1, folds={"table": (even, key, overtaken)}, writer="one")
    return one.read().withColumn("version", F.lit(one.version()))


@query("""
WITH RECURSIVE n AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey > 0 THEN s_suppkey // 4 END AS above, s_nationkey % 5 <> 0 AS is_directory FROM supplier),
t AS (SELECT k, above, is_directory FROM n WHERE above = 0 UNION ALL SELECT n.k, n.above, n.is_directory FROM n JOIN t ON n.above = t.k WHERE t.is_directory)
SELECT 'f' || k AS id, 'f' || above AS parent_id, 'n' || k AS name, is_directory, 'complete' AS listing FROM t""")
def bootstrap_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as a tree of JSON listing pages, written as files and listed by a stream until no page is open."""
    work = Workspace(spark, "bootstrap")
    folder = work.root.removeprefix("file://").removeprefix("file:")
    k = F.col("s_suppkey")
    is_folder = (F.col("s_nationkey") % 5 != 0) | (k == 0)
    own = table(spark, sf_dir, "supplier").select(k, F.when(k > 0, F.floor(k / 4)).alias("above"), is_folder.alias("is_folder"))
    # A folder has four entries at most here: two pages of two, the second named by the first.
    page = F.when(F.pmod(k, F.lit(4)) < 2, 0).otherwise(1)
    file = F.struct(F.concat(F.lit("f"), k).alias("id"), F.concat(F.lit("n"), k).alias("name"), F.when(F.col("is_folder"), FOLDER).otherwise("text/plain").alias("mimeType"))
    pages = own.where("above is not null").groupBy("above", page.alias("page")).agg(F.sort_array(F.collect_list(file)).alias("files"))
    every = own.where("is_folder").select(F.col("s_suppkey").alias("above"), F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    body = F.to_json(F.struct(F.when(F.col("page") == 0, "p1").alias("nextPageToken"), F.coalesce("files", F.array()).alias("files")))
    name = F.concat(F.lit("f"), "above", F.when(F.col("page") == 0, "/start.json").otherwise("/p1.json"))
    write_files(every.join(shuffled(pages), ["above", "page"], "left").select(name.alias("path"), body.alias("content")), f"{folder}/pages")
    state = Snapshots(spark, f"{work.root}/state", bits=1)
    found = list_all(spark, f"{folder}/pages", "f0", state, f"{folder}/waves", f"{work.root}/checkpoint")
    jobs = state.read(table="jobs").select("id", F.col("state").alias("listing"))
    listed = found.select("id", "parent_id", "name", (F.col("mimeType") == FOLDER).alias("is_directory"))
    return listed.where("id <> 'f0'").join(shuffled(jobs), "id", "left").withColumn("listing", F.coalesce("listing", F.lit("complete")))


@query()
def request_permits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user's events could have started under the pace; sequential, so beyond SQL."""
    own = events(spark, sf_dir).select(F.col("user_id").alias("gate"), F.col("event_id").alias("request"), "at_us")
    return pacing.permits(own, limit=3, width_us=3_600_000_000)


@query(EVENTS + "SELECT user_id, at_us // 3600000000 AS interval, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM e GROUP BY ALL")
def interval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = events(spark, sf_dir).select("user_id", "event_id", "event_type", "at_us")
    return pacing.sampled(own, ["user_id"], "at_us", ["event_id"], 3_600_000_000).select("user_id", "interval", "event_id", "event_type")


@query("""
WITH j AS (SELECT n_nationkey AS id, 's' AS scan_id, CASE WHEN n_nationkey % 4 <> 0 THEN 't' || n_nationkey END AS page_token, CASE WHEN n_nationkey % 6 = 1 THEN 'complete' ELSE 'pending' END AS state FROM nation), p AS (SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY 1),
h AS (SELECT *, n IS NOT NULL AND state = 'pending' AND NOT (id % 5 = 0 AND id % 4 <> 0) AS hit FROM j LEFT JOIN p USING (id))
SELECT id, scan_id, CASE WHEN NOT hit THEN page_token WHEN n % 3 = 0 THEN NULL WHEN n % 2 = 0 THEN 'next' END AS page_token, CASE WHEN NOT hit OR n % 3 = 0 OR n % 2 = 0 THEN state ELSE 'complete' END AS state FROM h""")
def listing_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, i, n = F.col("n_nationkey"), F.col("id"), F.col("n")
    token = lambda x: F.when(x % 4 != 0, F.concat(F.lit("t"), x))
    jobs = table(spark, sf_dir, "nation").select(k.alias("id"), F.lit("s").alias("scan_id"), token(k).alias("page_token"), F.when(k % 6 == 1, "complete").otherwise("pending").alias("state"))
    pages = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.count("*").alias("n"))
    pages = pages.select("id", F.when((i % 5 == 0) & (i % 4 != 0), "late").otherwise(token(i)).alias("requested_token"), F.when(n % 2 == 0, "next").alias("next_token"), (n % 3 == 0).alias("stale"))
    return feed.advance(jobs, pages)
