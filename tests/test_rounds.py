"""A whole round over a few files: skipped, edited, moved, new, gone, and changed far away."""

from pyspark.sql import functions as F

from concordat.operators import rounds
from concordat.sources.snapshots import Snapshots

ITEM = (
    "item_id long, parent_id long, name string, entry_kind string, remote_id string, parent_remote string, base_sha256 string, base_size long, local_status string, local_sha256 string, local_size long, device long, inode long, mtime long, ctime long,"
    " remote_status string, remote_sha256 string, remote_size long, remote_version long, phase string, excluded boolean, local_generation long, remote_generation long, dirty_generation long"
)
SEEN = "remote_id string, name string, parent_remote string, sha256 string, size long, version long, removed boolean, trashed boolean, scope string, placeable boolean"
SCAN = "parent_id long, name string, device long, inode long, mtime long, ctime long, size long, content string"


def sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def item(i, name, text, parent=1, **other):
    row = dict(item_id=i, parent_id=parent, name=name, entry_kind="file", remote_id=f"r{i}", parent_remote="r1", base_sha256=sha(text), base_size=len(text), local_status="present", local_sha256=sha(text), local_size=len(text), device=1, inode=i, mtime=i, ctime=i, remote_status="present", remote_sha256=sha(text), remote_size=len(text), remote_version=1, phase="committed", excluded=False, local_generation=1, remote_generation=1, dirty_generation=0)
    return tuple((row | other)[c.split()[0]] for c in ITEM.split(","))


def test_a_round(spark, tmp_path):
    folder = item(1, "", "", parent=None, entry_kind="directory", parent_remote=None, base_sha256=None, local_sha256=None)
    texts = {2: "same", 3: "edited", 4: "moved", 5: "gone here", 6: "changed there", 7: "trashed there", 8: "both", 9: "removed there"}
    items = spark.createDataFrame([folder, *(item(i, f"f{i}", t) for i, t in texts.items())], ITEM)
    far = lambda i, text, **o: tuple((dict(remote_id=f"r{i}", name=f"f{i}", parent_remote="r1", sha256=sha(text), size=len(text), version=2, removed=False, trashed=False, scope="inside", placeable=True) | o).values())
    seen = spark.createDataFrame([far(6, "new there"), far(7, "", trashed=True), far(8, "theirs"), far(9, "", removed=True), far(20, "only there"), far(21, "x", scope="unknown")], SEEN)
    near = lambda i, text, name=None, changed=0: (1, name or f"f{i}", 1, i, i + changed, i, len(text), text)
    scan = spark.createDataFrame([near(2, "same"), near(3, "edited!", changed=1), near(4, "moved", name="elsewhere"), near(6, "changed there"), near(7, "trashed there"), near(8, "ours", changed=1), near(9, "removed there"), near(30, "only here", name="new")], SCAN)
    hashed = []

    def digest(changed):
        hashed.extend(r.name for r in changed.select("name").collect())
        return changed.withColumn("sha256", F.sha2("content", 256))

    state = Snapshots(spark, f"file://{tmp_path}/items")
    after, work, statistics = rounds.incremental(items, seen, scan, digest, spark.createDataFrame([], "item_id long"), state)
    assert sorted(hashed) == ["elsewhere", "f3", "f7", "f8", "new"] or sorted(hashed) == ["elsewhere", "f3", "f6", "f7", "f8", "new"]
    name = {r.item_id: r.name for r in after.collect()}
    got = {name[r.item_id]: (r.decision, r.work) for r in work.collect()}
    assert got == {"f3": ("upload", "safetyBlocked"), "f5": ("trashRemote", "trashRemote"), "f6": ("download", "download"), "f7": ("deleteLocal", "deleteLocal"), "f8": ("conflict", "conflict"), "f20": ("download", "download"), "new": ("upload", "upload")}
    rows = {r.name: r for r in after.collect()}
    assert rows["elsewhere"].item_id == 4 and rows["elsewhere"].phase == "committed" and rows["elsewhere"].dirty_generation == 0
    assert rows["f9"].excluded and rows["f9"].remote_status == "present" and rows["f5"].local_status == "absent" and rows["f20"].parent_id == 1
    assert rows["f3"].phase == "blocked" and rows["f3"].dirty_generation == 1 and rows["f2"].dirty_generation == 0
    one = statistics.first()
    assert (one.uploaded, one.downloaded, one.deleted, one.conflicts, one.failures, one.remote_work_pending) == (1, 2, 2, 1, 1, 2)
    assert state.read().count() == after.count() == len(name) == 11
    again, work, _ = rounds.incremental(after, seen.limit(0), scan, digest, spark.createDataFrame([], "item_id long"))
    assert {name[r.item_id]: r.work for r in work.collect()} == {k: w for k, (_, w) in got.items()}  # what is not carried out comes up again


def counted(spark, rows, schema):
    """``rows`` and how often a row of them was made."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return spark.createDataFrame(rows, schema).mapInArrow(count, schema), made


def test_what_a_round_is_given_is_made_once(spark, tmp_path):
    folder = item(1, "", "", parent=None, entry_kind="directory", parent_remote=None, base_sha256=None, local_sha256=None)
    items, n_items = counted(spark, [folder, *(item(i, f"f{i}", f"t{i}") for i in range(2, 8))], ITEM)
    far = lambda i, text: (f"r{i}", f"f{i}", "r1", sha(text), len(text), 2, False, False, "inside", True)
    seen, n_seen = counted(spark, [far(6, "new there"), far(20, "only there"), far(21, "too")], SEEN)
    near = lambda i, text, name=None, changed=0: (1, name or f"f{i}", 1, i, i + changed, i, len(text), text)
    scan, n_scan = counted(spark, [near(2, "t2"), near(3, "edited", changed=1), near(4, "t4", name="elsewhere"), near(30, "new", name="new")], SCAN)
    hashed, n_hashed = [], spark.sparkContext.accumulator(0)

    @F.udf("string")
    def sha_of(text):
        import hashlib

        n_hashed.add(1)
        return hashlib.sha256(text.encode()).hexdigest()

    def digest(changed):
        hashed.append(changed)
        return changed.withColumn("sha256", sha_of("content"))

    before = set(glob(spark))
    done = rounds.run(items, seen, scan, digest)
    rows = {r.name: r for r in done.items.collect()}
    assert rows["f3"].local_sha256 == sha("edited") and rows["elsewhere"].item_id == 4 and rows["f20"].item_id == 8 and rows["new"].local_status == "present"
    assert rows["f5"].local_status == rows["f7"].local_status == "absent" and len(rows) == 10
    assert (n_items.value, n_seen.value, n_hashed.value, len(hashed)) == (7, 3, 3, 1)
    assert n_scan.value == 2 * 4  # once for its places, once for the contents
    written = set(glob(spark)) - before
    assert written and not any("content" in spark.read.parquet(p).columns for p in written)


def glob(spark):
    """The folders of tables that are written now."""
    from pathlib import Path

    from concordat.sources.workspace import shared_folder

    return [f"file://{p.parent}" for p in Path(shared_folder(spark).removeprefix("file:").replace("//", "/")).rglob("_SUCCESS")]
