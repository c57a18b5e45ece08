"""Scans of real folders, listings, change pages, snapshots, and the stream against the batch."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from concordat.operators.feed import latest
from concordat.sources import scan
from concordat.sources.snapshots import Snapshots
from concordat.streaming.feed_stream import rebuild, replay


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in {"a.txt": "one", "d/b.txt": "two", "d/e/c": "", ".git/config": "x", "d/.git": "kept", ".hidden": "h"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = scan.files(spark, str(tmp_path))
    rows = {r.path: r for r in found.collect()}
    assert set(rows) == {"a.txt", "d/b.txt", "d/e/c", "d/.git", ".hidden"}
    assert (rows["d/e/c"].parent, rows["d/e/c"].name, rows["d/e/c"].size) == ("d/e", "c", 0)
    assert rows["a.txt"].mtime == (tmp_path / "a.txt").stat().st_mtime_ns
    every = {r.path: r.is_directory for r in scan.entries(spark, str(tmp_path)).collect()}
    assert every["d"] and every["d/e"] and ".git" not in every and len(every) == 7
    got = scan.digests(str(tmp_path), found.where("path = 'd/b.txt'")).collect()
    assert [(r.path, r.sha256) for r in got] == [("d/b.txt", hashlib.sha256(b"two").hexdigest())]


def test_emptiness(spark, tmp_path):
    assert scan.is_empty(spark, str(tmp_path))
    (tmp_path / ".git").mkdir()
    assert scan.is_empty(spark, str(tmp_path))
    (tmp_path / ".x").touch()
    assert not scan.is_empty(spark, str(tmp_path))


def page(path, **content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(content))


def test_listing_follows_pages(spark, tmp_path):
    scan.register(spark)
    page(tmp_path / "d1/start.json", files=[{"id": "1", "name": "a"}], nextPageToken="p2")
    page(tmp_path / "d1/p2.json", files=[{"id": "2", "name": "b", "size": "7"}])
    page(tmp_path / "d2/start.json", files=[])
    got = spark.read.format("listing").option("path", str(tmp_path)).load()
    assert sorted((r.directory, r.id, r["size"]) for r in got.collect()) == [("d1", "1", None), ("d1", "2", "7")]
    assert got.rdd.getNumPartitions() == 2


@pytest.mark.parametrize("bad", [{"incompleteSearch": True}, {"nextPageToken": ""}, {"nextPageToken": "start"}])
def test_bad_listing_pages_fail(spark, tmp_path, bad):
    scan.register(spark)
    page(tmp_path / "d1/start.json", files=[], **bad)
    with pytest.raises(Exception, match="incomplete|empty|advance"):
        spark.read.format("listing").option("path", str(tmp_path)).load().collect()


def test_change_pages_as_a_stream(spark, tmp_path):
    scan.register(spark)
    pages = tmp_path / "pages"
    change = lambda k, n: {"fileId": f"f{k}", "file": {"id": f"f{k}", "name": n}}
    page(pages / "start.json", changes=[change(1, "a"), change(2, "b")], nextPageToken="t2")
    page(pages / "t2.json", changes=[change(1, "c")], newStartPageToken="t3")
    inbox = Snapshots(spark, f"file://{tmp_path}/inbox")

    def run():
        raw = spark.readStream.format("changes").option("path", str(pages)).load()
        own = raw.select(F.get_json_object("payload", "$.fileId").alias("id"), "seq", F.get_json_object("payload", "$.file.name").alias("name"))
        query = own.writeStream.foreachBatch(lambda df, n: __import__("concordat.streaming.feed_stream", fromlist=["x"]).fold_into(inbox, ["id"], ["seq"])(df, n)).option("checkpointLocation", f"file://{tmp_path}/check").start()
        query.processAllAvailable()
        query.stop()

    run()
    assert {r.id: (r.name, r.n_events) for r in inbox.read().collect()} == {"f1": ("c", 2), "f2": ("b", 1)}
    page(pages / "t3.json", changes=[change(3, "d")], newStartPageToken="t4")
    run()
    assert {r.id: r.name for r in inbox.read().collect()} == {"f1": "c", "f2": "b", "f3": "d"}


def test_snapshots_are_idempotent_by_batch(spark, tmp_path):
    own = Snapshots(spark, f"file://{tmp_path}/s")
    assert own.version() == 0 and own.read() is None
    own.commit(spark.range(3), 0)
    own.commit(spark.range(5), 0)  # a replayed batch
    assert own.version() == 1 and own.read().count() == 3
    own.commit(spark.range(5), 1)
    assert own.read().count() == 5 and own.read(1).count() == 3


def test_stream_of_many_batches_equals_batch(spark, tmp_path):
    here = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(here).select("user_id", "event_id", "event_type")
    events.repartition(5).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    inbox = Snapshots(spark, f"file://{tmp_path}/inbox")
    replay(stream, inbox, f"file://{tmp_path}/check", ["user_id"], ["event_id"])
    want = sorted(latest(events, ["user_id"], ["event_id"]).collect())
    assert inbox.version() == 5 and sorted(inbox.read().select("user_id", "event_id", "event_type", "n_events").collect()) == want
    replay(stream, inbox, f"file://{tmp_path}/check", ["user_id"], ["event_id"])  # nothing new
    assert inbox.version() == 5
    rebuild(events.dropDuplicates(["user_id"]).select("user_id", "event_type"), inbox, {"event_id": 0})
    assert inbox.version() == 6


def test_stream_of_a_folder_of_part_files(spark, tmp_path):
    from concordat.plans import feeds

    given = "/root/testdata/sf0.001"
    spark.read.parquet(f"{given}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = sorted(map(repr, feeds.stream_replay(spark, given).collect()))
    assert want and sorted(map(repr, feeds.stream_replay(spark, str(tmp_path)).collect())) == want


def test_a_big_folder_is_split_below_the_top(spark, tmp_path):
    for k in range(12):
        (tmp_path / f"top/d{k}/e").mkdir(parents=True)
        (tmp_path / f"top/d{k}/e/f").write_text("x")
    spark.dataSource.register(scan.FolderSource)
    df = spark.read.format("folder").option("path", str(tmp_path)).option("partitions", 8).load()
    assert df.rdd.getNumPartitions() >= 12
    assert sorted(r.path for r in df.collect()) == sorted(["top", *(f"top/d{k}{p}" for k in range(12) for p in ("", "/e", "/e/f"))])


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    from concordat.streaming.feed_stream import fold_into

    inbox = Snapshots(spark, f"file://{tmp_path}/inbox", keep=2)
    fold = fold_into(inbox, ["id"], ["seq"])
    fold(spark.range(500).select("id", F.lit(1).alias("seq"), F.lit("a").alias("name")), 0)
    fold(spark.createDataFrame([(7, 2, "b"), (999, 1, "c")], "id long, seq int, name string"), 1)
    fold(spark.createDataFrame([(7, 1, "late")], "id long, seq int, name string"), 2)
    fold(spark.createDataFrame([(8, 9, "again")], "id long, seq int, name string"), 2)  # replayed
    rows = {r.id: (r.seq, r.name, r.n_events) for r in inbox.read().collect()}
    assert len(rows) == 501 and rows[7] == (2, "b", 3) and rows[8] == (1, "a", 1) and rows[999] == (1, "c", 1)
    folders = inbox.head()["tables"]["table"]["folders"].values()
    assert sum(f.startswith("v-1-") for f in folders) >= 29 and sum(f.startswith("v-3-") for f in folders) == 1
    assert not (tmp_path / "inbox/commit-1").exists() and (tmp_path / "inbox/commit-2").exists()


def test_page_items_and_cursor_are_one_commit(spark, tmp_path):
    from concordat.sources.snapshots import StaleCursor
    from concordat.streaming.feed_stream import consume_page

    state = Snapshots(spark, f"file://{tmp_path}/state")
    items = spark.createDataFrame([("a", "present", 1, 0), ("b", "present", 1, 0)], "id string, remote_status string, remote_generation int, dirty_generation int")
    state.commit_all({"items": items}, cursor="t1")
    page = spark.createDataFrame([("a", 1, "x")], "id string, seq int, name string")
    consume_page(state, page, "id", ["seq"], 0, "t2", expected="t1")
    assert state.cursor() == "t2" and {r.id: r.remote_status for r in state.read(table="items").collect()} == {"a": "unknown", "b": "present"}
    with pytest.raises(StaleCursor):
        consume_page(state, page, "id", ["seq"], 1, "t3", expected="t1")
    assert state.version() == 2 and state.read(table="inbox").count() == 1


def test_recovery_without_a_cursor(spark, tmp_path):
    from concordat.streaming.feed_stream import recover

    state, did, waiting = Snapshots(spark, f"file://{tmp_path}/r"), [], [3]
    one = lambda n: spark.range(n).select(F.col("id"), F.lit("pending").alias("state"))

    def wave():
        if waiting[0]:
            waiting[0] -= 1
            did.append("wave")
            return True
        return False

    none = lambda: (one(0), one(waiting[0]), one(0), one(0))
    assert recover(state, wave, lambda: did.append("apply"), none, lambda: "t0") == 3
    assert state.cursor() == "t0" and did == ["apply", "wave", "apply", "wave", "apply", "wave", "apply", "apply"]
    with pytest.raises(RuntimeError, match="2 remote"):
        recover(state, lambda: False, lambda: None, lambda: (one(2), one(0), one(0), one(0)), lambda: "t9")
    assert state.cursor() == "t0"


def _folding():
    from concordat.streaming.feed_stream import folding

    return folding(["id"], ["seq"])


ROW = "id long, seq int, name string, n_events long"


def test_a_lost_race_is_folded_onto_the_winner(spark, tmp_path):
    first, second = (Snapshots(spark, f"file://{tmp_path}/race") for _ in range(2))
    fold = _folding()
    rows = lambda *r: spark.createDataFrame(list(r), ROW)
    first.commit_all(folds={"table": (rows((1, 1, "a", 1)), ["id"], fold)}, cursor="t1")
    tries = []

    def slow(stored, new):
        if not tries:  # while this one folds, the other commits
            second.commit_all(folds={"table": (rows((1, 5, "winner", 1), (3, 1, "c", 1)), ["id"], fold)}, batch=0, writer="other")
        tries.append(1)
        return fold(stored, new)

    first.commit_all(folds={"table": (rows((1, 2, "late", 1), (2, 1, "b", 1)), ["id"], slow)}, batch=0)
    assert len(tries) == 2 and first.version() == 3
    assert {r.id: (r.name, r.n_events) for r in second.read().collect()} == {1: ("winner", 3), 2: ("b", 1), 3: ("c", 1)}
    assert {r.id: r.name for r in first.read(2).collect()} == {1: "winner", 3: "c"}  # the winner's version is as it was
    assert first.batch() == 0 and first.batch("other") == 0
    named = {f.split("/")[0] for v in (1, 2, 3) for f in first.head(v)["tables"]["table"]["folders"].values()}
    assert {p.name for p in (tmp_path / "race").iterdir() if p.name.startswith(("v-", ".draft-"))} == named


def test_replaced_tables_and_cursors_do_not_win_blindly(spark, tmp_path):
    from concordat.sources.snapshots import LostRace, StaleCursor

    one, two = (Snapshots(spark, f"file://{tmp_path}/whole") for _ in range(2))
    one.commit_all({"table": spark.range(3)}, cursor="t1")
    once = []

    def meddling(stored):
        if not once:
            once.append(two.commit(spark.range(7), table="table"))
        return stored.union(spark.range(100, 101))

    one.commit(meddling)
    assert sorted(r.id for r in one.read().collect()) == [*range(7), 100]

    def other(stored):
        if len(once) == 1:
            once.append(two.commit_all({"table": spark.range(2)}, cursor="t2"))
        return spark.range(1)

    with pytest.raises(LostRace):
        one.commit_all({"free": other, "table": spark.range(9)})
    del once[1:]
    with pytest.raises(StaleCursor):
        two.commit_all(cursor="t1")
        one.commit_all({"free": other}, expected="t1", cursor="t3")
    assert one.read().count() == 2 and one.read(table="free") is None


def test_emptied_buckets_read_as_empty(spark, tmp_path):
    own = Snapshots(spark, f"file://{tmp_path}/empty")
    drop = lambda stored, new: new.limit(0) if stored is None else stored.join(new, "id", "left_anti")
    add = lambda stored, new: new if stored is None else stored.unionByName(new)
    ids = spark.range(40)
    own.commit_all(folds={"table": (ids, ["id"], add)})
    own.commit_all(folds={"table": (spark.range(1, 40), ["id"], drop)})
    assert [r.id for r in own.read().collect()] == [0]
    own.commit_all(folds={"table": (ids, ["id"], drop)})
    assert own.read().count() == 0 and own.read().columns == ["id"]
    own.commit_all(folds={"table": (spark.range(5), ["id"], add)})
    assert own.read().count() == 5
    with pytest.raises(ValueError, match="kept by"):
        own.commit_all(folds={"table": (spark.range(5).withColumnRenamed("id", "x"), ["x"], add)})


def test_buckets_grow_with_the_table(spark, tmp_path):
    own = Snapshots(spark, f"file://{tmp_path}/grown", leaf_bytes=2000)
    fold = _folding()
    many = spark.range(3000).select("id", F.lit(1).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("name"), F.lit(1).cast("long").alias("n_events"))
    own.commit_all(folds={"table": (many, ["id"], fold)})
    assert len(own.head()["tables"]["table"]["leaves"]) == 32  # one bucket for each of five bits
    own.commit_all(folds={"table": (many.limit(1).withColumn("seq", F.lit(2)), ["id"], fold)})
    leaves = own.head()["tables"]["table"]["leaves"]
    assert len(leaves) > 32 and sum(n.startswith("5-") for n in leaves) == 31  # only the touched one is split
    own.commit_all(folds={"table": (many.withColumn("seq", F.lit(3)), ["id"], fold)})
    entry = own.head()["tables"]["table"]
    assert min(int(n.split("-")[0]) for n in entry["leaves"]) > 5 and max(entry["bytes"].values()) < 8000
    got = own.read().collect()
    assert len(got) == len({r.id for r in got}) == 3000 and all(r.n_events in (2, 3) and r.seq == 3 for r in got)


def test_files_that_cannot_be_read_are_rows(spark, tmp_path, monkeypatch):
    for name in ("good", "bad", "gone"):
        (tmp_path / name).write_text(name)
    (tmp_path / "folder").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "good")
    wanted = spark.createDataFrame([(n,) for n in ("good", "folder", "link", "missing", "a/b")], "path string")
    got = {r.path: r for r in scan.readings(str(tmp_path), wanted).collect()}
    assert got["good"].error is None and got["good"].before_size == got["good"].after_size == 4 and got["good"].sha256 == hashlib.sha256(b"good").hexdigest()
    assert all(got[n].sha256 is None and got[n].error for n in ("folder", "link", "missing", "a/b"))
    good, others = scan.settled(scan.readings(str(tmp_path), wanted))
    assert [r.path for r in good.collect()] == ["good"] and others.count() == 4
    versions = iter([[1, 2, 3, 4, 5], [1, 2, 9, 4, 5]])
    monkeypatch.setattr(scan, "_version", lambda seen: next(versions))
    digest, error, before, after = scan._read(str(tmp_path), "bad")
    assert digest and error is None and before != after
    row = spark.createDataFrame([("bad", "x", None, 1, 2, 3, 4, 5, 1, 2, 9, 4, 5)], scan._READINGS)
    assert scan.settled(row)[1].first().error == "changed while it was read"


def _opened(df):
    return df._jdf.queryExecution().executedPlan().execute().getNumPartitions()


def test_only_what_is_asked_for_is_listed(spark, tmp_path):
    for at in ("a/b/c", "a/x", "d/e", ".git/objects"):
        (tmp_path / "in" / at).mkdir(parents=True)
        (tmp_path / "in" / at / "f.txt").write_text(at)
    (tmp_path / "in/link").symlink_to(tmp_path / "in/a")
    root = f"{tmp_path}/in"
    everything = {(r.path, r.parent) for r in scan.entries(spark, root).collect()}
    paths = lambda **o: {r.path for r in scan.entries(spark, root, **o).collect()}
    assert paths(below="a") == {p for p, _ in everything if p.startswith("a/")} and len(paths(below="a")) == 5
    assert paths(below="a/b") == {"a/b/c", "a/b/c/f.txt"} and not paths(below="none") | paths(below="../in") | paths(below=".git") | paths(below="link")
    assert paths(parents=["d", "a/x", "none", "d"]) == {p for p, above in everything if above in ("d", "a/x")}
    assert paths(parents=[]) == set() and {"a", "d", "link"} <= paths(parents=[""])
    both = scan.entries(spark, root, parents=["d"]).union(scan.entries(spark, root, below="a/b")).union(scan.entries(spark, root))
    assert both.count() == 1 + 2 + len(everything)
    assert _opened(scan.entries(spark, root, parents=["d", "a/x", "none"])) == 2 and _opened(scan.entries(spark, root, below="a/x")) == 1
    for d in ("one", "two", "three"):
        (tmp_path / "pages" / d).mkdir(parents=True)
        (tmp_path / "pages" / d / "start.json").write_text(json.dumps({"files": [{"id": d, "name": d}]}))
    spark.dataSource.register(scan.ListingSource)
    pages = lambda *chosen: spark.read.format("listing").options(path=f"{tmp_path}/pages", directories=json.dumps(chosen)).load()
    assert [r.id for r in pages("two").collect()] == ["two"] and _opened(pages("two")) == 1
    assert sorted(r.id for r in pages("one", "four", "..", "three").collect()) == ["one", "three"] and pages().count() == 0


def test_files_are_published_together(spark, tmp_path):
    from concordat.sources.files import write_files

    rows = spark.range(20).selectExpr("concat('d', id % 3, '/', id, '.txt') as path", "cast(id as string) as content").repartition(4)
    write_files(rows, str(tmp_path))
    held = lambda: {str(p.relative_to(tmp_path)): p.read_text() for p in tmp_path.rglob("*") if p.is_file()}
    want = {f"d{k % 3}/{k}.txt": str(k) for k in range(20)}
    assert held() == want
    late = rows.selectExpr("concat('e/', path) as path", "if(path = 'd1/7.txt', raise_error('no'), content) as content")
    twice = spark.createDataFrame([("g/1", "a"), ("g/1", "b")], "path string, content string").repartition(2)
    for bad in (late, rows.limit(1), twice, spark.createDataFrame([("../x", "a")], "path string, content string"), spark.createDataFrame([("h/1", "a"), (None, "b")], "path string, content string")):
        with pytest.raises(Exception):  # noqa: B017
            write_files(bad, str(tmp_path))
        assert held() == want and not [p for p in tmp_path.iterdir() if p.name.startswith(".staging")]
