"""One item for each place and remote object, whatever claims it."""

import pytest
from pyspark.sql import functions as F

from test_rounds import ITEM, SCAN, SEEN, item, sha

from concordat.operators import identity, rounds

FOLDER = item(1, "", "", parent=None, entry_kind="directory", parent_remote=None, base_sha256=None, local_sha256=None)
ALONE = dict(remote_id=None, parent_remote=None, base_sha256=None, base_size=None, remote_status="absent", remote_sha256=None, remote_size=None, remote_version=None, phase="ready", dirty_generation=1)


def far(remote, name, text="", parent="r1", folder=False, **other):
    row = dict(remote_id=remote, name=name, parent_remote=parent, sha256=sha(text), size=len(text), version=2, removed=False, trashed=False, scope="inside", placeable=True) | other
    return (*row.values(), folder)


def observe(spark, items, seen, conflicts=None):
    rows = spark.createDataFrame(items, ITEM)
    held = None if conflicts is None else spark.createDataFrame([(c,) for c in conflicts], "remote_id string")
    after, queued, listings = rounds.observe_remote(rows, spark.createDataFrame(seen, SEEN + ", is_directory boolean"), held)
    after = {r.remote_id or r.name: r for r in after.collect()}
    return after, {r.remote_id for r in queued.collect()}, {r.remote_id for r in listings.collect()}


def test_new_folders_hold_what_is_in_them_in_the_same_batch(spark):
    seen = [far("x", "a", folder=True), far("y", "b", parent="x", folder=True), far("z", "c", "text", parent="y"), far("w", "d", parent="z"), far("v", "e", parent="nowhere", folder=True), far("u", "f", parent="v")]
    after, queued, listings = observe(spark, [FOLDER], seen)
    assert queued == {"w", "v", "u"} and listings == {"x", "y"}  # below a file, and below what is not known
    assert after["y"].parent_id == after["x"].item_id and after["z"].parent_id == after["y"].item_id and after["x"].parent_id == 1
    assert after["x"].entry_kind == "directory" and after["z"].entry_kind == "file" and len({r.item_id for r in after.values()}) == 4


def test_circles_of_new_folders_stay_queued(spark):
    after, queued, _ = observe(spark, [FOLDER], [far("x", "a", parent="y", folder=True), far("y", "b", parent="x", folder=True), far("z", "c", parent="x")])
    assert set(after) == {"r1"} and queued == {"x", "y", "z"}


def test_names_that_are_taken(spark):
    items = [FOLDER, item(2, "f2", "t"), item(3, "f3", "t"), item(4, "Straße", "t", **ALONE), item(5, "g", "t", **ALONE), item(6, "h", "t", **(ALONE | {"entry_kind": "directory"})), item(7, "f7", "t")]
    seen = [
        far("r2", "F3"),  # another object has the name
        far("n1", "STRASSE"),  # an item of no object has it, spelt differently
        far("r3", "g"),  # an item of no object is in the way of a stored one
        far("n2", "h", "x"),  # ... or of another kind
        far("n4", "new"), far("n3", "NEW"),  # the smallest of two new ones
        far("n5", "g/h"), far("n6", ""), far("n7", "ok", placeable=False), far("r7", "f7", "changed"),
    ]
    after, queued, _ = observe(spark, items, seen)
    assert queued == {"r2", "n1", "r3", "n2", "n4", "n5", "n6", "n7"}
    assert after["n3"].name == "NEW" and after["r2"].name == "f2" and after["r7"].remote_sha256 == sha("changed") and len(after) == 8


def test_adoption_and_conflicts(spark):
    items = [FOLDER, item(2, "a", "t", **ALONE), item(3, "f3", "t"), item(4, "old", "t", entry_kind="directory", excluded=True), item(5, "sub", "t", entry_kind="directory")]
    seen = [far("n", "a", "t"), far("r3", "f3", removed=True), far("r4", "old", folder=True), far("r5", "sub", folder=True)]
    after, queued, listings = observe(spark, items, seen, ["r3"])
    assert after["n"].item_id == 2 and after["n"].local_status == "present" and after["n"].remote_generation == 2 and after["n"].dirty_generation == 2
    assert queued == {"r3"} and not after["r3"].excluded and listings == {"r4"} and not after["r4"].excluded


def local(spark, items, scan):
    rows = spark.createDataFrame(items, ITEM)
    found = spark.createDataFrame(scan, SCAN + ", is_directory boolean")
    after, _, rejected = rounds.observe_local(rows, found, lambda d: d.withColumn("sha256", F.sha2("content", 256)))
    return after.collect(), rejected.collect()


def test_places_before_inodes(spark):
    items = [FOLDER, item(2, "f2", "two"), item(3, "f3", "three"), item(4, "f4", "four"), item(5, "dir", "", entry_kind="directory", base_sha256=None, local_sha256=None), item(6, "f6", "six"), item(7, "f7", "seven", inode=6)]
    scan = [
        (1, "f2", 1, 99, 9, 9, 3, "new", False),  # saved by replacement
        (1, "f4", 1, 3, 3, 3, 5, "three", False),  # f3 moved onto f4
        (1, "dir", 1, 50, 1, 1, 1, "x", False),  # a file where a folder was
        (1, "m6", 1, 6, 6, 6, 3, "six", False),  # an inode of two items
        (1, "new", 1, 70, 1, 1, 0, None, True),
    ]
    after, rejected = local(spark, items, scan)
    rows = {r.name: r for r in after}
    assert len(rows) == len(after) == 9 and [r.item_id for r in rejected] == [5]
    assert rows["f2"].item_id == 2 and rows["f2"].inode == 99 and rows["f2"].local_sha256 == sha("new")
    assert rows["f4"].item_id == 4 and rows["f4"].local_sha256 == sha("three") and rows["f3"].local_status == "absent"
    assert rows["dir"].local_status == "present" and rows["dir"].dirty_generation == 0 and rows["m6"].item_id == 9 - 1
    assert rows["f6"].local_status == rows["f7"].local_status == "absent" and rows["new"].entry_kind == "directory"


def test_moved_and_unreadable(spark):
    items = [FOLDER, item(2, "f2", "two"), item(3, "sub", "", entry_kind="directory"), item(4, "f4", "four"), item(5, "f5", "five")]
    scan = [(1, "a", 1, 2, 2, 2, 3, "two", False), (1, "b", 1, 2, 2, 2, 3, "two", False), (1, "moved", 1, 3, 3, 3, 0, None, True), (1, "f4", 1, 4, 5, 5, 9, None, False), (1, "x", 1, 80, 1, 1, 1, None, False)]
    rows = {r.name: r for r in local(spark, items, scan)[0]}
    assert rows["a"].item_id == 2 and rows["b"].item_id > 5 and rows["moved"].item_id == 3 and rows["moved"].phase == "ready"
    assert (rows["f4"].local_status, rows["f4"].phase, rows["f4"].local_sha256) == ("unknown", "waitingEvidence", sha("four"))
    assert (rows["x"].local_status, rows["x"].phase, rows["x"].local_sha256) == ("unknown", "waitingEvidence", None) and rows["f5"].local_status == "absent"


def test_uniqueness_is_checked(spark):
    items = spark.createDataFrame([FOLDER, item(2, "f2", "t"), item(3, "f2", "t")], ITEM)
    with pytest.raises(identity.DuplicateEntity, match="place"):
        identity.check_unique(items)
    with pytest.raises(identity.DuplicateEntity, match="remote_id"):
        identity.check_unique(spark.createDataFrame([FOLDER, item(2, "a", "t", remote_id="r"), item(3, "b", "t", remote_id="r")], ITEM))


def test_held_back_decisions(spark):
    items = spark.createDataFrame([FOLDER, item(2, "sub", "", entry_kind="directory", local_status="present", remote_status="absent", remote_id=None), item(3, "f3", "t", **ALONE), item(4, "f4", "t", parent=2, **ALONE), item(5, "f5", "t", **ALONE)], ITEM)
    scan = spark.createDataFrame([(1, "f3", 1, 3, 3, 3, 1, "t"), (2, "f4", 1, 4, 4, 4, 1, "t"), (1, "f5", 1, 5, 5, 5, 1, "t")], SCAN)
    none = spark.createDataFrame([], SEEN)
    digest = lambda d: d.withColumn("sha256", F.sha2("content", 256))
    scheduled = spark.createDataFrame([(5,)], "item_id long")
    work = lambda **o: {r.item_id for r in rounds.run(items, none, scan, digest, **o).work.collect()}
    assert work() == {3, 4, 5}
    assert work(blocked=spark.createDataFrame([("sub",)], "path string"), scheduled=scheduled) == {3}
    assert work(scanning=True) == {3, 5}  # below a folder that is not there far away
