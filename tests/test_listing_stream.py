"""Full listings as a stream that feeds itself, and the hand-over to the feed."""

import json
import random

import pytest

from concordat.sources.snapshots import Snapshots
from concordat.streaming.listing_stream import FOLDER, catch_up, list_all


def write_pages(folder, tree, size=2):
    """``tree``: {directory: [(id, is_directory)]}; page files of ``size`` files each."""
    for directory, files in tree.items():
        (folder / directory).mkdir(parents=True)
        parts = [files[k : k + size] for k in range(0, len(files), size)] or [[]]
        for k, part in enumerate(parts):
            page = {"files": [{"id": i, "name": f"n{i}", "mimeType": FOLDER if d else "text/plain", "version": "1"} for i, d in part]}
            if k + 1 < len(parts):
                page["nextPageToken"] = f"p{k + 1}"
            (folder / directory / ("start.json" if not k else f"p{k}.json")).write_text(json.dumps(page))


def a_tree(n=24):
    rng, tree, folders = random.Random(2), {"root": []}, ["root"]
    for k in range(n):
        above, is_folder = rng.choice(folders), rng.random() < 0.4
        tree[above].append((f"i{k}", is_folder))
        if is_folder:
            folders.append(f"i{k}")
            tree[f"i{k}"] = []
    return tree


def listed(found):
    return {(r.id, r.parent_id) for r in found.collect()}


@pytest.mark.parametrize("limit", [3, 64])
def test_it_ends_by_itself(spark, tmp_path, limit):
    tree = a_tree()
    write_pages(tmp_path / "pages", tree)
    state = Snapshots(spark, f"file://{tmp_path}/state")
    found = list_all(spark, f"{tmp_path}/pages", "root", state, f"{tmp_path}/waves", f"file://{tmp_path}/check", "t0", limit)
    assert listed(found) == {(i, above) for above, files in tree.items() for i, _ in files}
    assert {r.state for r in state.read(table="jobs").collect()} == {"complete"} and json.loads(state.cursor())["token"] == "t0"
    waves = len(list((tmp_path / "waves").glob("*.json")))
    assert json.loads(state.cursor())["wave"] == waves
    again = list_all(spark, f"{tmp_path}/pages", "root", state, f"{tmp_path}/waves", f"file://{tmp_path}/check", "t0", limit)
    assert listed(again) == listed(found) and json.loads(state.cursor())["wave"] == waves  # nothing is open


def test_it_goes_on_after_a_failure(spark, tmp_path):
    tree = {"root": [("a", True), ("b", True), ("f", False)], "a": [("c", True)], "b": [("g", False)], "c": [("h", False)]}
    write_pages(tmp_path / "pages", tree)
    page = tmp_path / "pages/c/start.json"
    whole = page.read_text()
    page.write_text(json.dumps({"incompleteSearch": True}))
    state = Snapshots(spark, f"file://{tmp_path}/state")
    go = lambda: list_all(spark, f"{tmp_path}/pages", "root", state, f"{tmp_path}/waves", f"file://{tmp_path}/check")
    with pytest.raises(Exception, match="incompleteSearch"):
        go()
    held = listed(state.read(table="entries"))
    assert ("c", "a") in held and ("h", "c") not in held
    page.write_text(whole)
    assert listed(go()) == {(i, above) for above, files in tree.items() for i, _ in files}


def test_stale_tokens_start_over_and_missing_folders_fail(spark, tmp_path):
    write_pages(tmp_path / "pages", {"root": [("a", False), ("b", False), ("c", False)]})
    (tmp_path / "pages/root/p1.json").write_text(json.dumps({"error": {"code": 400}}))
    state = Snapshots(spark, f"file://{tmp_path}/state")
    from concordat.streaming import listing_stream

    commit, mended = state.commit_all, []

    def mending(*a, **k):
        done = commit(*a, **k)
        if json.loads(state.cursor())["wave"] == 2 and not mended:  # the stale page was met; the next try finds a whole one
            mended.append((tmp_path / "pages/root/p1.json").write_text(json.dumps({"files": [{"id": "d", "name": "d"}]})))
        return done

    state.commit_all = mending
    found = list_all(spark, f"{tmp_path}/pages", "root", state, f"{tmp_path}/waves", f"file://{tmp_path}/check")
    assert {i for i, _ in listed(found)} == {"a", "b", "d"} and mended and json.loads(state.cursor())["wave"] == 4
    other = Snapshots(spark, f"file://{tmp_path}/other")
    with pytest.raises(Exception, match="nowhere"):
        list_all(spark, f"{tmp_path}/pages", "nowhere", other, f"{tmp_path}/waves2", f"file://{tmp_path}/check2")
    assert listing_stream.WAVE == 64


def test_a_rejected_cursor_hands_over_to_a_listing_and_then_to_the_feed(spark, tmp_path):
    write_pages(tmp_path / "pages", {"root": [("a", False), ("b", True)], "b": [("c", False)]})
    feed = tmp_path / "feed"
    feed.mkdir()
    page = lambda *ids, **more: json.dumps({"changes": [{"fileId": i, "file": {"id": i, "name": i}} for i in ids], **more})
    (feed / "old.json").write_text(json.dumps({"error": {"code": 400, "message": "Invalid Value for pageToken"}}))
    (feed / "t5.json").write_text(page("a", "x", nextPageToken="t6"))
    (feed / "t6.json").write_text(page("x", newStartPageToken="t7"))
    state, inbox = (Snapshots(spark, f"file://{tmp_path}/{n}") for n in ("state", "inbox"))
    go = lambda cursor: catch_up(spark, str(feed), f"{tmp_path}/pages", "root", cursor, "t5", inbox, state, f"file://{tmp_path}/work")
    found, token = go("old")
    assert listed(found) == {("a", "root"), ("b", "root"), ("c", "b")} and token == "t5"
    assert {r.remote_id: r.n_events for r in inbox.read().collect()} == {"a": 1, "x": 2}
    found, token = go("t5")  # a valid cursor needs no listing, and nothing new is there
    assert found is None and token == "t5" and inbox.read().count() == 2
    (feed / "bad.json").write_text(json.dumps({"error": {"code": 500}}))
    with pytest.raises(Exception, match="cannot be read"):
        go("bad")


def test_as_many_waves_as_levels_and_pages(spark, tmp_path):
    """Of 120 folders of one level, all are listed in one wave, by tasks of several pages."""
    tree = {"root": [(f"d{k}", True) for k in range(120)]} | {f"d{k}": [(f"f{k}", False)] for k in range(120)}
    write_pages(tmp_path / "pages", tree, size=200)
    state = Snapshots(spark, f"file://{tmp_path}/state")
    found = list_all(spark, f"{tmp_path}/pages", "root", state, f"{tmp_path}/waves", f"file://{tmp_path}/check")
    assert found.count() == 240 and json.loads(state.cursor())["wave"] == 2
    assert 1 < len(list((tmp_path / "waves/1.json").glob("part-*"))) <= 4
