"""Small cases that the tables do not hold, and the plans of joins that must not be nested loops."""

import pytest
from pyspark.sql import functions as F

from concordat.functions import paths, text, transfer
from concordat.operators import diff, feed, gates, issues, metrics, operations, pacing, reconcile, store, tree
from concordat.plans.catalog import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id long, parent_id long, name string, ready boolean")


def test_climb_cases(spark):
    rows = [(0, None, "root", True), (1, 0, "a", True), (2, 1, "b", False), (3, 2, "c", True), (4, 99, "lost", True), (5, 4, "d", True), (6, 7, "x", True), (7, 6, "y", True)]
    root = spark.createDataFrame([(0,)], "id long")
    got = {r.id: (r.outcome, r.path, r.depth, r.ready) for r in tree.climb(nodes(spark, rows), root, 16).collect()}
    assert got[0] == ("reached", "", 0, True) and got[3] == ("reached", "a/b/c", 3, False)
    assert got[4][:2] == ("broken", "lost") and got[5][:2] == ("broken", "lost/d")
    assert got[6][0] == got[7][0] == "deep"


def test_deep_chain_and_limit(spark):
    rows = [(k, k - 1 if k else None, f"n{k}", True) for k in range(200)]
    root = spark.createDataFrame([(0,)], "id long")
    found = tree.climb(nodes(spark, rows), root, 128)
    assert found.where("outcome = 'reached'").count() == 129
    whole = tree.climb(nodes(spark, rows), root, 256)
    assert whole.where("outcome = 'reached'").count() == 200 and whole.where("id = 199").first().path == "/".join(f"n{k}" for k in range(1, 200))


def test_nested_exclusions_stand_once(spark):
    rows = [(0, None, "r", True), (1, 0, "a", True), (2, 1, "b", True), (3, 2, "c", True)]
    flags = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(r.id for r in tree.excluded(nodes(spark, rows), flags).collect()) == [1, 2, 3]


def test_empty_tree(spark):
    none = nodes(spark, [])
    assert tree.paths(none, spark.createDataFrame([], "id long")).count() == 0


def test_gate_is_an_equi_join(spark):
    rows = spark.createDataFrame([(1, "a/b"), (2, "ab"), (3, "a"), (4, "a/b/c")], "id long, path string")
    gate = spark.createDataFrame([("a/b",)], "path string")
    left = gates.open_rows(rows, gate, "id")
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert "NestedLoop" not in plan(left) and "Cartesian" not in plan(left)
    pairs = gates.overlaps(rows, "id")
    assert sorted((r.id, r.partners, r.smallest) for r in pairs.collect()) == [(1, 2, 1), (3, 2, 1), (4, 2, 1)]
    assert "NestedLoop" not in plan(pairs)


def test_prefix_range_is_pushed_down(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").where(paths.with_prefix(F.col("url"), "https://a")).select("page_id")
    assert "PushedFilters" in plan(df) and "GreaterThanOrEqual(url,https://a)" in plan(df) and "html" not in plan(df)


def test_fast_path_reads_no_content(spark):
    from concordat.plans.sides import scanned

    df = scanned(spark, "/root/testdata/sf0.001")
    assert "text" not in plan(df)


@pytest.mark.parametrize(("a", "b"), [("same", "same"), ("a", "A"), ("é", "é"), ("Straße", "STRASSE")])
def test_name_keys(spark, a, b):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(text.name_key("a").alias("a"), text.name_key("b").alias("b")).first()
    assert row.a == row.b


@pytest.mark.parametrize(("name", "ok"), [("../escape", False), ("/absolute", False), (".", False), ("..", False), ("nul\0name", False), ("", False), ("a" * 255, True), ("a" * 256, False), ("é" * 128, False), ("fine", True)])
def test_names(spark, name, ok):
    assert spark.createDataFrame([(name,)], "n string").select(text.valid_name(F.col("n")).alias("x")).first().x is ok


def test_paths(spark):
    lit = F.lit
    assert one(spark, paths.normalised(lit("/a/./b/../c//"))) == "/a/c"
    assert one(spark, paths.ancestors_or_self(lit("a//b/c"))) == ["a", "a/b", "a/b/c"] and one(spark, paths.ancestors_or_self(lit(""))) == []
    assert one(spark, paths.parent(lit("a/b/c"))) == "a/b" and one(spark, paths.base_name(lit("a/b/c"))) == "c" and one(spark, paths.parent(lit("a"))) == ""
    assert one(spark, paths.rebased(lit("ab/c"), lit("a"), lit("z"))) == "ab/c" and one(spark, paths.rebased(lit("a"), lit("a"), lit("z"))) == "z"
    assert one(spark, paths.overlapping(lit("a/b"), lit("a"))) and not one(spark, paths.overlapping(lit("ab"), lit("a")))


def test_ranges(spark):
    offset = lambda h: one(spark, transfer.confirmed_offset(F.lit(h).cast("string"), F.lit(100)))
    assert [offset(h) for h in (None, "bytes=0-0", "bytes=0-99", "bytes=0-100", "bytes=1-5", "bytes=0-x", "")] == [0, 1, 100, None, None, None, None]
    assert one(spark, transfer.chunk_starts(F.lit(0).cast("long"), F.lit(8 * 1024 * 1024 + 1).cast("long"))) == [0, 8 * 1024 * 1024]
    assert one(spark, transfer.chunk_starts(F.lit(5).cast("long"), F.lit(5).cast("long"))) == []


def test_hard_links_are_not_renames(spark):
    cols = "{} long, root_id long, kind string, device long, inode long, parent_id long, name string"
    stored = spark.createDataFrame([(1, 1, "file", 1, 9, 0, "a"), (2, 1, "file", 1, 9, 0, "b"), (3, 1, "file", 1, 8, 0, "c"), (4, 1, "directory", 1, 7, 0, "d"), (5, 1, "file", 1, 6, 0, "e")], cols.format("item_id"))
    seen = spark.createDataFrame([(11, 1, "file", 1, 9, 0, "z"), (12, 1, "file", 1, 9, 0, "b"), (13, 1, "file", 1, 8, 5, "c"), (14, 1, "directory", 1, 7, 2, "q"), (15, 1, "file", 1, 6, 3, "copy"), (16, 1, "file", 1, 6, 0, "e")], cols.format("scan_id"))
    got = {(r.scan_id, r.item_id, r.how) for r in diff.renames(seen, stored, seen.select("parent_id", "name")).collect()}
    assert got == {(12, 2, "inPlace"), (13, 3, "moved"), (14, 4, "moved"), (16, 5, "inPlace")}


def test_cas_null_generations(spark):
    now = spark.createDataFrame([(1, None, "p"), (2, 3, "p"), (3, 3, "p")], "id long, g long, phase string")
    receipts = spark.createDataFrame([(1, None, "q"), (2, 4, "q")], "id long, expected_g long, new_phase string")
    got = {r.id: (r.phase, r.outcome) for r in store.compare_and_swap(now, receipts, "id", ["g"], ["phase"]).collect()}
    assert got == {1: ("q", "applied"), 2: ("p", "stale"), 3: ("p", None)}


def test_upsert_twice_is_stable(spark):
    now = spark.createDataFrame([(1, "a", 1)], "id long, name string, g long")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id long, name string")
    first = store.upsert(now, new, ["id"], bump="g").drop("effect")
    again = store.upsert(first, new, ["id"], bump="g").drop("effect")
    assert sorted(map(tuple, first.collect())) == [(1, "b", 2), (2, "c", 1)] and sorted(map(tuple, again.select("id", "name").collect())) == [(1, "b"), (2, "c")]


def test_duplicate_is_rejected_alone(spark):
    rows = spark.createDataFrame([(1, "valid-a"), (2, "valid-a"), (3, "valid-b")], "n long, name string")
    valid, rejected = store.isolate(rows, F.lit(None).cast("string"), ["name"], "n")
    assert sorted(r.n for r in valid.collect()) == [1, 3] and [(r.n, r.problem) for r in rejected.collect()] == [(2, "duplicate")]


def test_issue_pages(spark):
    rows = spark.createDataFrame([("a", "bad", 9), ("b", "upload", 5)], "issue_id string, stage string, last_seen long")
    page, total, following = issues.page(rows, 1, 0)
    assert page.count() == 0 and (total, following) == (2, 1)
    page, total, following = issues.page(rows, 1, 1)
    assert [r.issue_id for r in page.collect()] == ["b"] and following is None
    for limit, offset in ((0, 0), (1001, 0), (1, -1)):
        with pytest.raises(ValueError):
            issues.page(rows, limit, offset)


def test_issue_merge(spark):
    new = spark.createDataFrame([(1, "item:1", "upload", 5, 5, 1, "network")], "root_id long, subject string, stage string, first_seen long, last_seen long, occurrence_count long, category string")
    old = spark.createDataFrame([(1, "item:1", "upload", 2, 3, 4, "unknown")], new.schema)
    assert tuple(issues.merge(old, new, ["root_id", "subject", "stage"], ["category"]).first()) == (1, "item:1", "upload", 2, 5, 5, "network")


def test_completed_stays_completed(spark):
    log = spark.createDataFrame([("x", 1, "inFlight"), ("x", 2, "completed"), ("x", 3, "unknownOutcome"), ("y", 1, "inFlight"), ("y", 2, "unknownOutcome")], "id string, n long, state string")
    assert {r.id: r.state for r in operations.fold_states(log, "id", "n").collect()} == {"x": "completed", "y": "unknownOutcome"}


def test_versions(spark):
    rows = spark.createDataFrame([(None, 1), (1, None), (1, 2), (2, 2), (3, 2)], "a long, b long")
    assert [r.x for r in rows.select(feed.fresh_enough(F.col("a"), F.col("b")).alias("x")).collect()] == [True, True, False, True, True]


def test_rate_gate(spark):
    at = spark.createDataFrame([(0, k * 10_000, k) for k in range(100)], "g long, at long, n long")
    got = metrics.next_start(metrics.in_window(at, ["g"], "at"), ["g"], "at", ["n"], limit=20).orderBy("n").collect()
    assert got[99].in_window == 100 and got[18].next_us == 180_000 + 50_000 and got[50].next_us == 310_000 + 1_010_000


def test_fraction(spark):
    rows = spark.createDataFrame([(5.0, 0.0), (5.0, 10.0), (20.0, 10.0), (-1.0, 10.0)], "d double, t double")
    assert [r.x for r in rows.select(metrics.fraction(F.col("d"), F.col("t")).alias("x")).collect()] == [0.0, 0.5, 1.0, 0.0]


def test_permits(spark):
    import random

    from concordat.operators import pacing

    rng = random.Random(2)
    rows = [(g, n, rng.randrange(3_000_000)) for g in range(3) for n in range(80)]
    got = {(r.gate, r.request): r.start_us for r in pacing.permits(spark.createDataFrame(rows, "gate long, request long, at_us long"), limit=20).collect()}
    for g in range(3):
        starts = []
        for _, n, at in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2], r[1])):
            start = max([at, *(s + 50_000 for s in starts[-1:]), *(s + 1_010_000 for s in starts[-20:-19])])
            assert got[g, n] == start
            starts.append(start)


def test_wave(spark):
    jobs = spark.createDataFrame([(k, "pending" if k % 2 else "complete") for k in range(300)], "id long, state string")
    assert [feed.wave(jobs, n).count() for n in (0, 5, 1000)] == [1, 5, 64]


OBJECT = "id long, name string, parent_remote long, sha256 string, size long, version long, status string, phase string, excluded boolean, remote_generation long, dirty_generation long"
SEEN = "id long, name string, parent_remote long, sha256 string, size long, version long, removed boolean, trashed boolean, scope string, placeable boolean"


def test_remote_observations(spark):
    stored = [(k, f"n{k}", p, "h", 1, 5, "present", "committed", k == 8, 0, 0) for k, p in ((1, None), (2, 1), (3, 2), (4, 3), (5, 1), (6, 1), (7, 6), (8, 1), (9, 1))]
    seen = [
        (2, None, None, None, None, None, True, False, "unknown", False),  # removed: it and all below is excluded, its status stays
        (5, "n5", 1, None, None, 1, False, True, "inside", True),  # trashed, though older
        (6, "n6", 1, "g", 2, 4, False, False, "inside", True),  # stale
        (7, "moved", 1, "g", 2, None, False, False, "inside", True),  # no version: written
        (8, "n8", 1, "g", 2, 6, False, False, "inside", True),  # was excluded, comes back
        (9, "n9", 1, "g", 2, 6, False, False, "unknown", True),  # excluded, stays queued
        (20, "a", 1, "g", 2, 1, True, False, "unknown", False), (21, "a", 1, "g", 2, 1, False, True, "inside", True), (22, "a", 1, "g", 2, 1, False, False, "outside", True),  # not stored: no rows
        (23, "new", 1, "g", 2, 1, False, False, "inside", True), (24, "bad/name", 1, "g", 2, 1, False, False, "inside", False),
    ]
    seen = spark.createDataFrame(seen, SEEN)
    out = feed.exclude_below(feed.apply_observations(spark.createDataFrame(stored, OBJECT), seen, "id"), "id")
    got = {r.id: (r.effect, r.status, r.phase, r.excluded, r.remote_generation, r.dirty_generation) for r in out.collect()}
    assert got == {
        1: ("kept", "present", "committed", False, 0, 0), 2: ("excluded", "present", "committed", True, 0, 0), 3: ("kept", "present", "committed", True, 0, 0), 4: ("kept", "present", "committed", True, 0, 0),
        5: ("trashed", "trashed", "ready", False, 0, 1), 6: ("stale", "present", "committed", False, 0, 0), 7: ("updated", "present", "ready", False, 1, 1), 8: ("updated", "present", "ready", False, 1, 1),
        9: ("excluded", "present", "committed", True, 0, 0), 23: ("inserted", "present", "ready", False, 1, 1),
    }
    assert sorted(r.id for r in feed.still_queued(seen).collect()) == [9, 24]


def test_the_root_is_never_missing(spark):
    rows = spark.createDataFrame([(1, None, "root", "present", 0, 0, "committed"), (2, 1, "a", "present", 0, 0, "committed"), (3, 1, "b", "present", 0, 0, "committed")], "item_id long, parent_id long, name string, local_status string, local_generation long, dirty_generation long, phase string")
    seen = spark.createDataFrame([(1, "a")], "parent_id long, name string")
    assert [r.item_id for r in diff.missing(rows, seen).collect()] == [3]


def test_failed_directories_block_what_is_below(spark):
    rows = spark.createDataFrame([(1, "other", 1, 9, True), (2, "a/b", 1, 8, True), (3, "a/b/c", 1, 7, False), (4, "a/bc", 1, 6, False), (5, "a/b", 1, 9, True)], "id long, path string, device long, inode long, is_directory boolean")
    failed = spark.createDataFrame([("a/b", 1, 9)], "path string, device long, inode long")
    assert sorted(r.id for r in gates.failed_subtrees(rows, failed, "id").collect()) == [3, 5]


def test_scope(spark):
    kind = "id long, parent_id long, removed boolean, trashed boolean"
    queued = spark.createDataFrame([(10, 1, False, False), (11, 10, False, False), (12, None, False, False), (13, 12, False, False), (14, 1, True, False), (15, 14, False, False), (16, 99, False, False), (17, 18, False, False), (18, 17, False, False), (2, 77, False, False), (19, 30, False, False)], kind)
    fetched = spark.createDataFrame([(30, 31, False, True), (10, None, False, False)], kind)
    known, root = spark.createDataFrame([(1,), (2,)], "id long"), spark.createDataFrame([(0,)], "id long")
    got = {r.id: r.scope for r in tree.scope(queued, fetched, known, root).collect()}
    assert got == {10: "inside", 11: "inside", 12: "outside", 13: "outside", 14: "outside", 15: "outside", 16: "unknown", 17: "unknown", 18: "unknown", 2: "unknown", 19: "outside"}
    assert [r.id for r in tree.to_probe(queued, fetched, known, root).collect()] == [77, 99]


def test_a_blocked_upload_stays_dirty(spark):
    cols = "id long, base_sha256 string, base_size long, local_status string, local_sha256 string, local_size long, remote_status string, remote_sha256 string, remote_size long, remote_id string, pending_create string, phase string, local_generation long, remote_generation long, dirty_generation long"
    rows = [(1, "b", 1, "present", "l", 2, "present", "b", 1, "r1", None, "ready", 1, 1, 3), (2, None, None, "present", "x", 4, "present", "X", 4, "r2", None, "ready", 1, 1, 3), (3, "b", 1, "present", "b", 1, "present", "b", 1, "r3", None, "ready", 1, 1, 3)]
    items = spark.createDataFrame(rows, cols)
    applied = reconcile.apply_decisions(reconcile.decide(items))
    got = {r.id: (r.decision, r.new_phase, r.new_dirty_generation, r.work) for r in applied.collect()}
    assert got == {1: ("upload", "blocked", 3, "safetyBlocked"), 2: ("matchUpdateBaseline", "committed", 0, None), 3: ("unchanged", "committed", 0, None)}
    later = items.withColumn("remote_generation", F.when(F.col("id") == 3, 2).otherwise(F.col("remote_generation")).cast("long"))
    done = {r.id: (r.phase, r.base_sha256, r.outcome) for r in reconcile.commit_decisions(later, applied, "id").collect()}
    assert done == {1: ("blocked", "b", "applied"), 2: ("committed", "x", "applied"), 3: ("ready", "b", "stale")}


def test_stalls(spark):
    offsets = [(1, n, o) for n, o in enumerate([0, 0, 5, 5, 5, 3, 3])] + [(2, n, o) for n, o in enumerate([10, 5, 3])]
    rows = metrics.stalled(spark.createDataFrame(offsets, "g long, n long, o long"), ["g"], ["n"], "o").orderBy("g", "n").collect()
    assert [r.stalled for r in rows] == [False, True, False, False, True, False, False, False, False, False]
    assert [r.went_back for r in rows] == [False] * 5 + [True, False] + [False, True, True]


def test_refills(spark):
    need = lambda n, held: one(spark, pacing.refills(F.lit(n), F.lit(held)))
    assert [need(1000, 0), need(1001, 0), need(5, 5), need(5, 900), need(2500, 400)] == [1, 2, 0, 0, 3]
    assert one(spark, pacing.prefetches(F.lit(199))) and not one(spark, pacing.prefetches(F.lit(200)))


def test_name_conflicts_are_changes(spark):
    items = spark.createDataFrame([(1, "p", None, "dir", "dir"), (2, "a", 1, "X", "x"), (3, None, 1, "Y", "y"), (4, "c", 1, "z", "z"), (5, "d", 1, "Z", "z")], "item_id long, remote_id string, parent_id long, name string, name_key string")
    inbox = spark.createDataFrame([("a", "p", "X", "x"), ("b", "p", "x", "x"), ("e", "p", "Y", "y"), ("f", "p", "y", "y"), ("c", "p", "z", "z"), ("g", "q", "x", "x"), ("h", "p", "new", "new")], "remote_id string, parent_remote string, name string, name_key string")
    found = feed.name_conflicts(inbox, items)
    assert sorted((r.remote_id, r.name) for r in found.collect()) == [("b", "x"), ("c", "z"), ("f", "y")]


def test_overlaps_of_many_equal_paths(spark):
    rows = spark.range(3000).select(F.col("id"), F.when(F.col("id") < 2990, "a/b").when(F.col("id") < 2999, "a/b/c").otherwise("a").alias("path"))
    got = gates.overlaps(rows, "id")
    assert got.count() == 3000 and got.where("id < 2990 and partners = 2999 and smallest = 0").count() == 2990 and got.where("id = 2995").first().partners == 2999
    assert "NestedLoop" not in plan(got)


def test_cleanup_plans(spark):
    from concordat.operators import cleanup

    items = spark.createDataFrame([(1, 1, None, "root", 0, 0, 0), (2, 1, 1, "a", 1, None, 2), (3, 1, 2, "b", 0, 0, 0), (4, 1, 99, "lost", 0, 0, 0), (5, 2, None, "gone", 0, 0, 0)], "item_id long, root_id long, parent_id long, name string, local_generation long, remote_generation long, dirty_generation long")
    roots = spark.createDataFrame([(1, "/r", "x", True), (2, "/s", "y", False)], "root_id long, root_path string, remote_root_id string, is_active boolean")
    wanted = spark.createDataFrame([(2, 1, 0, 2), (3, 0, 0, 7), (4, 0, 0, 0), (5, 0, 0, 0), (77, 0, 0, 0)], "item_id long, local_generation long, remote_generation long, dirty_generation long")
    made = cleanup.plans(wanted, items, roots)
    assert {r.item_id: (r.state, r.path) for r in made.collect()} == {2: ("ready", "a"), 3: ("stale", "a/b"), 4: ("ready", None), 5: ("notFound", ""), 77: ("notFound", None)}
    assert sorted((r.item_id, r.node_id, r.path) for r in cleanup.plan_nodes(made, items).collect()) == [(2, 2, ""), (2, 3, "b"), (4, 4, "")]


def test_megabytes_as_printf_writes_them(spark):
    """Above a gigabyte too; exact halves go to the even digit, as in C."""
    sizes = [0, 1, 131072, 393216, 655360, 1 << 30, (1 << 30) + 131072, 45_000_000_000, 10**15 + 7]
    got = [r.x for r in spark.createDataFrame([(float(n),) for n in sizes], "n double").select(text.megabytes(F.col("n")).alias("x")).collect()]
    assert got == [f"{n / 1048576:.2f} MB" for n in sizes]


def test_throughput_beyond_a_gigabyte(spark, tmp_path):
    spark.createDataFrame([("a", 3e9), ("a", 1.5), ("b", 2.0), ("c", None)], "o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.name: r.size for r in QUERIES["throughput"](spark, str(tmp_path)).collect()}
    assert got == {"a": "2861.02 MB", "b": "0.00 MB", "c": None}


def test_cleanup_sends_only_roots_by_broadcast(spark):
    got = plan(QUERIES["cleanup_plans"](spark, "/root/testdata/sf0.001"))
    assert got.count("BroadcastExchange") == 1 and got.count("SortMergeJoin") == 2


def test_climb_grows_no_paths_on_a_cycle(spark):
    """All rows below a node that is its own parent; a chain beside them ends only after 20 links."""
    rows = [(k, k // 3, f"n{k}") for k in range(300)] + [(1000 + k, 999 + k if k else None, f"c{k}") for k in range(21)]
    found = tree.climb(spark.createDataFrame(rows, "id long, parent_id long, name string"), spark.createDataFrame([(1000,)], "id long"))
    got = {r.id: (r.outcome, r.path) for r in found.collect()}
    assert all(got[k][0] == "deep" and got[k][1].count("/") < 64 for k in range(300))
    assert got[1020] == ("reached", "/".join(f"c{k}" for k in range(1, 21)))
    assert len(got) == 321


def test_traversal_ends_on_a_cycle(spark):
    rows = spark.createDataFrame([(0, 1, "a", True), (1, 2, "b", True), (2, 0, "back", True), (1, 3, "f", False), (3, 9, "hidden", False)], "parent_id long, id long, name string, is_directory boolean")
    found = tree.traverse(spark.createDataFrame([(0,)], "id long"), lambda f: rows.join(f.withColumnRenamed("id", "parent_id"), "parent_id", "left_semi"))
    assert sorted((r.id, r.path, r.depth) for r in found.collect()) == [(1, "a", 1), (2, "a/b", 2), (3, "a/f", 2)]


def test_group_commits(spark):
    writes = [(1, n, at, False) for n, at in enumerate([0, 1, 2, 3, 5000, 6000, 6001])] + [(1, 7, 6002, True), (1, 8, 6003, False)]
    rows = pacing.flushes(spark.createDataFrame(writes, "writer long, write long, at_us long, immediate boolean"), 4, 5000).orderBy("write").collect()
    assert [(r.flush, r.closed_by) for r in rows] == [(0, None), (0, None), (0, None), (0, "capacity"), (1, None), (1, None), (1, None), (1, "immediate"), (2, None)]


def test_a_choice_counts_for_its_revision(spark):
    from concordat.operators import conflicts

    held = spark.createDataFrame([("c1", 1, "R", 5, 2), ("c2", 2, "R", 5, 3)], "conflict_id string, item_id long, remote_sha256 string, remote_size long, revision long")
    items = spark.createDataFrame([(1, "B", 1, "L", 2, "blocked", 0), (2, "B", 1, "L", 2, "blocked", 0)], "item_id long, base_sha256 string, base_size long, local_sha256 string, local_size long, phase string, dirty_generation long")
    left, now = conflicts.resolved(held, items, spark.createDataFrame([("c1", 2, True), ("c2", 2, False)], "conflict_id string, revision long, keep_local boolean"))
    assert [r.conflict_id for r in left.collect()] == ["c2"]
    assert sorted(map(tuple, now.collect())) == [(1, "R", 5, "L", 2, "ready", 1), (2, "B", 1, "L", 2, "blocked", 0)]


def test_destinations(spark):
    below = lambda p: one(spark, paths.stays_below(F.lit("/data/root/"), F.lit(p)))
    assert [below(p) for p in ("a", "a/../b", "../x", "..", ".", "../root/x", "a/../../root2/x")] == [True, True, False, False, False, True, False]


def test_trees_of_any_depth(spark):
    rows = [(k, k - 1 if k else None, f"n{k}", True) for k in range(300)] + [(400, 401, "x", True), (401, 400, "y", True)]
    root = spark.createDataFrame([(0,)], "id long")
    found = tree.paths(nodes(spark, rows), root)
    assert found.count() == 300 and found.where("id = 299").first().depth == 299
    assert tree.excluded(nodes(spark, rows), root).count() == 300


def test_ordered_computations_in_two_levels(spark):
    import random

    from concordat.operators import slices

    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, None]), n, rng.choice([None, *range(9)])) for n in range(400)]
    df = slices.ranged(spark.createDataFrame(rows, "g int, n int, v int"), ["g"], ["n"], 16)
    assert df.select("_range").distinct().count() > 8  # the big key is spread
    got = slices.previous(df, ["g"], ["n"], "before", F.col("v"))
    got = slices.running_sum(got, ["g"], ["n"], "total", F.coalesce("v", F.lit(0)))
    got = slices.running_max(got, ["g"], ["n"], "most", F.col("v"))
    got = slices.running_max(got, ["g"], ["n"], "most_before", F.col("v"), itself=False)
    found = {r.n: (r.before, r.total, r.most, r.most_before) for r in got.collect()}
    seen = {}
    for g, n, v in rows:
        own = seen.setdefault(g, [])
        known, later = [x for x in own if x is not None], [x for x in [*own, v] if x is not None]
        assert found[n] == (own[-1] if own else None, sum(later), max(later, default=None), max(known, default=None))
        own.append(v)


def test_nested_plans_have_their_whole_subtrees(spark):
    from concordat.operators import cleanup

    items = spark.createDataFrame([(1, None, "root"), (2, 1, "a"), (3, 2, "b"), (4, 3, "c"), (5, 4, "d"), (6, 7, "x"), (7, 6, "y")], "item_id long, parent_id long, name string")
    ready = spark.createDataFrame([(2, "ready"), (3, "ready"), (5, "ready"), (1, "stale"), (6, "ready"), (7, "ready")], "item_id long, state string")
    got = {(r.item_id, r.node_id): (r.path, r.depth) for r in cleanup.plan_nodes(ready, items).collect()}
    assert {k: v for k, v in got.items() if k[0] < 6} == {(2, 2): ("", 0), (2, 3): ("b", 1), (2, 4): ("b/c", 2), (2, 5): ("b/c/d", 3), (3, 3): ("", 0), (3, 4): ("c", 1), (3, 5): ("c/d", 2), (5, 5): ("", 0)}
    assert {k for k in got if k[0] > 5} == {(6, 6), (7, 7)}  # a circle ends


def test_windows_of_one_hot_key_are_many_tasks(spark):
    import random

    from concordat.operators import diff, slices

    rng, at, rows = random.Random(4), 0, []
    for n in range(1500):
        at += rng.choice([0, 0, 1, 7, 300])
        rows.append((None if n % 50 == 0 else "hot" if n % 3 else f"k{n % 7}", n, at, n % 11 == 0))
    df = spark.createDataFrame(rows, "g string, n long, at long, folder boolean").repartition(4)
    df.createOrReplaceTempView("hot_rows")
    want = spark.sql("select n, count(*) over (partition by g order by at range between 500 preceding and current row) w, lag(at, 4) over (partition by g order by at, n) o from hot_rows").collect()
    of = lambda most: {r.n: r for r in metrics.next_start(metrics.in_window(df, ["g"], "at", 500, most=most), ["g"], "at", ["at", "n"], limit=5, width_us=500, most=most).collect()}
    got = of(100)
    assert {n: (r.in_window, r.next_us) for n, r in of(10_000).items()} == {n: (r.in_window, r.next_us) for n, r in got.items()}
    assert len(got) == 1500 and got[3].folder is False
    for r in want:
        paced = rows[r.n][2] + 200_000
        assert got[r.n].in_window == r.w and got[r.n].next_us == max(paced, paced if r.o is None else r.o + 500)
    ranges = slices.ranged(df, ["g"], ["at", "n"], 8)
    assert ranges.where("g = 'hot'").select(slices.RANGE).distinct().count() > 3
    segment, alone, place, plain = {}, set(), {}, {}
    for g, n, _, folder in rows:
        if folder:
            segment[g] = segment.get(g, 0) + 1
            place[g] = 0
        elif g not in alone:
            alone.add(g)
            plain[n] = (segment.get(g, 0), -1)
        else:
            plain[n] = (segment.get(g, 0), place.get(g, 0) // 4)
            place[g] = place.get(g, 0) + 1
    assert {r.n: (r.segment, r.chunk) for r in metrics.observation_batches(df, ["g"], ["n"], "folder", 4).collect()} == plain
    links = diff.links_in_order(df.selectExpr("n as item_id", "1 as device", "if(n % 3 = 0, n % 6, 1) as inode")).collect()
    seen = {}
    for r in sorted(links, key=lambda r: r.item_id):
        seen[r.inode] = seen.get(r.inode, 0) + 1
        assert r.link == seen[r.inode]


def test_missing_in_one_pass_is_the_same(spark):
    rows = spark.createDataFrame(
        [(1, None, "", "present", 0, 0, "committed"), (2, 1, "a", "present", 1, 0, "committed"), (3, 1, "b", "present", 2, 1, "ready"), (4, 1, "c", "absent", 1, 0, "committed"), (5, 1, "d", None, 1, 0, "committed"), (6, 1, "e", "present", 4, None, "committed"), (7, 1, "f", "present", 1, 0, "committed")],
        "item_id long, parent_id long, name string, local_status string, local_generation long, dirty_generation long, phase string",
    )
    seen = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "parent_id long, name string")
    gated = spark.createDataFrame([(6,), (6,)], "item_id long")
    gone = diff.missing(rows.where("item_id <> 7"), seen, gated)
    want = rows.join(gone, "item_id", "left_anti").unionByName(gone)
    got = diff.without_missing(rows, seen, F.col("item_id") != 7, gated)
    assert [r.item_id for r in gone.collect()] == [3] and got.columns == rows.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_key_of_most_rows_is_met_in_parts(spark):
    from concordat.sources.workspace import spread

    rows = spark.range(400).select(F.col("id"), F.when(F.col("id") % 50 == 0, F.col("id")).when(F.col("id") % 51 == 0, None).otherwise(1).alias("at"))
    side = spark.createDataFrame([(1, "one"), (1, "uno"), (50, "fifty"), (999, "none")], "at long, what string")
    for how in ("inner", "left"):
        got = spread(rows, side, "at", "id", how)
        assert sorted(map(str, got.select("id", "what").collect())) == sorted(map(str, rows.join(side, "at", how).select("id", "what").collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        met = spread(rows, side, "at", "id").where("at = 1").groupBy(F.spark_partition_id()).count().collect()
        assert len(met) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
