"""Maintained paths against paths made anew, and what an edit reads."""

import random

import duckdb
import pytest

from concordat.operators import path_view, tree
from concordat.plans.catalog import QUERIES, SQL

COLS = "id long, parent_id long, name string"


def anew(spark, held):
    rows = [(i, p, n) for i, (p, n) in held.items()]
    nodes, root = spark.createDataFrame(rows, COLS), spark.createDataFrame([(0,)], "id long")
    return {r.id: (r.path, r.depth) for r in tree.paths(nodes, root).collect()}


def kept(view):
    return {r.id: (r.path, r.depth) for r in view.read().collect()}


def begin(spark, folder, held, **options):
    view = path_view.PathView(spark, str(folder), **options)
    view.build(spark.createDataFrame([(i, p, n) for i, (p, n) in held.items()], COLS), spark.createDataFrame([(0,)], "id long"))
    return view


def edit(spark, view, rows):
    return view.apply(spark.createDataFrame(rows, COLS + ", removed boolean"))


def test_random_edits(spark, tmp_path):
    draw = random.Random(5)
    held = {0: (None, "root")} | {k: (draw.randrange(k), f"n{k}") for k in range(1, 60)}
    view = begin(spark, tmp_path, held, bits=2, leaf_bytes=2000)
    assert kept(view) == anew(spark, held)
    for turn in range(3):
        rows = {}
        for _ in range(8):
            i, kind = draw.randrange(1, 70), draw.random()
            if kind < 0.25:
                rows[i] = (i, None, None, True)
            else:  # a move may close a cycle, hang a node below a missing one, or bring one back
                rows[i] = (i, draw.randrange(75), f"t{turn}-{i}", False)
        edit(spark, view, list(rows.values()))
        for i, p, n, removed in rows.values():
            held.pop(i, None) if removed else held.update({i: (p, n)})
        assert kept(view) == anew(spark, held)


def test_cases(spark, tmp_path):
    view = begin(spark, tmp_path, {0: (None, "r"), 1: (0, "a"), 2: (1, "b"), 3: (2, "c"), 4: (9, "lost"), 5: (None, "stray")}, bits=1)
    assert kept(view) == {0: ("", 0), 1: ("a", 1), 2: ("a/b", 2), 3: ("a/b/c", 3)}
    now = view.store.version()
    assert edit(spark, view, [(1, 0, "a", False), (77, None, None, True), (None, 0, "x", False)]) == now  # nothing has changed
    edit(spark, view, [(1, 3, "a", False)])  # a cycle
    assert kept(view) == {0: ("", 0)}
    edit(spark, view, [(1, 0, "A", False), (1, 0, "A", False), (9, 1, "nine", False)])  # undone, repeated; a parent appears
    assert kept(view) == {0: ("", 0), 1: ("A", 1), 2: ("A/b", 2), 3: ("A/b/c", 3), 9: ("A/nine", 2), 4: ("A/nine/lost", 3)}
    edit(spark, view, [(0, None, None, True)])
    assert kept(view) == {}
    edit(spark, view, [(0, None, "again", False)])
    assert kept(view)[3] == ("A/b/c", 3)


def test_empty_tree(spark, tmp_path):
    view = begin(spark, tmp_path, {}, bits=1)
    assert kept(view) == {}
    edit(spark, view, [(0, None, "r", False), (1, 0, "a", False)])
    assert kept(view) == {0: ("", 0), 1: ("a", 1)}


@pytest.mark.parametrize("bits", [5])
def test_an_edit_opens_few_buckets(spark, tmp_path, bits):
    view = begin(spark, tmp_path, {0: (None, "r")} | {k: (k // 10, f"n{k}") for k in range(1, 1000)}, bits=bits)
    before = view.store.head()["tables"]["nodes"]["folders"]
    one = spark.createDataFrame([(500,)], "id long")
    found = view.store.lookup(one, "nodes")
    assert found.first().path == "n5/n50/n500" and len(found.inputFiles()) == 1
    edit(spark, view, [(500, 50, "other", False)])
    after = view.store.head()["tables"]["nodes"]["folders"]
    assert sum(before[b] != after[b] for b in before) == 1


def test_two_writers(spark, tmp_path, monkeypatch):
    view = begin(spark, tmp_path, {0: (None, "r"), 1: (0, "a"), 2: (1, "b")}, bits=1)
    other, plain, raced = path_view.PathView(spark, str(tmp_path)), view._commit, []

    def late(*args):
        if not raced:
            raced.append(edit(spark, other, [(1, 0, "z", False)]))
        return plain(*args)

    monkeypatch.setattr(view, "_commit", late)
    edit(spark, view, [(3, 2, "c", False)])
    assert raced and kept(view) == {0: ("", 0), 1: ("z", 1), 2: ("z/b", 2), 3: ("z/b/c", 3)}


def test_nodes_of_one_id(spark, tmp_path):
    """What is below an id that stands twice has two paths; each of its nodes changes alone."""
    cols = "id long, entry int, parent_id long, name string"
    rows = [(0, 0, None, "r"), (1, 0, 0, "a"), (2, 0, 0, "b"), (5, 0, 1, "x"), (5, 1, 2, "y"), (6, 0, 5, "z"), (7, 0, 6, "q")]
    view = path_view.PathView(spark, str(tmp_path), bits=1)
    view.build(spark.createDataFrame(rows, cols), spark.createDataFrame([(0,)], "id long"))

    def now():
        return sorted((r.id, r.path, r.depth) for r in view.read().collect() if r.id > 2)

    def change(*new):
        view.apply(spark.createDataFrame(new, cols + ", removed boolean"))

    assert now() == [(5, "a/x", 2), (5, "b/y", 2), (6, "a/x/z", 3), (6, "b/y/z", 3), (7, "a/x/z/q", 4), (7, "b/y/z/q", 4)]
    change((5, 1, 0, "y", False), (7, 1, 0, "s", False))
    assert now() == [(5, "a/x", 2), (5, "y", 1), (6, "a/x/z", 3), (6, "y/z", 2), (7, "a/x/z/q", 4), (7, "s", 1), (7, "y/z/q", 3)]
    change((5, 0, None, None, True), (7, 0, 5, "q", False))
    assert now() == [(5, "y", 1), (6, "y/z", 2), (7, "s", 1), (7, "y/q", 2)]


def test_new_ids_that_the_table_has(spark, tmp_path):
    """Rows of a million and more, of which one is a new id too and has rows below it."""
    keys = set(range(100))
    for k in (1000095, 1000068, 4000380, 4000383, 1000097):
        while k:
            keys.add(k)
            k //= 4
    spark.createDataFrame([(k, k % 50 + 1) for k in sorted(keys)], "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.sql(f"SELECT id, path, depth FROM ({SQL['maintained_paths']})").fetchall())
    assert [r[0] for r in want].count(1000095) == [r[0] for r in want].count(4000380) == 2
    assert sorted(tuple(r) for r in QUERIES["maintained_paths"](spark, str(tmp_path)).select("id", "path", "depth").collect()) == want
