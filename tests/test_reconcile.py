"""The decision table, row by row, and the operators around it."""

import itertools

import pytest
from pyspark.sql import functions as F

from concordat.operators import reconcile

A, B, C = "a" * 64, "b" * 64, "c" * 64
ROWS = "id int, base_sha256 string, base_size long, local_status string, local_sha256 string, local_size long, remote_status string, remote_sha256 string, remote_size long"


def expect(base, local, lsha, remote, rsha):
    """The rules in words."""
    local, remote = local or "unknown", remote or "unknown"
    low = lambda x: x.lower() if x else x
    base, lsha, rsha = low(base), low(lsha), low(rsha)
    if local == "unstable" or "unknown" in (local, remote):
        return "waitingEvidence"
    if (local == "present" and not lsha) or (remote == "present" and not rsha):
        return "waitingEvidence"
    here, there = local == "present", remote == "present"
    if base is None:
        if here and there:
            return "matchUpdateBaseline" if lsha == rsha else "conflict"
        if here:
            return "upload" if remote == "absent" else "keepModified"
        return "download" if there else "unchanged"
    if not here and not there:
        return "unchanged"
    if not here:
        return "trashRemote" if rsha == base else "conflict"
    if not there:
        return "deleteLocal" if lsha == base else "conflict"
    if lsha == base:
        return "unchanged" if rsha == base else "download"
    if rsha == base:
        return "upload"
    return "matchUpdateBaseline" if lsha == rsha else "conflict"


def test_every_combination(spark):
    combos = list(itertools.product([None, A, A.upper()], ["present", "absent", "unstable", "unknown", None], [None, "", A, B, C.upper()], ["present", "absent", "trashed", "unknown", None], [None, "", A, B.upper(), C]))
    rows = [(n, b, 1, l, ls, 7, r, rs, 9) for n, (b, l, ls, r, rs) in enumerate(combos)]
    got = {r.id: r for r in reconcile.decide(spark.createDataFrame(rows, ROWS)).collect()}
    for n, combo in enumerate(combos):
        assert got[n].decision == expect(*combo), combo
        assert (got[n].size, got[n].sha256) == ((7, combo[2].lower()) if got[n].decision == "matchUpdateBaseline" else (None, None))
        assert (got[n].reason is not None) == (got[n].decision in ("waitingEvidence", "upload", "download"))


def test_align_keeps_every_side(spark):
    b = spark.createDataFrame([(1, A, 1)], "id int, base_sha256 string, base_size long")
    l = spark.createDataFrame([(2, "present", A, 1)], "id int, local_status string, local_sha256 string, local_size long")
    r = spark.createDataFrame([(3, "present", A, 1)], "id int, remote_status string, remote_sha256 string, remote_size long")
    got = {x.id: x.decision for x in reconcile.decide(reconcile.align(b, l, r, "id")).collect()}
    assert got == {1: "waitingEvidence", 2: "waitingEvidence", 3: "waitingEvidence"}


def test_decision_is_one_codegen_expression(spark):
    rows = spark.createDataFrame([(1, A, 1, "present", A, 1, "present", A, 1)], ROWS)
    plan = reconcile.decide(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


@pytest.mark.parametrize(("status", "empty", "mode"), [("existingKnown", (False, False), "incremental"), ("freshCreated", (True, True), "remoteToLocalEmpty"), (None, (True, False), "remoteToLocalEmpty"), (None, (False, True), "localToRemoteEmpty"), (None, (True, True), "emptyBaseline"), (None, (False, False), "error")])
def test_route(spark, status, empty, mode):
    row = spark.range(1).select(reconcile.route(F.lit(status is not None), F.lit(status), F.lit("remoteToLocalEmpty"), *map(F.lit, empty)).alias("m")).first()
    assert row.m == mode


def test_apply_twice_changes_nothing(spark):
    """After a match is applied, the same observations decide unchanged."""
    rows = spark.createDataFrame([(1, A, 1, "present", B, 5, "present", B, 5)], ROWS).withColumns({"remote_id": F.lit("r"), "pending_create": F.lit(None).cast("string"), "phase": F.lit("ready"), "dirty_generation": F.lit(1)})
    first = reconcile.apply_decisions(reconcile.decide(rows)).first()
    assert (first.new_base_sha256, first.new_base_size, first.new_phase, first.new_dirty_generation) == (B, 5, "committed", 0)
    again = reconcile.decide(rows.withColumn("base_sha256", F.lit(first.new_base_sha256))).first()
    assert again.decision == "unchanged"


def test_overwrite_guard(spark):
    rows = spark.createDataFrame([(1, A, 1, "present", B, 5, "present", A, 1)], ROWS)
    for remote, pending, work in (("r", None, "safetyBlocked"), ("r", "op", "upload"), (None, None, "upload")):
        own = rows.withColumns({"remote_id": F.lit(remote).cast("string"), "pending_create": F.lit(pending).cast("string"), "phase": F.lit("ready"), "dirty_generation": F.lit(1)})
        assert reconcile.apply_decisions(reconcile.decide(own)).first().work == work
