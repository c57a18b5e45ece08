"""Keyed state with timers: what comes out does not depend on batches or restarts."""

import random
from datetime import datetime, timedelta

import pytest

from concordat.sources.snapshots import Snapshots
from concordat.streaming import keyed_inbox
from concordat.streaming.keyed_inbox import Retries, follow

SCHEMA = "id string, number long, payload string, at timestamp"


def changes():
    rng, at, rows = random.Random(5), datetime(2024, 3, 1), []
    for number in range(400):
        at += timedelta(minutes=rng.randrange(1, 30), milliseconds=rng.randrange(1000))
        rows.append((rng.choice("aaaabcdefg") if number < 390 else rng.choice("ab"), number, f"p{number}", at))
    return [*rows, ("once", 1000, "early", datetime(2024, 3, 1, 0, 30)), ("empty", 1001, None, at)]


def plain(rows, retries=Retries()):
    now = max(r[3] for r in rows) - timedelta(minutes=10)
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        _, number, payload, at = max(own, key=lambda r: r[1])
        tried = sum(at + timedelta(milliseconds=retries.delay_ms * (2**j - 1)) <= now for j in range(1, retries.tries + 1))
        out[key] = (number, payload, tried, "given up" if tried == retries.tries else "pending", len(own))
    return out


def held(inbox):
    return {r.id: (r.number, r.payload, r.tried, r.state, r.n_events) for r in inbox.read().collect()}


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata"])
def test_batches_and_restarts_do_not_matter(spark, tmp_path, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = sorted(changes(), key=lambda r: r[3])
        cuts = [0, 7, 60, 61, 250, len(rows)]
        inbox = Snapshots(spark, f"file://{tmp_path}/inbox")
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
            if k != 1:  # two batches in one run; every run but the first is a restart
                follow(source, inbox, f"file://{tmp_path}/checkpoint", "id")
        got = held(inbox)
        assert got == plain(rows)
        assert {v[3] for v in got.values()} == {"pending", "given up"} and len({v[2] for v in got.values()}) > 3
        version = inbox.version()
        follow(source, inbox, f"file://{tmp_path}/checkpoint", "id")
        assert held(inbox) == got and inbox.version() <= version + 1  # nothing new
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_given_up_entry_starts_anew_with_the_next_change(spark, tmp_path):
    rows = [("x", 1, "old", datetime(2024, 3, 1)), ("y", 2, "tick", datetime(2024, 3, 9)), ("x", 3, "new", datetime(2024, 3, 9, 1)), ("y", 4, "tick", datetime(2024, 3, 9, 5))]
    inbox = Snapshots(spark, f"file://{tmp_path}/inbox")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    states = []
    for k, row in enumerate(rows):
        spark.createDataFrame([row], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        follow(source, inbox, f"file://{tmp_path}/checkpoint", "id", retries=Retries(60_000, 3))
        states.append(held(inbox)["x"])
    assert states == [(1, "old", 0, "pending", 1), (1, "old", 3, "given up", 1), (3, "new", 0, "pending", 2), (3, "new", 3, "given up", 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != keyed_inbox._PROVIDER


def test_when_tries_are_due():
    retries = Retries(1000, 3)
    assert [retries.due(0, n) for n in range(3)] == [1000, 3000, 7000]
    assert [retries.tried(0, 0, now) for now in (0, 999, 1000, 2999, 3000, 7000, 10**9)] == [0, 0, 1, 1, 2, 3, 3]
