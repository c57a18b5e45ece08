import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from concordat.llm import sharding


def plain_jump(key, shards):
    at, to, k = 0, 0, 0
    while to < shards:
        at, k, draw = to, k + 1, int(hashlib.md5(f"{key}:{k}".encode()).hexdigest()[:8], 16) >> 1
        to = int((at + 1) * 2.0**31 / (draw + 1))
    return at


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 24, 25, 1000])
def test_jumps(spark, shards):
    rows = spark.range(300).select("id", sharding.jump(F.col("id"), shards).alias("shard")).collect()
    assert [r.shard for r in rows] == [plain_jump(r.id, shards) for r in rows]


def test_many_jumps_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(sharding, "USUAL_JUMPS", 2)
    rows = spark.range(300).select("id", sharding.jump(F.col("id"), 500).alias("shard")).collect()
    assert [r.shard for r in rows] == [plain_jump(r.id, 500) for r in rows]
    with pytest.raises(ValueError):
        sharding.jump(F.lit(1), 0)


def test_one_more_shard_moves_only_its_share(spark):
    rows = spark.range(40_000).select(sharding.jump(F.col("id"), 16).alias("a"), sharding.jump(F.col("id"), 17).alias("b")).collect()
    moved = [r for r in rows if r.a != r.b]
    assert all(r.b == 16 for r in moved) and abs(len(moved) - 40_000 / 17) < 250
    assert all(abs(sum(r.a == k for r in rows) - 2500) < 250 for k in range(16))


@pytest.mark.parametrize("piece", [1 << 16, 3])
def test_places(spark, odd, monkeypatch, piece):
    monkeypatch.setattr(sharding, "PIECE", piece)
    docs = odd.unionByName(spark.range(500).select(F.lit(77).cast("long").alias("doc_id"), F.lit("copy é").alias("text"), *[F.lit(None).alias(c) for c in ("lang", "source", "n_chars", "score")]))
    docs = docs.unionByName(odd.limit(0)).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).repartition(5)
    got = sharding.place(docs, 4).collect()
    want = sorted((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.where("doc_id is not null").collect())
    assert sorted(tuple(r)[:3] for r in got if r.id is not None) == want and len(got) == docs.count()
    for k in {r.shard for r in got}:
        own = sorted((r for r in got if r.shard == k), key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        assert [tuple(r)[:3] for r in own if r.id is not None] == sorted(tuple(r)[:3] for r in own if r.id is not None)
    assert all((r.shard, r.grown_shard) == tuple(plain_jump("" if r.id is None else r.id, n) for n in (4, 5)) for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, sharding.place(docs.repartition(2), 4).collect()))  # however rows are dealt


def test_native_only(spark, odd):
    plan = sharding.place(odd)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))
    assert "Exchange" not in sharding.with_shard(odd)._jdf.queryExecution().executedPlan().toString()


def test_written_shards(spark, odd, tmp_path):
    named = odd.withColumn("shard", F.lit("clash")).withColumn("a.b", F.lit(1))
    sharding.write_shards(named, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == odd.count() and set(back.columns) == {*odd.columns, "a.b", "shard"}
    assert all(r.shard == plain_jump("" if r.doc_id is None else r.doc_id, 4) for r in back.collect())


def test_empty_table(spark):
    assert sharding.place(spark.createDataFrame([], "doc_id long, text string")).count() == 0
