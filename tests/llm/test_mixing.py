from collections import Counter

import plain
import pytest
from pyspark.sql import functions as F

from concordat.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    got = mixing.targets([10, 100, 0, 50], [5, 2, 1, 5])
    assert got[0] == 30 and got[2] == 0 and sum(got) == pytest.approx(160) and got[3] == pytest.approx(130 * 5 / 7)
    assert mixing.targets([], []) == [] and mixing.targets([0], [5]) == [0.0]


def test_split_is_exact():
    shards = mixing.split([10, 3, 0, 77], 7)
    assert [sum(x) for x in zip(*shards)] == [10, 3, 0, 77] and max(map(sum, shards)) - min(map(sum, shards)) <= 3


def test_mix(odd, small):
    docs = odd.select("doc_id", "text", "source").union(small.selectExpr("doc_id + 1000", "text", "source"))
    got = mixing.mix(docs).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs.repartition(3)).collect()))
    size = Counter()
    for r in docs.collect():
        size[r.source] += len(plain.ANY_WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))])))
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size and r.taken == r.size * len(r.shards)
    longest = {}
    for r in got:
        longest[r.source] = max(longest.get(r.source, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 + 1 for s in order)
    assert len(got) == docs.count()


def test_documents(spark, odd):
    taken = {r.id: len(r.shards) for r in mixing.mix(odd).collect()}
    docs = mixing.mixed_documents(odd)
    assert docs.columns == odd.columns
    found = Counter(r.doc_id for r in docs.collect())
    rows = Counter(r.doc_id for r in odd.collect())
    assert found == Counter({i: n * rows[i] for i, n in taken.items() if n})
    none = spark.createDataFrame([], odd.schema)
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert mixing.mix(odd.withColumn("source", F.lit(None).cast("string"))).where("source is null").count() == odd.count()


def test_room_is_carried_over_a_long_document(spark):
    rows = [(s * 640 + k, "w " * (10_000 if k == 0 else 30), f"s{s:02}") for s in range(24) for k in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    share = 15_000 / (10_000 + 639 * 30)
    found = mixing.mix(docs, weights=(1,), share=share).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(found) == 24 and all(abs(r.taken - r.target) <= 15 + 1e-6 for r in found)


def test_miss_is_half_the_smallest_left_out(spark):
    sizes = {"a": [1 << (k % 12) for k in range(300)], "b": [k * k for k in range(1, 200)], "c": [700] * 50 + [5] * 9, "d": [50_000, 3, 4, 5]}
    rows = [(k % 37 if s == "b" else k, "w " * n, s) for s, own in sizes.items() for k, n in enumerate(own)] + [(1, "w " * 900, "c")] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for share, seed in ((0.31, 1), (0.77, 2)):
        got = mixing.mix(docs, share=share, seed=seed).collect()
        for source in sizes:
            own = [r for r in got if r.source == source]
            fewest = min(len(r.shards) for r in own)
            units = Counter()
            for r in own:
                if len(r.shards) == fewest:
                    units[r.id, r.size] += r.size
            assert abs(sum(r.taken for r in own) - own[0].target) <= min(units.values()) / 2 + 1e-6


@pytest.mark.parametrize("ident", [None, 7])
def test_rows_without_an_id_of_their_own_are_units(spark, ident):
    rows = [(ident, f"{k} " + "w " * 9, "a") for k in range(50)] + [(k, f"{k} " + "w " * 9, "b") for k in range(50)] + [(ident, f"x{k} " + "w " * (k % 40), "c") for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1e-6
        assert source != "c" or {0, 1} <= {len(r.shards) for r in own}
    two = mixing.mix(spark.createDataFrame(rows[:100], "doc_id long, text string, source string")).collect()
    assert [round(sum(r.taken for r in two if r.source == s), 2) for s in "ab"] == [710, 290]  # of 714.3 and 285.7, in tens
