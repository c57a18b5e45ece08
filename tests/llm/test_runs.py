import random
import zlib

import numpy as np
import pytest
from plain import ANY_WORD, sha

from concordat.llm.periodic_runs import find, find_runs, least_scale
from concordat.llm.queries import with_planted_runs


def plain_runs(words, least=24, times=3):
    """All maximal runs, every period and every place tried."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, j - i + q, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def tangled(rng):
    """Repetitions within repetitions, runs that touch and overlap, and some noise."""
    out = []
    for _ in range(rng.randrange(1, 9)):
        unit = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(1, 40))]
        if rng.random() < 0.5:
            unit = [0] * rng.randrange(8, 40) + unit[: rng.randrange(1, 4)]
        out += (unit * 6)[: rng.randrange(1, 5 * len(unit) + 1)] + [9] * rng.randrange(2)
    return out[:500]


def test_all_runs_and_no_others():
    rng, found = random.Random(12), 0
    for _ in range(400):
        codes = tangled(rng)
        want = plain_runs(codes)
        assert [tuple(r) for r in find(np.array(codes)).tolist()] == want
        found += len(want)
    assert found > 500 and least_scale() == 8


@pytest.mark.parametrize(("least", "times"), [(24, 3), (2, 3), (10, 3), (40, 4), (100, 3)])
def test_other_limits(least, times):
    rng = random.Random(least)
    for _ in range(60):
        codes = tangled(rng)
        assert [tuple(r) for r in find(np.array(codes, np.int64), least, times).tolist()] == plain_runs(codes, least, times)


def test_repetitive_texts_take_time_in_proportion():
    import time

    n, rng = 300_000, random.Random(1)
    began = time.time()
    assert find(np.zeros(n, np.int64)).tolist() == [[0, n, 1]]
    unit = [rng.randrange(1000) for _ in range(n // 3)]
    assert find(np.array(unit * 3)).tolist() == [[0, n // 3 * 3, n // 3]]
    almost = np.array([int(k % 1000 == 0) for k in range(n)])
    assert len(find(almost)) == n // 1000 + 1  # the whole of period 1000, and a stretch of zeros in each
    assert time.time() - began < 60


def plain_row(doc_id, text):
    words = ANY_WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_query_against_brute_force(spark, odd, tmp_path):
    from concordat.llm.queries import op12_periodic_runs

    rng = random.Random(3)
    rows = [(k, " ".join(f"w{x}" for x in tangled(rng)) + "\x0b é\x1ce　f " * (k % 3)) for k in range(250)] + [(None, "a b " * 30), (7, None), (7, ""), (8, "x " * 24), (8, "x " * 23)]
    docs = odd.select("doc_id", "text", "score").unionByName(spark.createDataFrame([(*r, "clash") for r in rows], odd.select("doc_id", "text", "score").schema))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = op12_periodic_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()
    want = [plain_row(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert sum(w[1] > 0 for w in want) > 150 and any(zlib.crc32(str(k).encode()) % 10 == 0 for k in range(250))


def test_ties_and_kept_words(spark):
    text = " ".join(["a"] * 24 + ["x"] + ["b"] * 24 + ["y", "z"] * 12)
    row = find_runs(spark.createDataFrame([(1, text, 5)], "doc_id long, text string, runs int")).first()
    assert [tuple(r) for r in row.runs] == [(0, 24, 1), (25, 24, 1), (49, 24, 2)]
    assert tuple(row.longest) == (0, 24, 1) and row.kept == "a x b y z"


def test_a_text_of_many_megabytes(spark):
    unit = " ".join(f"word{k}" for k in range(200_000))
    docs = spark.createDataFrame([(1, f"start {unit} {unit} {unit}"), (2, "short one")], "doc_id long, text string")
    first, second = find_runs(docs).orderBy("id").collect()
    assert [tuple(r) for r in first.runs] == [(1, 600_000, 200_000)] and first.kept == f"start {unit}" and second.runs == []


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert find_runs(with_planted_runs(none)).count() == 0
