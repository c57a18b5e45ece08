import random

import numpy as np
import plain
import pytest

from concordat.llm import suffix_dedup
from concordat.llm.lyndon_suffixes import prefix_classes, suffix_array


def test_suffix_array():
    rng = random.Random(1)
    for t in range(2000):
        x = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(40))]
        if t % 5 == 0:
            x = (x[: max(1, len(x) // 4)] * 6)[: len(x)]
        assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_prefix_classes():
    x = np.array([1, 2, 1, 2, 3, 1, 2])
    for n, own in enumerate(prefix_classes(x, suffix_array(x), 3), 1):
        for i in range(len(x)):
            for j in range(i):
                equal = i + n <= len(x) and j + n <= len(x) and (x[i : i + n] == x[j : j + n]).all()
                assert (own[i] == own[j]) == bool(equal)


def variants(small, n=60):
    """Texts with copies, cut copies, edits, shared passages of exactly 49 to 51 bytes, and runs."""
    rng = random.Random(5)
    texts = [r.text for r in small.orderBy("doc_id").limit(n).collect()]
    passage = texts[3][:400]
    out = list(texts[:20])
    for t in texts[:20]:
        k = rng.randrange(len(t) + 1)
        out += [t[:k] + rng.choice(["", "x", "é"]) + t[k + 1 :], t[k:], t[: k // 2] + passage[:200] + t[k:]]
    for size in (48, 49, 50, 51, 52, 75, 120):
        for k in range(4):
            at = rng.randrange(100)
            out.append(f"{k}{size}#" + passage[at : at + size] + f"%{k}")
    out += ["a" * k for k in (49, 50, 51, 130)] + ["ab" * 60, "ba" * 60, "é" * 40, "xé" * 40]
    return out


@pytest.mark.parametrize(("hot_here", "hot"), [(24, 4096), (2, 3), (1, 1)])
def test_against_brute_force(spark, odd, small, hot_here, hot):
    texts = variants(small)
    random.Random(9).shuffle(texts)
    docs = [(1000 + k, t) for k, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    docs += [(1003, texts[8]), (1003, texts[8]), (1004, texts[9] + "tail")]
    frame = spark.createDataFrame([*docs, (None, texts[0])], "doc_id long, text string").repartition(5)
    got = suffix_dedup.repeated_strings(frame, hot_in_slice=hot_here, hot=hot).collect()
    want = plain.repeats(docs)
    assert sorted((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.id is not None) == sorted(want)
    assert [(r.n_removed, r.kept_sha256) for r in got if r.id is None] == [(0, plain.sha(texts[0]))]
    assert sum(w[2] > 0 for w in want) > 50


def test_empty(spark):
    assert suffix_dedup.repeated_strings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
