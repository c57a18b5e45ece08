"""Hash collisions, very long texts, models and their samples, and odd rows."""

import random
import zlib
from collections import Counter

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_tokens import colliding

from concordat.llm import decontamination, license_scan, linear, mixing, quality_classifier, quality_rules, secret_scan, simhash_dedup, suffix_dedup, textarrays
from concordat.llm.textarrays import as_bytes

ONE, TWO = colliding()


def test_the_words_do_collide():
    data, offsets = as_bytes(pa.array([ONE + " " + TWO]))
    starts, ends, bounds = textarrays.words(data, offsets, textarrays.NOT_SPACE)
    hashes = textarrays.span_hashes(data, starts, ends)
    assert ONE != TWO and hashes[0] == hashes[1]
    codes, _ = textarrays.run_codes(data, offsets, textarrays.NOT_SPACE)
    assert codes[0] != codes[1]


def test_counts_tell_colliding_lines_and_words_apart():
    texts = [f"{ONE}\n{TWO}", " ".join([ONE] * 5 + [TWO] * 5), f"{ONE}\n{ONE}\n{TWO}\n{ONE}"]
    got = quality_rules.counts(*as_bytes(pa.array(texts)))
    for k, text in enumerate(texts):
        want = plain.rules(text)
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want[:5]


def test_windows_of_one_hash(monkeypatch):
    monkeypatch.setattr(quality_rules, "mix", lambda h: h & np.uint64(3))  # nearly all windows share a hash
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcde") for _ in range(200)) for _ in range(10)]
    got = quality_rules.counts(*as_bytes(pa.array(texts)))
    assert got["n_repeat_words"].tolist() == [plain.rules(t)[4] for t in texts]


def test_licence_words_are_compared():
    found = license_scan.licences()
    text = "mit license " + "x" * 300 + " MIT\tLicense"
    places, numbers, bounds = found.known(*as_bytes(pa.array([text, "license"])))
    assert places.tolist() == [0, 1, 3, 4, 5] and bounds.tolist() == [0, 5, 6] and numbers[0] == numbers[2]


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "délta", "mit", "license", "x#y", "ONE", "the"]
    lines = [" ".join(rng.choice(words) for _ in range(rng.randrange(12))) for _ in range(70_000)]
    return "\n".join(lines)


def test_long_text_counts(long_text):
    assert len(long_text.encode()) > 2 * textarrays.SLICE_BYTES
    got = quality_rules.counts(*as_bytes(pa.array([long_text])))
    assert tuple(int(got[c][0]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain.rules(long_text)[:5]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "text": [long_text, "mit license"]})
    row = {k: v[0].as_py() for k, v in license_scan._scan(batch).items()}
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == plain.licences(long_text)


def test_long_text_hits(long_text):
    items = [("a", b"alpha beta gamma alpha beta"), (None, b"the the the the the"), ("b", b"nowhere")]
    automaton = decontamination.Automaton(items)
    (n_words, runs, spans, found), _ = decontamination._hits(pa.array([long_text, "x"]), automaton)
    want = plain.contamination(long_text, [(i, t.decode()) for i, t in items])
    assert (n_words, sum(b - a for a, b in runs), found) == (want[0], want[1], ["a"])
    a, b = spans[0]
    assert len(plain.ALNUM_WORD.findall(long_text[a:b])) == runs[0][1] - runs[0][0]


def test_long_text_fingerprint(long_text):
    assert simhash_dedup.fingerprint(long_text.encode()) == plain.fingerprint(long_text)


def test_long_text_secrets(long_text):
    key = "q7Zx2Lw9Vb4Rt8Yp1Nm6"
    text = long_text + f" secret=abcdefgh12 {key} " + long_text
    row = {k: v[0].as_py() for k, v in secret_scan._scan(pa.RecordBatch.from_pydict({"id": [1], "text": [text]}), public_tokenizers.path("byte_bpe_50k.tiktoken")).items()}
    assert (row["n_assign"], row["n_access"], row["n_hex"], row["base_sha256"]) == plain.secrets(text)[:4]
    at = text.index(key)
    assert row["spans"].endswith(f"random:{at}:{at + len(key)}")


def test_random_strings_are_found_and_words_are_not():
    rng = random.Random(11)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    draw = lambda n: "".join(rng.choice(alphabet) for _ in range(n)).encode()
    for prefix in (b"", b"service/production/configuration/", b"customer_subscription_identifier_"):
        for size in (20, 32, 64):
            assert sum(bool(secret_scan.random_spans(prefix + draw(size), path)) for _ in range(200)) >= 196
    words = "customer subscription identifier service production configuration response handler maximum connection timeout request parser default encoding message".split()
    names = [("_" if k % 2 else "").join(w.title() if k % 2 == 0 else w for w in rng.sample(words, 4)).encode() for k in range(400)]
    assert sum(bool(secret_scan.random_spans(n, path)) for n in names) <= 4
    for known in (b"d41d8cd98f00b204e9800998ecf8427e", b"123e4567-e89b-12d3-a456-426614174000", b"12345678901234567890123456"):
        assert not secret_scan.random_spans(known, path)


def test_long_text_memory():
    """A text of 64 MB raises the peak of the heavy steps by less than half a gigabyte."""
    import subprocess
    import sys

    code = """
import resource, sys
import numpy as np, pyarrow as pa
from concordat.llm import quality_classifier, suffix_dedup, token_files, license_scan
import public_tokenizers
from concordat.llm.textarrays import as_bytes
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
text = pa.array([b"some words that come again and again in a text, line after line\\n" * (1 << 20)]).cast(pa.string())
data, offsets = as_bytes(text)
token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
before = peak()
for found in suffix_dedup._stretches(data, offsets):
    pass
quality_classifier.margins(data, offsets, np.zeros((1 << 18) + 1))
license_scan.licences().known(data, offsets)
print(peak() - before)
"""
    import os

    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    assert float(subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, check=True).stdout) < 512


def test_stretches_lose_no_string():
    rng = random.Random(2)
    text = "".join(rng.choice("ab ") for _ in range(5000))
    data, offsets = as_bytes(pa.array([text]))

    def strings(found):
        return {lo + k: a for lo, n, a in zip(found["lo"].tolist(), found["strings"].tolist(), found["a"].tolist(), strict=True) for k in range(n)}

    whole = strings(suffix_dedup.pieces(data, offsets))
    cut = {}
    for found in suffix_dedup._stretches(data, offsets, 700):
        cut |= strings(found)
    assert cut == whole and sorted(whole) == list(range(len(text) - 49))


def test_ftrl_learns():
    rng = np.random.default_rng(1)
    truth = rng.normal(size=40)
    rows = []
    for _ in range(1500):
        at = np.sort(rng.choice(40, 6, replace=False))
        rows.append((at, np.ones(6), int(truth[at].sum() > 0)))
    weights = linear.fit(rows[:1000], 40)
    right = [(weights[at].sum() + weights[-1] > 0) == bool(y) for at, _, y in rows[1000:]]
    assert sum(right) / len(right) > 0.9 and np.array_equal(weights, linear.fit(rows[:1000], 40))
    assert not linear.fit([], 40).any()


def test_calibration():
    rng = np.random.default_rng(2)
    margins = rng.normal(size=20_000) * 3
    labels = (rng.random(20_000) < linear.sigmoid(0.5 * margins - 1)).astype(int)
    slope, intercept = linear.calibrate(margins, labels)
    assert abs(slope - 0.5) < 0.05 and abs(intercept + 1) < 0.1
    assert linear.calibrate(margins, np.ones(20_000, int)) == (1.0, 0.0)


def test_verdict_on_rows_that_were_not_learnt(spark):
    here = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(here + "documents.parquet"), spark.read.parquet(here + "labels.parquet")
    learnt = labels.where("doc_id % 2 = 0")
    found = quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, learnt)).join(labels.where("doc_id % 2 = 1").withColumnRenamed("doc_id", "id"), "id").collect()
    rows = [r for r in found if not r.base_failed]
    assert len(rows) > 50 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.9
    error = sum((r.probability - r.quality) ** 2 for r in rows) / len(rows)
    assert error < 0.1  # calibrated: no worse than a constant by far


def test_samples_are_bounded(spark):
    docs = spark.createDataFrame([(1, "good text")] * 300 + [(2, "x" * 5000), (3, None), (4, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 5 + [(1, 0), (2, 0), (3, 1), (4, 0), (None, 1), (4, None), (4, 7)], "doc_id long, quality int")
    own = quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 10, 1000)
    assert sorted((r.id, r.y, r.text) for r in own.collect()) == [(1, 1, "good text"), (3, 1, ""), (4, 0, "bad")]
    assert quality_classifier.sample(docs, labels, "doc_id", "text", "quality", 1, 1000).count() <= 1


def test_classifier_on_odd_rows(spark, odd):
    labels = odd.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).distinct()
    got = quality_classifier.classify_quality(odd, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in odd.collect())
    for r in got:
        assert r.held_out is (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality_classifier.classify_quality(odd, none).collect()} == {0.5}


def test_pipeline_stages_on_odd_rows(spark, odd):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    here = "/root/testdata/sf0.001"
    for _, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, odd, here)
        rows = out.collect()
        assert rows and ("text" not in out.columns or out.columns == odd.columns)


def test_shards_hold_their_quotas(spark):
    rows = [(k, "w " * (1 + k % 50), f"s{k % 7 % 3}") for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, shards=4).collect()
    words = Counter()
    for r in got:
        for shard in r.shards:
            words[shard] += r.size
    assert set(words) == {0, 1, 2, 3} and max(words.values()) < 1.5 * min(words.values())
    assert sum(words.values()) == sum(r.taken for r in got)


def test_many_blocks_can_be_drawn():
    n = 50_000  # sources, each with as many blocks as mixing gives it then
    blocks = min(mixing.MAX_BLOCKS, mixing.MAX_DRAWN // ((mixing.MAX_REPEATS + 1) * n))
    assert blocks >= 1 and n * blocks * (mixing.MAX_REPEATS + 1) < 10**9
    shards = mixing.split([blocks * 4] * 2000, 3)
    assert [sum(x) for x in zip(*shards, strict=True)] == [blocks * 4] * 2000


@pytest.mark.parametrize("size", [1, 7, 60, 1000])
def test_margins_do_not_depend_on_stretches(monkeypatch, size):
    from concordat.llm import quality_classifier, quality_rules, textarrays

    rng = random.Random(size)
    words = ["the", "The", "the", "a1", "x", "#", "###", "word###", "end.", "é", "(so)", "\x0b", "\x01", " "]
    whole, cut = quality_rules.margins, lambda data, inside: textarrays.stretches(data, inside, size)
    weights = np.random.default_rng(3).normal(size=(1 << 18) + (1 << 18) + 1)
    for n in (0, 1, 2, 3, 40, 700):
        data = np.frombuffer("".join(rng.choice(words) + rng.choice([" ", "", "\n", "  "]) for _ in range(n)).encode(), np.uint8)
        offsets = np.array([0, len(data)])
        want = whole(data, offsets, weights)
        assert len([*cut(data, textarrays.NOT_SPACE)]) > 1 or n < 700 or size > 200
        with monkeypatch.context() as patch:
            patch.setattr(quality_classifier, "stretches", cut)
            patch.setattr(quality_rules, "stretches", cut)
            assert quality_rules.margins(data, offsets, weights) == pytest.approx(want, abs=1e-9)


def test_a_long_text_has_the_margin_of_the_whole(monkeypatch):
    from concordat.llm import quality_classifier, quality_rules

    rng = random.Random(9)
    data = np.frombuffer(" ".join(rng.choice(["lorem", "ipsum", "Dolor", "sit.", "#", "12"]) for _ in range(300_000)).encode(), np.uint8)
    weights, offsets = np.random.default_rng(3).normal(size=(1 << 19) + 1), np.array([0, len(data)])
    assert len(data) > 1 << 20
    got = quality_rules.margins(data, offsets, weights)
    for module in (quality_classifier, quality_rules):
        monkeypatch.setattr(module, "stretches", lambda data, inside: [(0, len(data))])
    assert got == pytest.approx(quality_rules.margins(data, offsets, weights), abs=1e-9)
