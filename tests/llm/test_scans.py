import random
import string

import plain
import pytest

from concordat.llm import decontamination, license_scan, quality_rules, secret_scan
from concordat.llm.linear import Ftrl


def both(odd, small):
    return odd.select("doc_id", "text").union(small.select("doc_id", "text"))


def key(rows):
    return sorted(rows, key=repr)


def test_secrets(odd, small):
    docs = both(odd, small)
    got = secret_scan.scan_secrets(docs).collect()
    want = [(r.doc_id, *plain.secrets(r.text)) for r in docs.collect()]
    assert key([(r.id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got]) == key([w[:5] for w in want])
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("random")]
        assert r.base_sha256 == plain.sha(",".join(base))
    assert "random:0:30" in [r.spans for r in got if r.id == 12]


def test_random_strings():
    path = secret_scan.public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert secret_scan.is_random(b"kx9Qz7Lw2Vb8Rt5Yp3Nm6Jd4Hs1Gf0", path)
    assert not secret_scan.is_random(b"d41d8cd98f00b204e9800998ecf8427e", path)
    assert not secret_scan.is_random(b"123e4567-e89b-12d3-a456-426614174000", path)
    assert not secret_scan.is_random(b"internationalization_of_words", path)


def test_random_parts_of_runs(spark):
    path = secret_scan.public_tokenizers.path("byte_bpe_50k.tiktoken")
    draw = random.Random(5)
    for before, after in (("", ""), ("service/production/configuration/", ""), ("customer_subscription_identifier_", ""), ("configuration-", "/production/service"), ("NAME=", "")):
        for letters in (string.ascii_letters + string.digits, string.ascii_letters):
            for n in (20, 24, 32, 48):
                keys = ["".join(draw.choices(letters, k=n)) for _ in range(50)]
                spans = [secret_scan.random_spans(f"{before}{k}{after}".encode(), path) for k in keys]
                assert sum(any(s <= len(before) and e >= len(before) + n for s, e in found) for found in spans) >= 48
    for word in (b"com/google/android/gms/maps/model", b"customer_subscription_identifier_name", b"Donaudampfschifffahrtsgesellschaft", b"MAX_BUFFER_SIZE_IN_BYTES_PER_CONNECTION", b"A/B/C/D/E/F/G/H/I/J/K/L", b"MAX_SUBCLASSES_TO_DISPLAY", b"some/path/123e4567-e89b-12d3-a456-426614174000", b"2024-01-02-10-20-30-40-50", b"-" * 40):
        assert secret_scan.random_spans(word, path) == []
    hexes, key = "deadbeef" * 4, "kx9Qz7Lw2Vb8Rt5Yp3Nm6Jd4Hs1Gf0"
    texts = [(1, f"é {key}_{hexes}/{key} x"), (2, f"service/production/configuration/customer/subscription/identifier/{key[:24]}"), (3, f"{key}/token=abcdefghij {hexes}")]
    got = {r.id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got[1] == "random:2:33,hex:33:65,random:65:96" and got[2] == "random:66:90" and got[3] == "random:0:31,assign:31:47,hex:48:80"


def test_licences(odd, small):
    docs = both(odd, small)
    got = license_scan.scan_licences(docs).collect()
    want = [(r.doc_id, *plain.licences(r.text)) for r in docs.collect()]
    assert key([(r.id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got]) == key(want)
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in got)
    assert all(0 <= r.score <= 1 for r in got)


def test_licence_notice_is_chained(spark):
    notice = license_scan.NOTICES["mit-notice"].replace("free of charge", "gratis and free of any charge").title()
    got = license_scan.scan_licences(spark.createDataFrame([(1, "x " + notice), (2, "the software is free of charge")], "doc_id long, text string")).orderBy("id").collect()
    assert got[0].labels == "mit-notice" and got[0].score > 0.6
    assert got[1].labels == "" and got[1].score < 0.6


def test_licence_chain_keeps_what_it_gathered(spark):
    own = license_scan.NOTICES["apache-notice"].split()
    for k in (5, 19, 24):
        own[k] = "zzz"
    rows = [(1, " ".join(own)), (2, " ".join([*own, *["zzz"] * 20, *own]))]
    got = license_scan.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("id").collect()
    assert "apache-notice" in got[0].labels.split(",") and got[0].score >= 0.9
    assert [(s.first_word, s.end_word) for s in got[1].spans if s.label == "apache-notice"] == [(0, 31), (51, 82)]
    draw = random.Random(3)
    for _ in range(200):
        found = [(s, s + n, t, t + n) for s, n, t in ((draw.randrange(60), draw.randrange(4, 9), draw.randrange(25)) for _ in range(8))]
        every: dict = {}

        def follow(last, covered):
            every[last] = max(every.get(last, 0), covered)
            for m in found:
                if m[1] > last[1] and m[3] > last[3] and m[0] - last[1] <= license_scan.MAX_GAP:
                    follow(m, covered + min(m[3] - max(m[2], last[3]), m[1] - max(m[0], last[1])))

        for m in found:
            follow(m, m[1] - m[0])
        order = sorted(found, key=lambda m: (m[1], m[0], m[2]))
        assert [c for _, _, c in license_scan.chains(found)] == [every[m] for m in order]


@pytest.mark.parametrize("templates", [[[1, 2, 1, 2, 3]], [[1, 1, 1], [1, 2, 1]], [[4, 5], [5, 4], [4, 5, 4]]])
def test_matching_statistics(templates):
    automaton = license_scan.SuffixAutomaton(templates)
    runs = {tuple(t[a:b]) for t in templates for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    stream = [1, 2, 1, 1, 1, 2, 3, 9, 4, 5, 4, 5, 1, 2, 1, 2, 3]
    for n, (state, length) in enumerate(automaton.statistics(stream)):
        longest = max((n + 1 - k for k in range(n + 1) if tuple(stream[k : n + 1]) in runs), default=0)
        assert length == longest
        if length:
            own = tuple(stream[n + 1 - length : n + 1])
            assert automaton.ends[state] == {(k, e) for k, t in enumerate(templates) for e in range(length, len(t) + 1) if tuple(t[e - length : e]) == own}


def test_rules(spark, odd, small):
    docs = both(odd, small)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality_rules.fit_rules(small, labels)
    got = quality_rules.apply_rules(docs, model).collect()
    want = [(r.doc_id, *plain.rules(r.text)) for r in docs.collect()]
    assert key([(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got]) == key(want)
    assert not any(r.kept and r.base_failed for r in got)


def test_contamination(spark, odd, small):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").union(spark.createDataFrame([(900, "one"), (901, ""), (902, None), (None, "x"), (903, "Été, ﬂ")], "item_id long, text string"))
    docs = both(odd, small)
    got = decontamination.find_contamination(docs, items).collect()
    rows = [(r.item_id, r.text) for r in items.collect()]
    want = [(r.doc_id, *plain.contamination(r.text, rows)) for r in docs.collect()]
    assert key([(r.id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]) == key(want)
    assert any(r.contaminated for r in got)
    groups = decontamination.find_contamination(docs, items, item_bytes=4000).collect()  # several passes
    assert key([tuple(r) for r in groups]) == key([tuple(r) for r in got])
    for size in (decontamination.ITEM_BYTES, 4000):
        left = decontamination.drop_contaminated(docs, items, item_bytes=size).collect()
        assert left and sorted(map(repr, left)) == sorted(repr(d) for d, r in zip(docs.collect(), want, strict=True) if not r[-1])
    kept = decontamination.drop_contaminated(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({4, 5})


def test_neighbouring_hits_of_two_groups_are_one_run(spark):
    docs = spark.createDataFrame([(1, "x one two  three four y"), (1, "x one two  three four y"), (2, None), (3, "one")], "doc_id long, text string")
    items = spark.createDataFrame([(k, t) for k, t in enumerate(["one two", "three four", "two three", "five", "six", "seven"])], "item_id long, text string")
    whole, parts = ([tuple(r) for r in decontamination.find_contamination(docs, items, item_bytes=n).orderBy("id").collect()] for n in (1 << 20, 4))
    assert whole == parts and whole[0][2] == 4 and [(s.start, s.end) for s in whole[0][-1]] == [(2, 21)]
    assert sorted(r.doc_id for r in decontamination.drop_contaminated(docs, items, item_bytes=4).collect()) == [2, 3]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert secret_scan.scan_secrets(docs).count() == license_scan.scan_licences(docs).count() == 0
    assert decontamination.find_contamination(docs, items).count() == 0
    assert quality_rules.apply_rules(docs, quality_rules.fit_rules(docs, labels)).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not decontamination.find_contamination(some, items).first().contaminated


def test_long_runs_of_text_are_sliced(spark, monkeypatch):
    from concordat.llm import textarrays

    monkeypatch.setattr(textarrays.slices, "__defaults__", (64,))
    rows = [(k, "some words " * (k % 40)) for k in range(200)]
    import pyarrow as pa

    column = pa.array([t for _, t in rows])
    joined = [bytes(d[o[k] : o[k + 1]]) for lo, hi, d, o in textarrays.slices(column) for k in range(hi - lo)]
    assert joined == [t.encode() for _, t in rows]
    assert Ftrl().epochs > 0
