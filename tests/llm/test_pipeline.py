from collections import Counter

import plain
import pytest

from concordat.llm import mixing, quality_classifier
from concordat.llm.common import table

corpus_pipeline = pytest.importorskip("corpus_pipeline")
HERE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, HERE, "documents")
    scores = {r.doc_id: r.predicted for r in quality_classifier.classify_quality(docs, table(spark, HERE, "labels")).collect()}
    at = docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, HERE)
        assert at.columns == docs.columns
        at = spark.createDataFrame(at.collect(), docs.schema)
        kept[name] = at
    rows = docs.collect()
    good = [r for r in rows if scores[r.doc_id] == 1]
    assert sorted(r.doc_id for r in kept["quality classifier"].collect()) == sorted(r.doc_id for r in good)
    roots = plain.components([(r.doc_id, plain.fingerprint(r.text)) for r in good])
    unique = [r for r in good if roots[r.doc_id] == r.doc_id]
    assert sorted(r.doc_id for r in kept["near duplicates"].collect()) == sorted(r.doc_id for r in unique)
    items = [(r.item_id, r.text) for r in table(spark, HERE, "benchmark").collect()]
    clean = [r for r in unique if not plain.contamination(r.text, items)[-1]]
    assert sorted(r.doc_id for r in kept["benchmark decontamination"].collect()) == sorted(r.doc_id for r in clean)
    taken = {r.id: len(r.shards) for r in mixing.mix(spark.createDataFrame(clean, docs.schema)).collect()}
    assert Counter(r.doc_id for r in kept["mixing"].collect()) == Counter(taken)
    last = corpus_pipeline.STAGES[-1][1](spark, kept["mixing"], HERE).collect()
    assert Counter(r.doc_id for r in last) == Counter(taken)
    whole = corpus_pipeline.run(spark, HERE).collect()
    assert sorted(whole) == sorted(last)


def test_empty(spark):
    none = table(spark, HERE, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = spark.createDataFrame([], stage(spark, none, HERE).schema)


def test_held_out_accuracy(spark):
    here = "/root/testdata/sf0.01"
    found = quality_classifier.classify_quality(table(spark, here, "documents"), table(spark, here, "labels"))
    rows = found.join(table(spark, here, "labels"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
