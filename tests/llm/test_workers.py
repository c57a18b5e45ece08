"""What Python workers keep between tasks, and how much memory stays with them."""

import os
import re
import sys

import public_tokenizers
import pyarrow as pa
import pytest

from concordat.llm import common, decontamination, mixing, simhash_dedup, token_files
from concordat.llm.textarrays import as_bytes

PATH = public_tokenizers.path("word_bpe_49k.json")


def _owners(spark) -> set[str]:
    """The operators whose state the workers hold."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"owner": pa.array([",".join(common._kept)] * batch.num_rows)})

    return {r.owner for r in spark.range(0, 64, 1, 8).mapInArrow(run, "owner string").collect()}


def test_a_worker_keeps_one_operators_state(spark, small):
    docs, items = small.limit(40), spark.createDataFrame([("a", "one two three")], "item_id string, text string")
    decontamination.drop_contaminated(docs, items).count()
    assert "decontamination" in _owners(spark)
    token_files.encode(docs, PATH).count()
    assert "token_files" in _owners(spark)
    for _ in range(4):  # whichever workers the tasks fall to
        simhash_dedup.fingerprints(docs.repartition(16)).count()
    assert not any("decontamination" in o and "token_files" in o for o in _owners(spark))
    common.kept("decontamination")["x"] = 1
    assert common.kept("") == {} and "decontamination" not in common._kept


@pytest.mark.skipif(common._trim is None or not os.path.exists("/proc/self/smaps_rollup"), reason="needs glibc on Linux")
def test_a_task_returns_freed_memory(spark):
    own = lambda: int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

    def run(batches):
        for batch in batches:
            before = own()
            every = [bytes(2000) for _ in range(60_000)]  # some 120 MB in small pieces
            sys.stays = last = every[-1]  # something in use at the end of the heap keeps the rest of it
            del every
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()]), "before": pa.array([before]), "held": pa.array([len(last)])})

    def probe(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()]), "now": pa.array([own()])})

    before = {r.pid: r.before for r in common.in_arrow(spark.range(0, 1, 1, 1), run, "pid long, before double, held long").collect()}
    for _ in range(20):
        now = {r.pid: r.now for r in spark.range(0, 1, 1, 1).mapInArrow(probe, "pid long, now double").collect()}
        if now.keys() & before.keys():
            break
    both = now.keys() & before.keys()
    assert both and all(now[p] - before[p] < 40 for p in both)


def test_frequent_units_stay_known(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 60)
    own, learned, learn = token_files.Encoder(PATH), [], token_files.Encoder._learn
    monkeypatch.setattr(token_files.Encoder, "_learn", lambda self, plain, whole: (learned.extend(plain + whole), learn(self, plain, whole)))
    library = token_files.Encoder(PATH)
    for k in range(30):
        text = "often é's and " + " ".join(f"rare{chr(97 + k % 26)}{chr(97 + j)}{chr(97 + k // 26)}" for j in range(20))
        ids, _ = own.encode(*as_bytes(pa.array([text])))
        assert ids.tolist() == [*library._ids([text])[0], token_files.END_ID] and len(own.memory) <= 90
    assert [learned.count(w) for w in (b"often", b"and", "é's".encode())] == [1, 1, 1] and len(own.n) == len(own.met) == len(own.memory)


def test_plans_of_the_mix_start_no_python_worker(spark):
    rows = mixing._rows(spark, [(0, None, 5, 2.5, 1, 0.5, 3), (1, "a", 1 << 40, 0.0, 0, 0.0, 1)], mixing._PLANS)
    assert [tuple(r) for r in rows.collect()] == [(0, None, 5, 2.5, 1, 0.5, 3), (1, "a", 1 << 40, 0.0, 0, 0.0, 1)]
    assert rows.dtypes == [("number", "int"), ("source", "string"), ("source_size", "bigint"), ("target", "double"), ("passes", "int"), ("rest", "double"), ("blocks", "int")]
    assert "Python" not in rows._jdf.queryExecution().toRdd().toDebugString()
    assert mixing._rows(spark, [], mixing._ENDS).count() == 0
