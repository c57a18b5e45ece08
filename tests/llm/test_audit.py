import random
import re
from itertools import permutations

from plain import ANY_WORD

from concordat.llm.filter_audit import audit, cells


def fails(doc_id, text, rows):
    text, words = text or "", ANY_WORD.findall(text or "")
    out = set()
    if len(words) < 200:
        out.add("A")
    if 100 * len(set(words)) < 50 * len(words):
        out.add("B")
    if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
        out.add("C")
    if re.search(r"[#$%&*|]", text):
        out.add("D")
    if doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows):
        out.add("E")
    return out


def plain_audit(rows, labels):
    by_part, out, shares = {}, {}, {}
    for i, t, s in rows:
        marked = [any(lab[k] == 1 for lab in labels if i is not None and lab[0] == i) for k in (1, 2)]
        by_part.setdefault(s or "", []).append((fails(i, t, rows), *marked))
    for part, held in by_part.items():
        for order in map("".join, permutations("ABCDE")):
            stay = held
            for step, name in enumerate(order, 1):
                gone = [d for d in stay if name in d[0]]
                stay = [d for d in stay if name not in d[0]]
                shares[part, name] = shares.get((part, name), 0) + len(gone)
                out[part, order, step] = [len(stay), len(gone), sum(name in d[0] for d in held) - len(gone), sum(d[0] == {name} for d in held), sum(d[1] for d in gone), sum(d[2] for d in gone)]
    return sorted((*k, *v, shares[k[0], k[1][k[2] - 1]]) for k, v in out.items())


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def rows_of(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, source string, part string, n int").repartition(3)
    known = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, id string")
    return sorted(map(tuple, audit(cells(docs, known)).select(*COLUMNS).collect()))


def test_against_brute_force(spark):
    rng = random.Random(11)
    texts = [None, "", " \t", "A", "a b c", "é " * 300, "ﬂ\x1cx " * 250]
    for _ in range(60):
        words = [rng.choice(["w%d" % rng.randrange(400), "the", "The"]) for _ in range(rng.choice([5, 199, 200, 201, 500]))]
        texts.append(rng.choice(["", "\x0b", "\n"]) + " ".join(words) + rng.choice(["", "#", " |", " HELLO " * 9]))
    rows = [(rng.choice([None, k, k % 17, 5]), rng.choice(texts), rng.choice(["src0", "src0", "src1", "", None, "ſ"])) for k in range(400)]
    rows += rows[:20] + [(k, "the one text", "src0") for k in range(500, 560)] + [(499, "the one text", "src1"), (499, "the one text", "src0")]
    labels = [(rng.randrange(560), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(300)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    got = rows_of(spark, rows, labels)
    assert got == plain_audit(rows, labels)
    assert len(got) == 4 * 600 and all(sum(r[k] for r in got) for k in range(3, 10))


def test_of_no_rows(spark):
    assert rows_of(spark, [], []) == []
    assert rows_of(spark, [], [(1, 1, 1)]) == []
    assert rows_of(spark, [(1, None, None)], []) == plain_audit([(1, None, None)], [])


def test_only_native_expressions_and_no_text_is_shuffled(spark):
    docs = spark.createDataFrame([(1, "a", "s")], "doc_id long, text string, source string")
    plan = audit(cells(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "text", "Cartesian", "NestedLoop"))
