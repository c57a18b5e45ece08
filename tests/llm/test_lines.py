import random
import re

from pyspark.sql import functions as F

from concordat.llm import line_dedup


def plain_lines(page):
    page = page or ""
    for kind in ("script", "style", "noscript", "template"):
        page = re.sub(rf"(?is)<{kind}\b.*?(</{kind}\s*>|\Z)", "\n", page)
    page = re.sub(r"(?s)<!--.*?(-->|\Z)", "", page)
    page = re.sub(line_dedup.BREAK, "\n", page)
    page = re.sub(r"</?[A-Za-z!?][^<>]*>", "", page)
    return [x for x in (re.sub(r"[ \t\r\f]+", " ", x).strip(" ") for x in page.split("\n")) if x]


def test_against_brute_force(spark):
    rng = random.Random(4)
    lines = [f"line {k}" for k in range(12)]
    rows = []
    for k in range(300):
        host = rng.choice(["a.example", "b.example:80", "u@c.example", "one.example" if k == 7 else "a.example"])
        own = [x for x in lines if rng.random() < int(x.split()[1]) / 16] + [f"own {k}"]
        body = "".join(rng.choice(["<p>{}</p>", "<div class='x'>{}<br>", "<li>{}  </li>", "{}\n", "<b>{}</b><hr>"]).format(x) for x in own)
        rows.append((k, f"https://{host}/p{k}?q", f"<script>var t='<p>x</p>';</script><!-- <p>no</p> -->{body}{body if k % 9 == 0 else ''}", "clash"))
    rows += [(400, None, "<p>a"), (401, "not a url", None), (402, "", ""), (403, None, "<p>a"), (404, None, "<P>a</P><p>a"), (None, "https://a.example", "<p>line 11</p>")]
    rows = [(*r, "clash")[:4] for r in rows]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string, host string")).collect()
    host = lambda u: (m[1].lower() if u and (m := re.match(line_dedup.HOST, u)) else "")
    totals, held = {}, {}
    for _, url, page, _ in rows:
        totals[host(url)] = totals.get(host(url), 0) + 1
        for x in set(plain_lines(page)):
            held[host(url), x] = held.get((host(url), x), 0) + 1
    want = []
    for i, url, page, _ in rows:
        own = plain_lines(page)
        kept = [x for x in own if not (held[host(url), x] >= 3 and held[host(url), x] > 0.3 * totals[host(url)])]
        want.append((i, host(url), len(own), len(own) - len(kept), kept))
    assert sorted(map(repr, ((r.id, r.host, r.n_lines, r.n_dropped, r.kept) for r in got))) == sorted(map(repr, want))
    assert sum(w[3] for w in want) > 100


def test_empty(spark):
    assert line_dedup.drop_boilerplate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_lines_of_odd_pages(spark):
    import time

    pages = ["<p>a<script>x</style>y</script>b", "a<p>b<script>hidden<p>c", "a<!-- b<p>c", "1 < 2<p>3 > 2 <b>x</b>", "<" * 300_000 + "end", "<script " * 60_000, "<p <p <p>a", None]
    began = time.time()
    got = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k long, html string").select("k", line_dedup.lines(F.col("html")).alias("x")).orderBy("k").collect()
    assert time.time() - began < 60  # a page takes time in proportion to its length
    assert [r.x for r in got][:4] == [["a", "b"], ["a", "b"], ["a"], ["1 < 2", "3 > 2 x"]] and got[4].x == ["<" * 300_000 + "end"] and got[5].x == [] and got[7].x == []
