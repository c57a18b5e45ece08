"""SQL twins of the operators' queries that SQL can express."""

from .line_dedup import BREAK, COMMENT, HIDDEN, HOST, MIN_PAGES, RATIO, SPACES, TAG

#: Words of a column as the decontamination operator takes them.
_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS.format("text")} AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS t FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS u(i) WHERE len(w) > 0),
s AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS t FROM d, (SELECT DISTINCT n FROM p) AS sizes, unnest(range(1, len(w) - n + 2)) AS u(i) WHERE len(w) >= n),
h AS (SELECT r, i, n, item FROM s JOIN p USING (n, t)),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM h, unnest(range(i, i + n)) AS u(k) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS own FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(own, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS t FROM d, unnest(range(0, n - 49)) AS u(i) WHERE n >= 50),
f AS (SELECT t, min(doc_id) AS first FROM s GROUP BY t HAVING min(doc_id) < max(doc_id)),
g AS (SELECT doc_id, i FROM s JOIN f USING (t) WHERE doc_id > first),
c AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS cut FROM g),
k AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) GROUP BY doc_id, run),
p AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_, max(b) OVER (PARTITION BY doc_id) AS last FROM k),
r AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * any_value(last) + 1) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""


def _line_dedup() -> str:
    text = "coalesce(html, '')"
    for pattern, by in (*((h, "chr(10)") for h in HIDDEN), (COMMENT, "''"), (BREAK, "chr(10)"), (TAG, "''"), (SPACES, "' '")):
        text = f"regexp_replace({text}, '{pattern}', {by}, 'g')"
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, lower(regexp_extract(coalesce(url, ''), '{HOST}', 1)) AS host, list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS own FROM pages),
t AS (SELECT host, count(*) AS n FROM p GROUP BY host),
h AS (SELECT host, line, count(*) AS held FROM (SELECT host, unnest(list_distinct(own)) AS line FROM p) GROUP BY host, line),
b AS (SELECT host, list(line) AS over FROM h JOIN t USING (host) WHERE held >= {MIN_PAGES} AND held > {RATIO} * n GROUP BY host)
SELECT page_id, host, len(own)::BIGINT AS n_lines, (len(own) - len(k))::BIGINT AS n_dropped, sha256(array_to_string(k, chr(10))) AS kept_sha256
FROM (SELECT page_id, host, own, list_filter(own, lambda x: NOT list_contains(coalesce(over, []), x)) AS k FROM p LEFT JOIN b USING (host))
"""


LINE_DEDUP = _line_dedup()

FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask
  FROM d JOIN f USING (t) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM e AS a, e AS b, e AS c, e AS d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS own, coalesce(list_sum([1 << (ascii(substr(filter_order, i, 1)) - 65) FOR i IN range(1, step)]), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r
"""

#: The table of the CRC-32 by its rule, the bytes of a text, and the checksum of bytes in ``l`` with the table in ``t``.
_CRC_TABLE = "SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS t"
_BYTES = """list_concat([4294967295], coalesce(flatten(list_transform(string_split({}, ''), lambda c: CASE WHEN c = '' THEN [] WHEN ord(c) < 128 THEN [ord(c)] WHEN ord(c) < 2048 THEN [192 + (ord(c) >> 6), 128 + (ord(c) & 63)]
    WHEN ord(c) < 65536 THEN [224 + (ord(c) >> 12), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] ELSE [240 + (ord(c) >> 18), 128 + ((ord(c) >> 12) & 63), 128 + ((ord(c) >> 6) & 63), 128 + (ord(c) & 63)] END))::BIGINT[], []))"""
_CRC = "xor(4294967295, list_reduce(l, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])))"

#: Repeated eight-word strings a period apart, in stretches of successive places; a run has 24 words and three periods.
PERIODIC_RUNS = rf"""
WITH tab AS ({_CRC_TABLE}),
b AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_BYTES.format("coalesce(doc_id::VARCHAR, '')")} AS l FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN doc_id IS NOT NULL THEN {_CRC} END AS h FROM b, tab),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS per FROM p),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % per ELSE i END]) END AS w FROM q),
g AS (SELECT r, n, i, array_to_string(w[i + 1 : i + 8], ' ') AS t FROM d, unnest(range(0, n - 7)) AS u(i) WHERE n >= 24),
x AS (SELECT a.r, b.i - a.i AS q, a.i FROM g AS a JOIN g AS b ON a.r = b.r AND a.t = b.t AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
y AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM x),
z AS (SELECT r, q, min(i) AS s, count(*) + 7 + q AS m FROM y GROUP BY r, q, k HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
runs AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM z AS o WHERE o.r = z.r AND o.q < z.q AND z.q % o.q = 0 AND o.s <= z.s AND o.s + o.m >= z.s + z.m)),
best AS (SELECT r, s, m, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY m::DOUBLE / q DESC, s, q) = 1),
texts AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q) AS own FROM runs GROUP BY r),
gone AS (SELECT r, list(DISTINCT i) AS gone FROM runs, unnest(range(s + q, s + m)) AS u(i) GROUP BY r),
left_ AS (SELECT r, string_agg(w[i + 1], ' ' ORDER BY i) AS kept FROM d, unnest(range(0, n)) AS u(i) WHERE NOT EXISTS (SELECT 1 FROM (SELECT r AS gr, unnest(gone) AS gi FROM gone) WHERE gr = r AND gi = i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli, sha256(coalesce(own, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (r) LEFT JOIN texts USING (r) LEFT JOIN left_ USING (r)
"""

#: A key has 16 jumps at most on its way through 17 shards.
SHARDING = f"""
WITH RECURSIVE tab AS ({_CRC_TABLE}),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {_BYTES.format("coalesce(text, '')")} AS l FROM documents),
k AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS key FROM documents),
j AS (
  SELECT key, 0 AS jump, 0::BIGINT AS shard FROM k
  UNION ALL
  SELECT key, jump + 1, floor((CASE WHEN jump = 0 THEN 0 ELSE shard END + 1) * 2147483648.0 / ((('0x' || substr(md5(key || ':' || jump), 1, 8))::BIGINT >> 1) + 1))::BIGINT FROM j WHERE shard < 17),
s AS (SELECT key, max(shard) FILTER (shard < 16) AS shard, max(shard) FILTER (shard < 17) AS grown FROM j GROUP BY key),
c AS (SELECT doc_id, size, {_CRC} AS text_crc32 FROM d, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown::INT AS grown_shard
FROM c JOIN s ON coalesce(doc_id::VARCHAR, '') = key
"""
