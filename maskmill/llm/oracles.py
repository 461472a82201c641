"""SQL for DuckDB that says what a query returns, for the queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _low(col: str) -> str:
    return f"translate(coalesce({col}, ''), '{UPPER}', '{LOWER}')"


def url_rules(rules: list[tuple]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    return f"""WITH r(h, p, v) AS (VALUES {values}),
a AS (SELECT page_id, row_number() OVER () AS n, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS t FROM pages),
u AS (SELECT page_id, n, translate(regexp_extract(t, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
f AS (SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN f USING (n)"""


DECONTAMINATION = rf"""WITH b AS (SELECT CAST(item_id AS varchar) AS item, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)),
d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS at FROM (SELECT DISTINCT doc_id, i, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def near_duplicates(percent: int, more: str) -> str:
    """Components of documents by 4-word shingles, with the columns that more adds."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_low("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, least(4, len(w)) AS k, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= {percent} * (nx.n + ny.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id{more} FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


def ball_codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """Codes by looking at every entry; a distance and its entry are one number, so that ties go to the lower index."""
    out = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::double)) AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT n, p, v[p * w + 1:(p + 1) * w] AS x FROM (SELECT n, v, len(v) // {parts} AS w, unnest(range({parts})) AS p FROM k))",
        f"e0 AS MATERIALIZED (SELECT p, n - 1 AS j, x AS c FROM x WHERE n <= {entries})",
    ]
    for t in range(rounds + 1):
        gap = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        out.append(f"a{t} AS MATERIALIZED (SELECT n, x.p AS p, any_value(x) AS x, min(CAST({gap} AS bigint) * {entries} + j) AS m FROM x JOIN e{t} e ON e.p = x.p GROUP BY n, x.p)")
        if t < rounds:
            out.append(f"s{t} AS (SELECT p, j, list(s ORDER BY i) AS c FROM (SELECT p, m % {entries} AS j, i, floor(sum(x[i]) / count(*)) AS s FROM (SELECT p, m, x, unnest(range(1, len(x) + 1)) AS i FROM a{t}) GROUP BY p, m % {entries}, i) GROUP BY p, j)")
            out.append(f"e{t + 1} AS MATERIALIZED (SELECT e.p AS p, e.j AS j, coalesce(s.c, e.c) AS c FROM e{t} e LEFT JOIN s{t} s ON s.p = e.p AND s.j = e.j)")
    return f"""WITH {", ".join(out)},
r AS (SELECT n, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::bigint AS error FROM a{rounds} GROUP BY n),
h AS (SELECT sha256(string_agg(CAST(CAST(c[i] AS bigint) AS varchar), ',' ORDER BY p, j, i)) AS h FROM (SELECT p, j, c, unnest(range(1, len(c) + 1)) AS i FROM e{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, h AS codebooks_sha256 FROM k JOIN r USING (n), h"""


def _turn_repair() -> str:
    """The least (cost, audit) of each state of the grammar from the last turn to the first, kept as one text: nine digits, then letters."""
    crc = (
        "xor(list_reduce([4294967295] || list_transform(range(1, length(s) + 1), lambda i: ord(s[i])::bigint), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, (a & 1) * 3988292384))), 4294967295)"
    )
    add = lambda s, c, letter: f"lpad(CAST(CAST(substr({s}, 1, 9) AS int) + {c} AS varchar), 9, '0') || {letter} || substr({s}, 10)"
    drop = lambda q: add(f"d.{q}", 3, "'D'")
    move = lambda to, q: f"CASE WHEN must THEN NULL ELSE {add('d.' + q, f'cut + CASE WHEN first = {to!r} THEN 0 ELSE 2 END', f'CASE WHEN first = {to!r} THEN chr(75) ELSE chr(82) END')} END"
    keep_s = f"CASE WHEN first = 's' AND NOT must THEN {add('d.qs', 'cut', chr(39) + 'K' + chr(39))} END"
    insert = lambda s: add(s, 2, "'I'")
    some = lambda *xs: f"list_min([{', '.join(xs)}])"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS s FROM conversations),
h AS (SELECT conv_id, turn, role, text, {crc} % 20 AS how FROM c),
m AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h JOIN (VALUES (1), (2)) v(again) ON again = 1 OR how = 3 WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM m),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM n),
g AS (SELECT *, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut, left(role, 1) AS first FROM f),
o AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::bigint AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
d AS (SELECT conv_id, n + 1 AS i, '000000000' AS q0, '000000004II' AS qs, '000000002I' AS qu, '000000000' AS qa FROM o UNION ALL
SELECT conv_id, i, {some('b0', insert('u'))}, {some('bs', insert('u'))}, u, {some('ba', insert('bu'))} FROM (SELECT *, {some('bu', insert('ba'))} AS u FROM (SELECT d.conv_id AS conv_id, g.i AS i, {some(drop('q0'), move('u', 'qu'), keep_s)} AS b0, {some(drop('qs'), move('u', 'qu'))} AS bs, {some(drop('qu'), move('a', 'qa'))} AS bu, {some(drop('qa'), move('u', 'qu'))} AS ba
FROM d JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND g.i = d.i - 1))),
p AS (SELECT o.*, CAST(substr(q0, 1, 9) AS bigint) AS cost, substr(q0, 10) AS audit FROM o JOIN d ON d.conv_id IS NOT DISTINCT FROM o.conv_id AND d.i = 1),
e AS (SELECT conv_id, spot, substr(audit, spot, 1) AS edit, length(replace(substr(audit, 1, spot), 'I', '')) AS i, length(replace(substr(audit, 1, spot), 'D', '')) AS place, length(replace(audit, 'D', '')) % 2 AS odd FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS spot FROM p) AS places),
l AS (SELECT e.conv_id AS conv_id, spot, CASE WHEN edit = 'K' THEN role WHEN (place - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM e JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id AND g.i = greatest(e.i, 1) WHERE edit <> 'D'),
w AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY spot)) AS sha FROM l GROUP BY conv_id)
SELECT a.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM a.conv_id"""


TURN_REPAIR = _turn_repair()
