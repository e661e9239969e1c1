"""DuckDB SQL for the queries of this subpackage that SQL can express, over whole tables."""

SQL: dict[str, str] = {}

SQL["op5_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, 3.0 * source_size / weight AS ratio FROM sums
), levels AS (
  -- the level at which exactly the sources before this one, by ratio, are full
  SELECT *, ((SELECT sum(source_size) FROM sums) - coalesce(sum(3.0 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ordered
), final AS (
  SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, source_size, least(3.0 * source_size, weight * level)::DOUBLE AS target FROM ordered, final
), rated AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target, (size * (floor(rate) + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken FROM rated
"""

SQL["op8_secret_scan"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source AS owner, coalesce(text, '') AS t FROM documents
), kinds(o, kind, p, g, least) AS (VALUES
  (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
  (2, 'hex', '[0-9a-f]+', 0, 24),
  (3, 'live', '[A-Za-z0-9+/_-]{20,}', 0, 20)
), m AS (
  SELECT r, doc_id, owner, 0 AS o, regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS w,
    regexp_extract_all(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
    string_split_regex(t, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS s FROM d
  UNION ALL SELECT r, doc_id, owner, 1, regexp_extract_all(t, 'AKIA[A-Z0-9]+') AS w, w, string_split_regex(t, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT r, doc_id, owner, 2, regexp_extract_all(t, '[0-9a-f]+') AS w, w, string_split_regex(t, '[0-9a-f]+') FROM d
  UNION ALL SELECT r, doc_id, owner, 3, regexp_extract_all(t, '[A-Za-z0-9+/_-]{20,}') AS w, w, string_split_regex(t, '[A-Za-z0-9+/_-]{20,}') FROM d
), each AS (
  SELECT r, doc_id, owner, o, i, length(w[i]) AS len, length(s[i]) AS gap, v[i] AS token FROM m, unnest(range(1, len(w) + 1)) AS u(i)
), spans AS (
  SELECT e.*, kind, sum(gap + len) OVER (PARTITION BY r, e.o ORDER BY i) AS "end", "end" - len AS start, length(token) >= least AS ok
  FROM each e JOIN kinds k ON e.o = k.o
), base AS (SELECT * FROM spans WHERE ok AND o < 3),
cand AS (SELECT * FROM spans WHERE o = 3 AND regexp_matches(token, '[0-9]') AND regexp_matches(token, '[A-Za-z]')),
held AS (
  SELECT token, count(DISTINCT owner) AS owners, count(*) AS docs, CASE WHEN count(DISTINCT owner) <= 1 AND count(*) <= 3 THEN 'live' ELSE 'copied' END AS class
  FROM (SELECT DISTINCT token, coalesce(owner, '?') AS owner, doc_id FROM (SELECT * FROM base UNION ALL SELECT * FROM cand)) GROUP BY token
), live AS (
  SELECT c.* FROM cand c SEMI JOIN (SELECT token FROM held WHERE class = 'live') USING (token)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c."end" AND c.start < b."end")
), by_base AS (
  SELECT r, count_if(o = 0) AS a, count_if(o = 1) AS k, count_if(o = 2) AS h, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, o) AS s FROM base GROUP BY r
), by_all AS (
  SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, o) AS s, string_agg(class || ':' || owners || ':' || docs, ',' ORDER BY start, o) AS c
  FROM (SELECT * FROM base UNION ALL SELECT * FROM live) JOIN held USING (token) GROUP BY r
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(k, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex,
  sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans, coalesce(e.c, '') AS classes
FROM d LEFT JOIN by_base b USING (r) LEFT JOIN by_all e USING (r)
"""

_URLS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut
), rules(say, rule, rhost, rpath) AS (VALUES ('allow', 'org/', 'org', '/'), ('block', 'example.org/es/', 'example.org', '/es/'),
  ('block', 'example.org/en/1', 'example.org', '/en/1'), ('allow', 'com/fr/', 'com', '/fr/'), ('block', 'com/de/', 'com', '/de/')
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(say, length(rule)) AS say
  FROM (SELECT DISTINCT host, path FROM p) x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL
), rows AS (
  SELECT p.*, rule, say, CASE say WHEN 'block' THEN 1 WHEN 'allow' THEN 0 END AS bad,
    list_transform(list_filter(string_split(p.path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
      WHEN regexp_matches(s, '^[0-9]+\.[A-Za-z]+$') THEN '{n}' || regexp_extract(s, '\.[A-Za-z]+$') WHEN regexp_matches(s, '^[0-9a-fA-F]{8,}$') THEN '{h}'
      WHEN regexp_matches(s, '[0-9]') AND length(s) >= 6 THEN '{x}' ELSE s END) AS segs
  FROM p LEFT JOIN best USING (host, path)
), shapes AS (
  SELECT host, segs, count(*) AS n, count(bad) AS seen, coalesce(sum(bad), 0) AS bad FROM rows GROUP BY host, segs
), w0 AS (SELECT *, segs AS t FROM shapes)"""

#: Levels of the tree; no path of the tables has more segments.
LEVELS = 6
for _d in range(LEVELS):  # rare children of crowded nodes, from the root down
    _URLS += f""",
c{_d} AS (SELECT host, array_to_string(t[1:{_d}], '/') AS parent, t[{_d + 1}] AS seg, sum(n) AS n_child FROM w{_d} WHERE len(t) > {_d} GROUP BY ALL),
r{_d} AS (SELECT c.* FROM c{_d} c JOIN (SELECT host, parent, sum(n_child) AS n_parent FROM c{_d} GROUP BY ALL HAVING count(*) > 12) USING (host, parent)
  WHERE NOT starts_with(seg, '{{') AND n_child < 0.05::DOUBLE * n_parent),
w{_d + 1} AS (SELECT w.host, segs, n, seen, bad, CASE WHEN r.seg IS NULL THEN t ELSE list_concat(list_concat(t[1:{_d}], ['*']), t[{_d + 2}:]) END AS t
  FROM w{_d} w LEFT JOIN r{_d} r ON w.host = r.host AND array_to_string(t[1:{_d}], '/') = r.parent AND t[{_d + 1}] = r.seg)"""
_URLS += f", m{LEVELS} AS (SELECT * FROM w{LEVELS})"
for _d in reversed(range(LEVELS)):  # branches that agree, from the leaves up
    _URLS += f""",
b{_d} AS (SELECT host, parent, seg, sum(o) AS n_branch, arg_min(sub, (-o, sub)) AS top, max(o) AS o, sum(bad) AS bad, sum(seen) AS seen FROM (
  SELECT host, array_to_string(t[1:{_d}], '/') AS parent, t[{_d + 1}] AS seg, array_to_string(t[{_d + 2}:], '/') AS sub, sum(n) AS o, sum(bad) AS bad, sum(seen) AS seen
  FROM m{_d + 1} WHERE len(t) > {_d} GROUP BY host, parent, seg, sub)
  WHERE sub <> '' AND seg <> '*' AND NOT starts_with(seg, '{{') GROUP BY host, parent, seg),
p{_d} AS (SELECT *, arg_min(top, (-n_pool, top)) OVER (PARTITION BY host, parent) AS largest FROM (
  SELECT host, parent, top, sum(n_branch) AS n_pool, sum(o) AS o_pool, sum(bad) AS bad_pool, sum(seen) AS seen_pool, count(*) AS k FROM b{_d} GROUP BY host, parent, top)),
e{_d} AS (SELECT b.*, largest, k, o_pool / n_pool AS share, n_branch * share AS expected, CASE WHEN seen_pool > 0 THEN bad_pool / seen_pool ELSE 0 END AS rate, seen * rate AS awaited
  FROM b{_d} b JOIN p{_d} USING (host, parent, top)),
a{_d} AS (SELECT host, parent, seg, CASE WHEN top = largest AND ({_d} = 0 OR k > 1) THEN '{{~}}' WHEN k > 1 THEN '{{~' || top || '}}' END AS name FROM e{_d}
  WHERE (expected < 5 OR n_branch - expected < 5 OR (o - expected) * (o - expected) <= 2.33::DOUBLE * 2.33::DOUBLE * expected * (1 - share))
  AND (awaited < 5 OR seen - awaited < 5 OR (bad - awaited) * (bad - awaited) <= 2.33::DOUBLE * 2.33::DOUBLE * awaited * (1 - rate))),
m{_d} AS (SELECT m.host, segs, n, seen, bad, CASE WHEN a.name IS NULL THEN t ELSE list_concat(list_concat(t[1:{_d}], [a.name]), t[{_d + 2}:]) END AS t
  FROM m{_d + 1} m LEFT JOIN a{_d} a ON m.host = a.host AND array_to_string(t[1:{_d}], '/') = a.parent AND t[{_d + 1}] = a.seg)"""
SQL["op9_url_filter"] = _URLS + """,
named AS (SELECT host, segs, bad, seen, array_to_string(t, '/') AS template FROM m0),
base AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(seen), 0) + 2.0::DOUBLE) AS base FROM shapes),
hosts AS (SELECT host, (sum(bad) + 4.0::DOUBLE * any_value(base)) / (sum(seen) + 4.0::DOUBLE) AS host_rate FROM shapes, base GROUP BY host),
pure AS (SELECT host, template, (sum(bad) + 4.0::DOUBLE * any_value(host_rate)) / (sum(seen) + 4.0::DOUBLE) AS purity FROM named JOIN hosts USING (host) GROUP BY host, template)
SELECT page_id, r.host, path, rule, coalesce(say, CASE WHEN purity >= 0.8 THEN 'block' ELSE 'allow' END) AS verdict, n.template
FROM rows r JOIN named n ON r.host = n.host AND r.segs = n.segs JOIN pure u ON n.host = u.host AND n.template = u.template
"""

_ASSIGNED = """
a{k} AS (
  SELECT x.r, x.p, (min((x.xx - 2 * list_inner_product(x.x, b.c) + list_inner_product(b.c, b.c)) * 256 + b.e))::BIGINT AS m
  FROM x JOIN b{k} b ON x.p = b.p GROUP BY x.r, x.p
)"""
_MOVED = """
s{k} AS (
  SELECT p, e, i, sum(c)::BIGINT AS s, count(*) AS n
  FROM (SELECT x.p, a.m % 256 AS e, unnest(range(len(x.x))) AS i, unnest(x.x)::BIGINT AS c FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p) GROUP BY p, e, i
), b{n} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c
  FROM b{k} b LEFT JOIN (SELECT p, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY i) AS c FROM s{k} GROUP BY p, e) m ON b.p = m.p AND b.e = m.e
)"""

SQL["op12_vector_codes"] = (
    """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT r, p, x, list_inner_product(x, x) AS xx
  FROM (SELECT r, p, v[p * len(v) // 4 + 1 : (p + 1) * len(v) // 4] AS x FROM kept, (SELECT unnest(range(4)) AS p))
), b0 AS (
  SELECT p, r - 1 AS e, x AS c FROM x WHERE r <= 256
),"""
    + ",".join(_ASSIGNED.format(k=k) + "," + _MOVED.format(k=k, n=k + 1) for k in range(4))
    + ","
    + _ASSIGNED.format(k=4)
    + """, digest AS (
  SELECT sha256(string_agg(c, ',' ORDER BY p, e, i)) AS codebooks_sha256
  FROM (SELECT p, e, unnest(range(len(c))) AS i, unnest(c)::BIGINT::VARCHAR AS c FROM b4)
), coded AS (
  SELECT k.vec_id, k.label, string_agg(lower(lpad(to_hex(a.m % 256), 2, '0')), '' ORDER BY a.p) AS code, sum(a.m // 256)::BIGINT AS error
  FROM a4 a JOIN kept k ON a.r = k.r GROUP BY k.r, k.vec_id, k.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM coded, digest
"""
)

SQL["op13_nearest"] = """
WITH kept AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  -- summed in the order of the components
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 20
"""

SQL["op11_collocations"] = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)
), f AS (
  SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), wide AS (
  SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1
), longer AS (
  SELECT lang, phrase, max(f) AS most FROM (
    SELECT lang, f, array_to_string(w[i : i + n - 1], ' ') AS phrase
    FROM (SELECT lang, f, w, n, unnest(range(1, k - n + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS n FROM wide))
  ) GROUP BY lang, phrase
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, (2000000 * c.f) // (l.f + r.f) AS score, c.j
  FROM (SELECT *, unnest(range(1, k)) AS j FROM wide) c
  JOIN f l ON l.lang = c.lang AND l.k = c.j AND l.phrase = array_to_string(c.w[1 : c.j], ' ')
  JOIN f r ON r.lang = c.lang AND r.k = c.k - c.j AND r.phrase = array_to_string(c.w[c.j + 1 : c.k], ' ')
), best AS (
  SELECT c.*, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS place FROM cuts c
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE b.place = 1 AND (g.most IS NULL OR 100 * g.most < 80 * b.a)
)
SELECT r.lang, r.rank, r.phrase, r.a::BIGINT AS a, r.l::BIGINT AS l, r.r::BIGINT AS r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

SQL["op7_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), occurring AS (
  SELECT r, i, n, win
  FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n))
  WHERE (n, win) IN (SELECT n, win FROM windows)
), hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occurring) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT o.r, w.item_id::VARCHAR AS item_id FROM occurring o JOIN windows w ON w.n = o.n AND w.win = o.win WHERE w.item_id IS NOT NULL) GROUP BY r
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON hits.r = d.r LEFT JOIN found ON found.r = d.r
"""

SQL["op10_line_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents
), lines AS (
  SELECT r, doc_id, i, regexp_replace(regexp_replace(line, '^' || b || '+', ''), b || '+$', '') AS x, len(list_filter(regexp_split_to_array(line, b || '+'), lambda w: w <> '')) AS n
  FROM (SELECT r, doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS line, '[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]' AS b FROM d WHERE text IS NOT NULL)
), summed AS (
  SELECT *, (sum(n) OVER (PARTITION BY r ORDER BY i))::BIGINT AS upto FROM lines
), worded AS (
  SELECT r, i, upto, upto - n AS before FROM summed WHERE n > 0
), runs AS (
  -- the shortest run of 20 words from each line on, and the one that ends with it
  SELECT a.r, a.doc_id, a.i AS s, b.i AS e FROM summed a ASOF JOIN worded b ON a.r = b.r AND a.upto - a.n + 20 <= b.upto
  UNION
  SELECT a.r, a.doc_id, b.i, a.i FROM summed a ASOF JOIN worded b ON a.r = b.r AND a.upto - 20 >= b.before
), texts AS (
  SELECT r, list(x ORDER BY i) AS xs FROM lines GROUP BY r
), keyed AS (
  SELECT u.r, u.s, u.e, row_number() OVER (PARTITION BY array_to_string(t.xs[u.s : u.e], chr(10)) ORDER BY u.doc_id NULLS LAST, u.r, u.s) AS place FROM runs u JOIN texts t ON t.r = u.r
), gone AS (
  SELECT DISTINCT r, unnest(range(s, e + 1)) AS i FROM keyed WHERE place > 1
), lists AS (
  SELECT r, list(i ORDER BY i) AS g FROM gone GROUP BY r
)
SELECT d.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(len(g), 0)::BIGINT AS n_deleted, coalesce(array_to_string(list_transform(g, lambda i: i - 1), ','), '') AS deleted,
  CASE WHEN g IS NULL THEN d.text ELSE array_to_string(list_filter(d.l, lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text
FROM d LEFT JOIN lists ON lists.r = d.r
"""
