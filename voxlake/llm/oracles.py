"""DuckDB SQL for the operators that SQL can express."""

OP1 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM x),
f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
g AS (SELECT DISTINCT doc_id, i + j AS p FROM k JOIN f USING (k), (SELECT range AS j FROM range(13)) WHERE doc_id > m),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM p ANTI JOIN g USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""


def _level(name: str, rows: str, key: str) -> str:
    """Common table expressions that shrink rows(key, n, bad, prior): name_m(m) and name(key, rate, m)."""
    return f"""{name}_m AS (SELECT least(greatest(round(coalesce(CASE WHEN chi > keys THEN (noise - keys) / (chi - keys) - 1 ELSE 1000 END, 1000), 6), 1), 1000) AS m
  FROM (SELECT sum(n * prior * (1 - prior)) AS noise, sum(pow(bad - n * prior, 2) / n) AS chi, sum(prior * (1 - prior)) AS keys FROM {rows} WHERE n > 0)),
{name} AS (SELECT r.*, CASE WHEN n > 0 THEN (bad + m * prior) / (n + m) ELSE prior END AS rate, CASE WHEN n > 0 THEN m ELSE 1 END AS strength FROM {rows} r, {name}_m)"""


OP5 = f"""
WITH p AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM p),
o AS (SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, string_split(host, '.')[-1] AS suffix,
  CASE WHEN len(string_split(host, '.')) > 1 THEN string_split(host, '.')[-2] || '.' || string_split(host, '.')[-1] ELSE host END AS domain
  FROM s LEFT JOIN o ON page_id = doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
x0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 0.5) / (sum(n) + 1) FROM d) AS prior FROM d GROUP BY suffix),
{_level('x', 'x0', 'suffix')},
d0 AS (SELECT d.*, x.rate AS prior FROM d JOIN x USING (suffix)),
{_level('dd', 'd0', 'domain')},
h0 AS (SELECT h.host, h.n, h.bad, dd.rate AS prior FROM h JOIN dd USING (domain)),
{_level('hh', 'h0', 'host')},
b AS (SELECT host, greatest(0, rate - 1.64 * sqrt(rate * (1 - rate) / (n + strength + 1))) AS bound FROM hh),
f AS (SELECT page_id, host, path, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule, bound FROM s JOIN b USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL OR bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM f"""


def _h(*parts: str) -> str:
    return f"sha256({' || '.join(parts)})"


def _field(column: str) -> str:
    return f"coalesce(octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR, '-')"


def _leaf(n: str) -> str:
    return _h(*map(_field, ("doc_id", "source", "lang", n, "text")))


# CRC-32 of a decimal number, bit by bit; the number is the reversed polynomial.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _tree(name: str, leaves: str, key: str) -> str:
    """Tables name(k, lvl, i, h, m) of all nodes over leaves(k, i, h): node i of m on level lvl of the tree k."""
    return f"""{name} AS (SELECT {key} AS k, 0 AS lvl, i, h, count(*) OVER (PARTITION BY {key}) AS m FROM {leaves} UNION ALL
  SELECT k, lvl + 1, i // 2, {_h("string_agg(h, '' ORDER BY i)")}, (any_value(m) + 1) // 2 FROM {name} WHERE m > 1 GROUP BY k, lvl, i // 2)"""


OP11 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, coalesce('=' || lang, '') AS k, {_leaf('n_chars')} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf('(n_chars + 1)')} ELSE {_leaf('n_chars')} END AS shown FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h FROM d),
{_tree('t', 'l', 'k')},
s AS (SELECT k AS of, h, row_number() OVER (ORDER BY k) - 1 AS i, '' AS k FROM t WHERE m = 1),
{_tree('u', 's', 'k')},
up AS (SELECT l.k, l.i, v.lvl, (l.i >> v.lvl) & 1 = 1 AS odd, y.h AS sib FROM l JOIN (SELECT DISTINCT k, lvl FROM t WHERE m > 1) v USING (k)
    LEFT JOIN t y ON y.k = l.k AND y.lvl = v.lvl AND y.i = xor(l.i >> v.lvl, 1)
  UNION ALL SELECT l.k, l.i, 1000 + v.lvl, (s.i >> v.lvl) & 1 = 1, y.h FROM l JOIN s ON s.of = l.k, (SELECT DISTINCT lvl FROM u WHERE m > 1) v
    LEFT JOIN u y ON y.lvl = v.lvl AND y.i = xor(s.i >> v.lvl, 1)),
proof AS (SELECT k, i, list({{'odd': odd, 'sib': sib}} ORDER BY lvl) AS p FROM up GROUP BY k, i),
o AS (SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM u WHERE m = 1) AS root, coalesce(p, []) AS p, l.shown FROM l JOIN s ON s.of = l.k LEFT JOIN proof ON proof.k = l.k AND proof.i = l.i),
f AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: coalesce(x.sib, '')), '')) AS proof_sha256,
  list_reduce(list_prepend({{'odd': false, 'sib': shown}}, p), lambda h, x: {{'odd': false, 'sib': sha256(CASE WHEN x.odd THEN x.sib || h.sib ELSE h.sib || coalesce(x.sib, '') END)}}).sib AS folded_root FROM o)
SELECT *, folded_root = root AS verified FROM f"""

OP12 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
x AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS members FROM w),
m AS (SELECT doc_id, len(members) AS n, hash(unnest(members)) AS h FROM x),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT doc_id AS node, doc_id AS reached FROM x UNION SELECT r.node, CASE WHEN e.a = r.reached THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.reached OR e.b = r.reached),
g AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT x.doc_id, CAST(len(members) AS BIGINT) AS n_shingles, component_id, x.doc_id = component_id AS kept FROM x JOIN g ON g.node = x.doc_id"""

_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * v)"

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
o AS (SELECT id, lang, source, unnest(ts) AS term FROM d),
g AS (SELECT lang, source FROM d GROUP BY ALL),
k AS (SELECT lang, term, count(*) AS q_count FROM o GROUP BY ALL HAVING count(DISTINCT id) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, q_count FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total, count(*) OVER (PARTITION BY lang, source) AS v FROM f),
l AS (SELECT lang, sum(q_count) AS q_total FROM k GROUP BY lang),
p AS (SELECT lang, source, term, n, {_SHARE.format('n', 'total')} AS p, {_SHARE.format('q_count', 'q_total')} AS q FROM s JOIN l USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs z ON z.lang = x.lang AND z.source = x.source AND z.item = y.source
  UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM parts)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50"""
