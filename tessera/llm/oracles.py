"""DuckDB statements for what SQL can express."""

#: Words of a text in lower case (A-Z), as a list.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM i),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id),
x AS (SELECT doc_id, item_id, count(*) AS shared FROM ds JOIN s USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, item_shingles, shared FROM x JOIN n USING (item_id) WHERE shared * 100 >= item_shingles * 80
"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n a ON u = a.doc_id JOIN n b ON v = b.doc_id WHERE 100 * shared >= 80 * (a.n + b.n - shared)),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS doc_id, min(v) AS low FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: crc32 of a text of ASCII characters: eight shifts for each of its bytes.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

OP11 = rf"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce({_CRC}, 1) AS h FROM documents),
g AS (SELECT id, doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS hit, h // 10 AS g, (h // 10) % greatest(len(w), 1) AS a FROM d),
x AS (SELECT id, n, i, w[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM g)),
f AS (
  SELECT 1 AS m, id, n, i, dense_rank() OVER (ORDER BY word) AS name FROM x
  UNION ALL
  SELECT 2 * m, id, n, i, dense_rank() OVER (ORDER BY name, half) FROM (SELECT *, lead(name, m) OVER (PARTITION BY id ORDER BY i) AS half FROM f) WHERE half IS NOT NULL AND n >= 4 * m + 4
),
s AS (SELECT m, id, i, lead(i) OVER (PARTITION BY m, id, name ORDER BY i) - i AS q FROM f),
k AS (SELECT *, i - row_number() OVER (PARTITION BY m, id, q ORDER BY i) AS island FROM s WHERE 2 * q > m AND q <= m),
r AS (SELECT id, min(i) AS start, max(i) - min(i) + q + m AS length, q AS period FROM k GROUP BY m, id, q, island HAVING max(i) - min(i) + q + m >= greatest(6, 4 * q)),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length::DOUBLE / period DESC, start, period) AS nth, count(*) OVER (PARTITION BY id) AS n_runs FROM r),
said AS (SELECT id, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY id),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS words FROM x ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, g.n AS n_words, coalesce(b.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM g LEFT JOIN b ON b.id = g.id AND nth = 1 LEFT JOIN said ON said.id = g.id LEFT JOIN kept ON kept.id = g.id
"""

OP12 = r"""
WITH p AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (VALUES (1), (2), (3)) AS v(k)) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, a, cut, string_split(phrase, ' ') AS w FROM f, (VALUES (1), (2)) AS v(cut) WHERE cut < k),
s AS (SELECT c.lang, c.phrase, c.k, c.a, cut, x.a AS l, y.a AS r, (1000000::HUGEINT * c.a * c.a // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase, a FROM f WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase AND k = 2 WHERE longest IS NULL OR 100 * longest < 50 * b.a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN t USING (lang) WHERE rank <= 2000
"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(k) for k in ("password", "passwd", "secret", "token", "api_?key"))


def _spans(kind: int, pattern: str, least: int) -> str:
    """id, no, start, stop, value of a pattern of two groups, from the text parted at its matches."""
    return rf"""
SELECT id, {kind} AS no, (list_sum(sizes[1:3 * j + 1]))::BIGINT AS start, (list_sum(sizes[1:3 * j + 3]))::BIGINT AS stop, own[3 * j + 3] AS value FROM (
  SELECT id, own, list_transform(own, lambda p: length(p)) AS sizes, unnest(range((len(own) - 1) // 3)) AS j FROM (
    SELECT id, string_split(regexp_replace(text, '{pattern}', chr(1) || '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS own FROM d)) WHERE length(own[3 * j + 3]) >= {least}"""


_ASSIGN = rf"((?:{_KEYS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?)([A-Za-z0-9+/_.=-]+)"

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS owner, translate(coalesce(text, ''), chr(1), chr(127)) AS text FROM documents),
base AS ({_spans(0, _ASSIGN, 12)} UNION ALL {_spans(1, '()(AKIA[A-Z0-9]+)', 18)} UNION ALL {_spans(2, '()([0-9a-f]+)', 16)}),
bare AS (SELECT * FROM ({_spans(3, '()([A-Za-z0-9_-]+)', 20)}) b WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare ANTI JOIN base ON base.id = bare.id AND base.start < bare.stop AND bare.start < base.stop),
owned AS (SELECT value, count(DISTINCT owner) >= 3 AS example, bool_or(no < 2) AS assigned FROM every JOIN d USING (id) GROUP BY value),
told AS (SELECT id, start, stop, example, CASE WHEN no < 3 THEN no WHEN assigned THEN 3 ELSE 4 END AS no, ['assign', 'access', 'hex', 'reuse', 'token'][CASE WHEN no < 3 THEN no WHEN assigned THEN 3 ELSE 4 END + 1] || ':' || start || ':' || stop AS said FROM every JOIN owned USING (value)),
x AS (SELECT id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, string_agg(said, ',' ORDER BY start, no, stop) FILTER (no < 3) AS base,
  string_agg(said, ',' ORDER BY start, no, stop) FILTER (no < 3 OR NOT example) AS spans, count(*) FILTER (no < 3 AND example) AS n_example, count(*) FILTER (NOT example) AS n_live FROM told GROUP BY id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN x USING (id)
"""
