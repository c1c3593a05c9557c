"""SQL for the results of those queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

MIXING = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size, md5('1:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY 1),
w AS (SELECT *, ([5.0, 2.0, 1.0])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, (3 * ss)::DOUBLE AS cap, (sum(ss) OVER ())::DOUBLE AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, ss, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM f WHERE level * w <= cap) * w, cap)) AS target FROM f),
m AS (SELECT *, coalesce(floor(target / nullif(ss, 0)), 0)::BIGINT AS whole, greatest(0, target - coalesce(floor(target / nullif(ss, 0)), 0) * ss) AS missing FROM t),
g AS (SELECT d.source, d.size, any_value(missing) AS missing, (count(*) * d.size)::DOUBLE AS cap, count(*) * pow(d.size, 1.5) AS w FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source WHERE d.size > 0 AND missing > 0 GROUP BY 1, 2),
k AS (SELECT *, (missing - coalesce(sum(cap) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g),
v AS (SELECT source, arg_min(level, cap / w) AS level FROM k WHERE level * w <= cap GROUP BY 1),
p AS (SELECT d.*, m.ss, m.target, m.whole, m.missing, CASE WHEN size > 0 AND level IS NOT NULL THEN least(1.0, level * pow(size, 0.5)) ELSE 0.0 END AS pi, (('0x' || substr(h, 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN v ON d.source IS NOT DISTINCT FROM v.source),
c AS (SELECT *, missing - coalesce(sum(size) FILTER (pi >= 1) OVER (PARTITION BY source), 0) AS rest, CASE WHEN pi > 0 AND pi < 1 THEN u * (1 - pi) / (u * (1 - pi) + (1 - u) * pi) END AS z FROM p),
r AS (SELECT *, sum(CASE WHEN z IS NOT NULL THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY z NULLS LAST, h) AS upto FROM c)
SELECT doc_id, size::BIGINT AS size, ss AS source_size, target, (size * (whole + CASE WHEN pi >= 1 THEN 1 WHEN z IS NULL THEN 0 WHEN upto <= rest THEN 1
  WHEN upto - size <= rest AND upto - rest < rest - (upto - size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""

LINES = rf"""
WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, {_LOWER.format(r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (key IN (FROM f)) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (key NOT IN (FROM f)), '')) AS kept_sha256 FROM k GROUP BY 1"""

TOKENS = rf"""
WITH d AS (SELECT CASE WHEN l.quality = 0 THEN 'low quality' ELSE source END AS source, lang, text FROM documents LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0)
SELECT source, lang, 'words-1' AS version, count(*) AS docs, sum(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')))::BIGINT AS tokens FROM d GROUP BY 1, 2 UNION ALL
SELECT source, lang, 'marks-1', count(*), sum(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^\x20\x09-\x0DA-Za-z0-9]+')))::BIGINT FROM d GROUP BY 1, 2"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(x) >= 3 THEN list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) WHEN len(x) > 0 THEN [array_to_string(x, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

DIVERGENCE = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER.format("coalesce(text, '')")} AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 10),
l AS (SELECT lang, count(*) AS kept, sum(lang_n) AS lang_total FROM v GROUP BY 1),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN v USING (lang, term) GROUP BY 1, 2, 3),
x AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, lang_n::HUGEINT AS lang_n FROM g JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (SELECT x.*, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * kept) AS p, 1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * kept) AS q FROM x JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM s WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r
QUALIFY part = 'pair' OR rank <= 10"""

SEARCH = rf"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM d),
m AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM d, g),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY 1, 2),
u AS (SELECT * FROM p SEMI JOIN q USING (term)),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM u GROUP BY 1), g),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN u USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20"""

SQL = {
    "op1_chat_format": CHAT,
    "op4_source_mixing": MIXING,
    "op5_line_dedup": LINES,
    "token_counts_plain": TOKENS,
    "op10_minhash_near_dedup": NEAR,
    "op11_block_max_search": SEARCH,
    "op13_source_divergence": DIVERGENCE,
}
