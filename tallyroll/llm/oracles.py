"""SQL of the queries that DuckDB can answer on whole tables."""

from __future__ import annotations

import re

from .quality import MAX_HOST_RATE, MAX_PRIOR_DOCS
from .urls import LOWER, OTHER_RULES, PATH_RULES, UPPER

WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP3 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 49, 0))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
late AS (SELECT doc_id, i FROM win JOIN f USING (s) WHERE m < doc_id),
isl AS (SELECT doc_id, i, sum(CAST(i > coalesce(p + 50, -1) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM late)),
sp AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY ALL),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS pb FROM sp),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' ORDER BY a) AS t, max(b) AS e, sum(b - a) AS n, count(*) AS c FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t || substr(h, 2 * e + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' ')) END) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n y ON y.doc_id = p.a JOIN n z ON z.doc_id = p.b WHERE 100 * i >= 85 * (y.n + z.n - i)),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS c FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

OP7 = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM i),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
x AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c WHERE c > 1),
rep AS (SELECT doc_id, CAST(sum(least(5, i - coalesce(p, i - 5))) AS BIGINT) AS n FROM x GROUP BY doc_id),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda q: regexp_matches(q, '[^\\x20\\x09-\\x0D]')) AS l FROM w),
b AS (SELECT w.doc_id, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM f WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT least(greatest(avg(k / n), 1e-6), 1 - 1e-6) AS mu, coalesce(var_samp(k / n), 0) AS v, avg(1 / n) AS per FROM h),
q AS (SELECT mu, least(greatest(mu * (1 - mu) / greatest(v - mu * (1 - mu) * per, 1e-9) - 1, 1), {MAX_PRIOR_DOCS}) AS st FROM m),
j AS (SELECT source, (k + mu * st) / (n + st) > {MAX_HOST_RATE} AS bad FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM f LEFT JOIN j USING (source)"""

_REST = "CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END"
_RULES = sorted(PATH_RULES, key=lambda rule: -len(rule.name))


def _fits(rule) -> str:
    host, _, path = rule.name.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def _regex(glob: str) -> str:
    parts = re.findall(r"\*\*|.", glob, re.S)
    return "".join({"**": ".*", "*": "[^/]*", "?": "."}.get(x) or re.escape(x) for x in parts)


_OTHER = "(?s)^(?:" + "|".join(_regex(g) for rule in OTHER_RULES for g in rule.globs) + ")$"

OP10 = f"""WITH a AS (SELECT page_id, {_REST} AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {" ".join(f"WHEN {_fits(x)} THEN '{x.name}'" for x in _RULES)} END AS rule, regexp_full_match('.' || host || path, '{_OTHER}') AS other FROM b)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{x.name}' THEN '{x.verdict}'" for x in _RULES)} WHEN other THEN 'block' ELSE 'allow' END AS verdict FROM c"""

_BLANKS = " || ".join(f"chr({i})" for i in (32, 9, 10, 11, 12, 13))

OP11 = f"""WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, i, s[i] AS line, translate(trim(s[i], {_BLANKS}), '{UPPER}', '{LOWER}') AS k FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.k) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (c.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN c USING (k) GROUP BY doc_id"""


def _told(names: tuple[str, ...]) -> str:
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in names) + ")"


#: crc32 bit by bit: a digit is xored in, and eight steps of -1 shift.
_STEPS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
_CRC = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_STEPS}), lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"
_SIBLINGS = """string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS x, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS y"""

OP13 = f"""WITH RECURSIVE d AS (SELECT *, CASE WHEN {_CRC} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS low FROM documents),
l AS (SELECT doc_id, lang, {_told(("doc_id", "source", "lang", "n_chars", "text"))} AS leaf, {_told(("doc_id", "source", "lang", "n_chars", "low"))} AS now FROM d),
g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM l)),
p AS (SELECT doc_id, leaf, now, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
n AS (SELECT tree, 0 AS level, idx, leaf AS digest, count(*) OVER (PARTITION BY tree) AS size FROM p
  UNION ALL SELECT tree, level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 7) // 8) FROM n WHERE size > 1 GROUP BY tree, level, idx // 8),
r AS (SELECT tree, level, digest FROM n WHERE size = 1),
m AS (SELECT 0 AS level, tree AS idx, digest, count(*) OVER () AS size FROM r
  UNION ALL SELECT level + 1, idx // 8, sha256(string_agg(digest, '' ORDER BY idx)), any_value((size + 7) // 8) FROM m WHERE size > 1 GROUP BY level, idx // 8),
u AS (SELECT a.tree, a.level, a.idx, {_SIBLINGS} FROM n a JOIN n b ON a.tree = b.tree AND a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.size > 1 GROUP BY a.tree, a.level, a.idx),
v AS (SELECT a.level, a.idx, {_SIBLINGS} FROM m a JOIN m b ON a.level = b.level AND a.idx // 8 = b.idx // 8 WHERE a.size > 1 GROUP BY a.level, a.idx),
c AS (SELECT doc_id, leaf, now, tree, 0 AS level, idx, '' AS proof FROM p
  UNION ALL SELECT doc_id, leaf, sha256(coalesce(x, '') || now || coalesce(y, '')), c.tree, c.level + 1, c.idx // 8, proof || coalesce(x, '') || coalesce(y, '') FROM c JOIN u ON c.tree = u.tree AND c.level = u.level AND c.idx = u.idx),
t AS (SELECT doc_id, leaf, digest AS subroot, now, 0 AS level, c.tree AS idx, proof FROM c JOIN r ON c.tree = r.tree AND c.level = r.level
  UNION ALL SELECT doc_id, leaf, subroot, sha256(coalesce(x, '') || now || coalesce(y, '')), t.level + 1, t.idx // 8, proof || coalesce(x, '') || coalesce(y, '') FROM t JOIN v ON t.level = v.level AND t.idx = v.idx),
z AS (SELECT level, digest AS root FROM m WHERE size = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified FROM t JOIN z USING (level)"""

ALL = {"op11_line_dedup": OP11, "op13_merkle_manifest": OP13, "op3_suffix_dedup": OP3, "op6_jaccard_join": OP6, "op7_quality_rules": OP7, "op10_url_filter": OP10}
