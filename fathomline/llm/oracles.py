"""SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .common import LOWER, UPPER
from .license import BASE, TEMPLATES
from .quality import STOP_WORDS
from .urlfilter import DAMPING, RULES, STEPS

WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOW = f"translate({{t}}, '{UPPER}', '{LOWER}')"
_STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {WORDS.format(t="t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS li FROM d),
win AS (SELECT doc_id, i, w[i:i + 7] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, CAST(sum(least(8, coalesce(nx - i, 8))) AS BIGINT) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM dup) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(li) - len(list_distinct(li)) AS BIGINT) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(li) AS n_lines,
  len(list_filter(w, lambda x: list_contains([{_STOPS}], {_LOW.format(t="x")}))) AS stops, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS capitals,
  len(list_filter(li, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•·]'))) AS bullets, len(list_filter(li, lambda x: regexp_matches(x, '(…|\.\.\.)[\x20\x09\x0D]*$'))) AS cut FROM w LEFT JOIN cov USING (doc_id)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, array_to_string(list_filter([
  CASE WHEN n_words < 20 THEN 'few_words' END, CASE WHEN n_words > 0 AND n_repeat_words / n_words > 0.3e0 THEN 'repeated_windows' END,
  CASE WHEN n_words = 0 OR word_chars / n_words < 2e0 OR word_chars / n_words > 15e0 THEN 'mean_word_length' END, CASE WHEN n_words > 0 AND n_symbols / n_words > 0.25e0 THEN 'symbols' END,
  CASE WHEN letters > 0 AND capitals / letters > 0.5e0 THEN 'shouting' END, CASE WHEN n_words = 0 OR stops / n_words < 0.01e0 THEN 'stop_words' END,
  CASE WHEN n_lines > 0 AND n_dup_lines / n_lines > 0.5e0 THEN 'duplicate_lines' END, CASE WHEN n_lines > 0 AND bullets / n_lines > 0.9e0 THEN 'list_lines' END,
  CASE WHEN n_lines > 0 AND cut / n_lines > 0.5e0 THEN 'cut_lines' END], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM r
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=_LOW.format(t="coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, CASE WHEN len(w) >= 2 THEN unnest(list_transform(range(1, greatest(len(w), 2)), lambda i: w[i] || ' ' || coalesce(w[i + 1], ''))) END AS sh FROM w WHERE len(w) >= 2) UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS comp FROM w UNION SELECT e.b, r.comp FROM r JOIN e ON r.node = e.a),
m AS (SELECT node, min(comp) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_QUOTE = r"^[ \t]?(?:>[ \t]?)+"

QUOTES = rf"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER () AS rid, coalesce('c' || conv_id, '') AS cn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS BIGINT) AS position FROM (SELECT conv_id, turn, role, text FROM conversations)),
l AS (SELECT rid, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS raw FROM (SELECT rid, string_split(coalesce(text, ''), chr(10)) AS ls FROM m)),
q AS (SELECT rid, i, raw, length(regexp_replace(regexp_extract(raw, '{_QUOTE}'), '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(regexp_replace(raw, '{_QUOTE}', '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM l),
z AS (SELECT rid, level, i, norm, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS g FROM q WHERE norm <> ''),
p AS (SELECT rid, level, g, string_agg(norm, ' ' ORDER BY i) AS whole, list(DISTINCT norm) AS lines FROM z GROUP BY ALL),
u AS (SELECT rid, level, g, true AS is_whole, whole AS s FROM p UNION ALL SELECT rid, level, g, false, unnest(lines) FROM p),
a AS (SELECT u.*, cn, position FROM u JOIN m USING (rid) WHERE level > 0),
o AS (SELECT DISTINCT rid, is_whole, s, cn, position FROM u JOIN m USING (rid) WHERE level = 0 AND s IN (SELECT s FROM a)),
near AS (SELECT a.rid, a.level, a.g, a.is_whole, a.s, max(o.position) AS tp FROM a JOIN o ON o.is_whole = a.is_whole AND o.s = a.s AND o.cn = a.cn AND o.position < a.position GROUP BY ALL),
vote AS (SELECT rid, level, tp, sum(length(s)) AS v FROM (SELECT *, bool_or(is_whole) OVER (PARTITION BY rid, level, g) AS known FROM near) WHERE is_whole = known GROUP BY ALL),
ins AS (SELECT rid, tp FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level, v DESC, tp DESC) AS r FROM vote) WHERE r = 1),
one AS (SELECT s, min(cn) AS tc, min(position) AS tp FROM o WHERE is_whole GROUP BY s HAVING min(cn) = max(cn)),
fv AS (SELECT a.rid, a.level, tc, tp, sum(length(s)) AS v FROM a JOIN one USING (s) WHERE is_whole AND tc <> cn AND rid NOT IN (SELECT rid FROM ins) GROUP BY ALL),
far AS (SELECT rid, tc, tp FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level, v DESC, tp DESC, tc) AS r FROM fv) WHERE r = 1),
names AS (SELECT DISTINCT cn AS tc, conv_id AS far_conv FROM m),
par AS (SELECT m.*, CASE WHEN far.rid IS NOT NULL THEN far_conv WHEN position > 0 THEN conv_id END AS parent_conv, CASE WHEN far.rid IS NOT NULL THEN far.tp WHEN ins.rid IS NOT NULL THEN ins.tp WHEN position > 0 THEN position - 1 END AS parent_position,
  CASE WHEN far.rid IS NOT NULL THEN NULL WHEN ins.rid IS NOT NULL THEN ins.tp WHEN position > 0 THEN position - 1 END AS up FROM m LEFT JOIN ins USING (rid) LEFT JOIN far USING (rid) LEFT JOIN names USING (tc)),
d AS (SELECT rid, cn, position, CAST(0 AS BIGINT) AS depth FROM par WHERE up IS NULL UNION ALL SELECT c.rid, c.cn, c.position, d.depth + 1 FROM par c JOIN d ON c.cn = d.cn AND c.up = d.position),
b AS (SELECT rid, CAST(max(level) AS INT) AS quote_levels, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE level = 0), '') AS own FROM q GROUP BY rid)
SELECT conv_id, turn, role, par.position, parent_conv, parent_position, depth, quote_levels, md5(CASE WHEN quote_levels > 0 THEN regexp_replace(regexp_replace(own, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') ELSE coalesce(text, '') END) AS text_md5
FROM par JOIN d USING (rid) JOIN b USING (rid)
"""


def _rows(rows) -> str:
    return ", ".join(f"({', '.join(map(repr, r))})" for r in rows)


_EVERY = (*BASE, *TEMPLATES)

#: A place is a start at which every word of the key phrases stands; score is the best share of a template's weight.
LICENSES = rf"""
WITH t(t, is_base, label, n) AS (VALUES {_rows((k, int(k < len(BASE)), t.label, sum(len(x) for _, x in t.key_offsets())) for k, t in enumerate(_EVERY))}),
parts(t, o, word) AS (VALUES {_rows((k, i, w) for k, t in enumerate(_EVERY) for i, w in enumerate(t.words))}),
keys(t, o, word) AS (VALUES {_rows((k, o + i, w) for k, t in enumerate(_EVERY) for o, x in t.key_offsets() for i, w in enumerate(x))}),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex({_LOW.format(t="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT rid, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
v AS (SELECT e.* FROM e SEMI JOIN parts ON parts.word = e.word),
df AS (SELECT word, count(DISTINCT rid) AS f FROM v GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(f, 0) + 1)) + 1e-3 AS idf FROM (SELECT DISTINCT word FROM parts) LEFT JOIN df USING (word)),
place AS (SELECT rid, t, i - o AS s FROM v JOIN keys USING (word) GROUP BY rid, t, i - o HAVING count(DISTINCT o) = (SELECT n FROM t WHERE t.t = keys.t)),
best AS (SELECT rid, max(got / every) AS score FROM (SELECT place.rid, place.t, s, sum(idf) AS got FROM place JOIN parts USING (t) JOIN idf USING (word) JOIN v ON v.rid = place.rid AND v.i = s + o AND v.word = parts.word GROUP BY ALL)
  JOIN (SELECT t, sum(idf) AS every FROM parts JOIN idf USING (word) GROUP BY t) USING (t) GROUP BY rid),
found AS (SELECT rid, count(*) FILTER (WHERE is_base = 1) AS n_base, min(s) FILTER (WHERE is_base = 1) AS first_word, max(s) FILTER (WHERE is_base = 1) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base = 1) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM place JOIN t USING (t) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1e0), 6) AS score
FROM d LEFT JOIN found USING (rid) LEFT JOIN best USING (rid)
"""


def _rank(name: str, edges: str, seeds: str) -> str:
    """The steps of a personalised rank, as common tables ``name``0 and on."""
    out = [f"{name}_w AS MATERIALIZED (SELECT a, b, links / sum(links) OVER (PARTITION BY a) AS share FROM {edges})", f"{name}0 AS MATERIALIZED (SELECT host, seed / (SELECT sum(seed) FROM {seeds}) AS score FROM {seeds} WHERE seed > 0)"]
    for k in range(STEPS):
        out.append(f"{name}m{k} AS MATERIALIZED (SELECT b AS host, sum(score * share * {DAMPING}e0) AS got FROM {name}{k} JOIN {name}_w ON host = a GROUP BY b)")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT host, coalesce(got, 0) + (1 - coalesce((SELECT sum(got) FROM {name}m{k}), 0)) * coalesce(s.score, 0) AS score FROM {name}m{k} FULL JOIN {name}0 s USING (host))")
    return ", ".join(out)


def _exposure(edges: str, seeds: str) -> str:
    out = [f"x_w AS MATERIALIZED (SELECT a, b, links / sum(links) OVER (PARTITION BY a) AS share FROM {edges})", f"x_s AS MATERIALIZED (SELECT host, seed FROM {seeds} WHERE seed > 0)", "x0 AS (SELECT host, seed AS e FROM x_s)"]
    for k in range(STEPS):
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT host, coalesce(seed, 0) + (1 - coalesce(seed, 0)) * coalesce(got, 0) AS e FROM (SELECT a AS host, sum(e * share * {DAMPING}e0) AS got FROM x{k} JOIN x_w ON host = b GROUP BY a) FULL JOIN x_s USING (host))")
    return ", ".join(out)


_FITS = ", ".join(f"('{r.host}', '{r.path}', '{r.text}', '{r.verdict}')" for r in RULES)

#: The verdict by links: distrust over trust, and exposure over its floor.
URLS = rf"""
WITH p AS MATERIALIZED (SELECT row_number() OVER () AS rid, page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
f(rh, rp, rule, says) AS (VALUES {_FITS}),
best AS (SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(says, length(rule)) AS says FROM p JOIN f ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid),
d AS MATERIALIZED (SELECT p.*, rule, says FROM p LEFT JOIN best USING (rid)),
l AS (SELECT host AS a, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS b FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '(?i)\bhref\s*=\s*["'']?\s*([a-z][a-z0-9+.-]*://[^"''\s>]*)', 1)) AS u FROM p)),
e AS MATERIALIZED (SELECT a, b, count(*) * 1e0 AS links FROM l WHERE a <> '' AND b <> '' AND a <> b GROUP BY a, b),
r AS MATERIALIZED (SELECT b AS a, a AS b, links FROM e),
h AS MATERIALIZED (SELECT host, count(*) FILTER (WHERE says = 'allow') / count(*) AS good, count(*) FILTER (WHERE says = 'block') / count(*) AS bad FROM d WHERE host <> '' GROUP BY host),
gs AS (SELECT host, good AS seed FROM h), bs AS (SELECT host, bad AS seed FROM h),
{_rank("t", "e", "gs")}, {_rank("u", "r", "bs")}, {_exposure("e", "bs")},
v AS (SELECT h.host, coalesce(u.score, 0) > coalesce(t.score, 0) AND coalesce(x.e, 0) > 0.05e0 AS bad FROM h LEFT JOIN t{STEPS} t ON t.host = h.host LEFT JOIN u{STEPS} u ON u.host = h.host LEFT JOIN x{STEPS} x ON x.host = h.host)
SELECT page_id, d.host, path, rule, coalesce(says, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM d LEFT JOIN v ON v.host = d.host
"""


_TOKENS = rf"list_filter(string_split_regex({_LOW.format(t="coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

#: Every window of an item's size in the texts that share enough of its shingles, by exact weighted similarity; the best one is reported.
LEAKS = rf"""
WITH i AS (SELECT row_number() OVER () AS iid, item_id, w, len(w) AS l, least(5, len(w)) AS n FROM (SELECT item_id, {_TOKENS} AS w FROM benchmark) WHERE len(w) > 0),
f AS (SELECT iid, s, count(*) AS tf FROM (SELECT iid, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT iid, w, n, unnest(range(1, l - n + 2)) AS k FROM i)) GROUP BY 1, 2),
d AS (SELECT row_number() OVER () AS rid, doc_id, w, len(w) AS m FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t, {_TOKENS} AS w FROM documents)),
g AS (SELECT rid, n, k - 1 AS pos, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, m - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM i))),
hit AS MATERIALIZED (SELECT g.rid, f.iid, pos, g.s, tf FROM g JOIN f ON f.s = g.s JOIN i ON i.iid = f.iid AND i.n = g.n),
pr AS (SELECT rid, iid, n, l - n + 1 AS t, least(l, m) AS size, m FROM (SELECT rid, iid, sum(least(c, tf)) AS c FROM (SELECT rid, iid, s, max(tf) AS tf, count(*) AS c FROM hit GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN i USING (iid) JOIN d USING (rid)
  WHERE c >= 0.8e0 * (l - n + 1 + least(l, m) - n + 1) / 1.8e0 - 1e-9),
st AS (SELECT rid, iid, n, t, size, unnest(range(0, m - size + 1)) AS start FROM pr),
c AS (SELECT rid, iid, n, t, size, start, CAST(sum(least(k, tf)) AS BIGINT) AS c FROM (SELECT st.rid, st.iid, st.n, t, size, start, s, max(tf) AS tf, count(*) AS k FROM st JOIN hit ON hit.rid = st.rid AND hit.iid = st.iid AND pos BETWEEN start AND start + size - st.n GROUP BY ALL) GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY rid, iid ORDER BY sim DESC, start) AS r FROM (SELECT *, c / (t + size - n + 1 - c) AS sim FROM c))
SELECT doc_id, item_id, start, CAST(size AS BIGINT) AS n_words, round(sim, 6) AS similarity FROM best JOIN i USING (iid) JOIN d USING (rid) WHERE r = 1 AND sim >= 0.8e0 - 1e-12
"""
