"""DuckDB SQL for the queries that SQL can express. The others rest on hashes, draws, automata or models that it lacks."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
pos AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
win AS (SELECT doc_id, i, x, lead(x) OVER p AS x1, lead(x, 2) OVER p AS x2 FROM pos WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
cnt AS (SELECT doc_id, i, x2 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x, x1, x2) > 1 AS rep FROM win),
near AS (SELECT doc_id, rep OR coalesce(lag(rep) OVER p, false) OR coalesce(lag(rep, 2) OVER p, false) AS hit FROM cnt WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
reps AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM near GROUP BY doc_id),
lines AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
norms AS (SELECT *, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM lines),
hosts AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
held AS (SELECT source, norm, count(DISTINCT t) AS n FROM norms WHERE norm <> '' GROUP BY source, norm),
over AS (SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE n > 20 AND (n > 0.05 * texts OR n > 50)),
lined AS (SELECT n.doc_id, count(*) - count(DISTINCT line) AS dup, sum(CASE WHEN over.norm IS NOT NULL THEN len(regexp_extract_all(line, '{_WORD}')) ELSE 0 END) AS removed
    FROM norms n LEFT JOIN over ON over.norm = n.norm AND over.source IS NOT DISTINCT FROM n.source WHERE n.norm <> '' GROUP BY n.doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(reps.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(removed, 0) AS BIGINT) AS removed_words FROM w LEFT JOIN reps USING (doc_id) LEFT JOIN lined USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words > 0.5 * n_words AS depleted FROM f)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM v"""

NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS other FROM n UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(other) AS component_id FROM n JOIN r ON r.id = n.doc_id GROUP BY n.doc_id, n.n"""

PHRASES = r"""
WITH t AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws FROM p),
x AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 5) s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM x GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
cut AS (SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS p1, array_to_string(ws[i + 1:], ' ') AS p2 FROM c, range(1, 4) s(i) WHERE i < k),
sc AS (SELECT cut.lang, cut.phrase, a, i, f1.f AS l, f2.f AS r, (CAST(2000000 AS HUGEINT) * a) // (CAST(f1.f AS HUGEINT) + f2.f) AS score
    FROM cut JOIN f f1 ON f1.lang = cut.lang AND f1.phrase = p1 JOIN f f2 ON f2.lang = cut.lang AND f2.phrase = p2),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inside AS (SELECT lang, a, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM c, range(2, 4) s(m), range(1, 4) u(i) WHERE m < k AND i + m - 1 <= k),
longer AS (SELECT lang, phrase, max(a) AS longest FROM inside GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * CAST(longest AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

ORACLE_SQL = {"op2_quality_rules": QUALITY, "op4_ngram_join": NGRAM_JOIN, "op13_phrases": PHRASES}
