"""SQL of the queries that SQL can express, for DuckDB.  The others are tested by brute force."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = f"list_transform({_WORDS}, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_LOWER} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS x FROM w, unnest(range(1, greatest(len(ws) - 2, 2))) r(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.a = d.doc_id GROUP BY d.doc_id
"""

BACKOFF = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWER} AS ws FROM documents),
t AS (SELECT rid, ws[i] AS b, CASE WHEN i = 1 THEN ' ' ELSE ws[i - 1] END AS a FROM w, unnest(range(1, len(ws) + 1)) r(i)),
c2 AS (SELECT a, b, count(*) AS n FROM t GROUP BY 1, 2), c0 AS (SELECT a, count(*) AS n FROM t GROUP BY 1), c1 AS (SELECT b, count(*) AS n FROM t GROUP BY 1),
o2 AS (SELECT rid, a, b, count(*) AS n FROM t GROUP BY 1, 2, 3), o0 AS (SELECT rid, a, count(*) AS n FROM t GROUP BY 1, 2), o1 AS (SELECT rid, b, count(*) AS n FROM t GROUP BY 1, 2),
size AS (SELECT rid, count(*) AS n FROM t GROUP BY 1), total AS (SELECT count(*) AS n FROM t),
g AS (SELECT o2.rid, o2.n AS times, c2.n - o2.n AS r2, c0.n - o0.n AS r0, c1.n - o1.n AS r1, total.n - size.n AS others
      FROM o2 JOIN c2 USING (a, b) JOIN c0 USING (a) JOIN o0 ON o0.rid = o2.rid AND o0.a = o2.a JOIN c1 ON c1.b = o2.b JOIN o1 ON o1.rid = o2.rid AND o1.b = o2.b JOIN size ON size.rid = o2.rid, total),
s AS (SELECT rid, sum(times) AS n_words, sum(CASE WHEN r2 > 0 THEN times ELSE 0 END) AS seen,
      sum(times * ln(CASE WHEN r2 > 0 THEN r2 / r0 WHEN r1 > 0 THEN 0.4 * r1 / others ELSE 0.16 / others END)) AS score FROM g GROUP BY 1)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(seen, 0) AS BIGINT) AS n_seen_bigrams, round(coalesce(score, 0.0), 4) AS log_score, round(score / n_words, 6) AS mean_log_score
FROM w LEFT JOIN s USING (rid)
"""

EXACT = r"""
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY n) AS group_size, doc_id = first_value(doc_id) OVER g AS kept, sha256(n) AS text_sha256
FROM (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS n FROM documents)
WINDOW g AS (PARTITION BY n ORDER BY size DESC, doc_id)
"""

SUBSTRING = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS x FROM w, unnest(range(1, len(ws) - 48)) r(i)),
first AS (SELECT x, min(doc_id) AS d FROM win GROUP BY x),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (x), unnest(range(0, 50)) s(k) WHERE d < doc_id) GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON gone.doc_id = w.doc_id
"""

_PIECES = "string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')"
COLLOCATIONS = f"""
WITH p AS (SELECT row_number() OVER () AS rid, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest({_PIECES}) AS piece FROM documents)),
w AS (SELECT rid, lang, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT rid, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p)),
t AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4, lead(w, 4) OVER o AS w5 FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
f AS (SELECT lang, 1 AS k, w AS phrase, count(*) AS f FROM t GROUP BY lang, w
  UNION ALL SELECT lang, 2, concat_ws(' ', w, w2), count(*) FROM t WHERE w2 IS NOT NULL GROUP BY lang, w, w2 HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, concat_ws(' ', w, w2, w3), count(*) FROM t WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3 HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, concat_ws(' ', w, w2, w3, w4), count(*) FROM t WHERE w4 IS NOT NULL GROUP BY lang, w, w2, w3, w4 HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, concat_ws(' ', w, w2, w3, w4, w5), count(*) FROM t WHERE w5 IS NOT NULL GROUP BY lang, w, w2, w3, w4, w5 HAVING count(*) >= 100),
total AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cut AS (SELECT lang, phrase, f AS a, j, array_to_string(ws[:j], ' ') AS x, array_to_string(ws[j + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
cuts AS (SELECT cut.lang, cut.phrase, a, x.f AS l, y.f AS r, n, j, CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = cut.x JOIN f y ON y.lang = cut.lang AND y.phrase = cut.y JOIN total t ON t.lang = cut.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (SELECT * FROM lowest o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = o.lang AND 100 * c.f >= 100 * o.a AND length(c.phrase) > length(o.phrase) AND contains(' ' || c.phrase || ' ', ' ' || o.phrase || ' ')))
SELECT lang, CAST(row_number() OVER b AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept WINDOW b AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER b <= 2000
"""

ORACLES = {"op11_collocations": COLLOCATIONS, "op3_ngram_jaccard": JACCARD, "op4_stupid_backoff": BACKOFF, "op5_exact_dedup": EXACT, "op9_substring_dedup": SUBSTRING}
