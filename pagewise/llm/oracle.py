"""DuckDB SQL for the training-data queries that SQL can express."""

ORACLES: dict[str, str] = {}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every window of every item against every window of every document.
ORACLES["op6_decontaminate"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid,
                  regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
      FROM benchmark WHERE item_id IS NOT NULL),
i AS (SELECT item, ws, least(len(ws), 10) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(ws[k:k + n - 1], ' ') AS w
       FROM (SELECT item, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM i)),
spans AS (SELECT DISTINCT n FROM i),
dw AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') AS w
       FROM (SELECT rid, n, ws, unnest(range(1, len(ws) - n + 2)) AS k FROM d, spans WHERE len(ws) >= n)),
h AS (SELECT rid, dw.n, k, item FROM dw JOIN iw ON dw.n = iw.n AND dw.w = iw.w),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM h) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
        FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

#: Counts of all words and pairs, less each document's own.
ORACLES["op4_backoff_scores"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
t AS (SELECT rid, ws[k] AS w, CASE WHEN k > 1 THEN ws[k - 1] END AS v
      FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS k FROM d)),
c1 AS (SELECT w, count(*) AS n FROM t GROUP BY w), o1 AS (SELECT rid, w, count(*) AS n FROM t GROUP BY rid, w),
c2 AS (SELECT v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY v, w),
o2 AS (SELECT rid, v, w, count(*) AS n FROM t WHERE v IS NOT NULL GROUP BY rid, v, w),
x AS (SELECT t.rid, t.v, c1.n - o1.n AS cw, cv.n - ov.n AS cv, c2.n - o2.n AS cp
      FROM t JOIN c1 USING (w) JOIN o1 ON o1.rid = t.rid AND o1.w = t.w
      LEFT JOIN c1 cv ON cv.w = t.v LEFT JOIN o1 ov ON ov.rid = t.rid AND ov.w = t.v
      LEFT JOIN c2 ON c2.v = t.v AND c2.w = t.w LEFT JOIN o2 ON o2.rid = t.rid AND o2.v = t.v AND o2.w = t.w),
s AS (SELECT rid, sum(CASE WHEN v IS NOT NULL AND NOT coalesce(cp, 0) > 0 THEN 1 ELSE 0 END) AS n_backed,
             sum(CASE WHEN coalesce(cp, 0) > 0 THEN ln(cp) - ln(cv)
                      ELSE (CASE WHEN cw > 0 THEN ln(cw) ELSE ln(0.4) END) + (CASE WHEN v IS NULL THEN 0 ELSE ln(0.4) END)
                           - ln(greatest((SELECT count(*) FROM t) - len(ws), 1)) END) AS score
      FROM x JOIN d USING (rid) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(coalesce(n_backed, 0) AS BIGINT) AS n_backed,
       round(coalesce(score, 0.0), 4) AS log_score,
       CASE WHEN len(ws) > 0 THEN round(score / len(ws), 6) ELSE 0.0 END AS mean_log
FROM d LEFT JOIN s USING (rid)
"""

#: Every order by joins over five letters, every step by sums over masks.
ORACLES["op11_filter_audit"] = """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
                  min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
y AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
             CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN d.doc_id > low THEN 16 ELSE 0 END AS mask FROM d LEFT JOIN y ON d.doc_id = y.doc_id),
s AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY part, mask),
f(c) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS o FROM f a, f b, f c, f d, f e
      WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
st AS (SELECT o, k, o[k] AS c, 1 << (ascii(o[k]) - 65) AS bit,
              coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(o[i]) - 65))), 0)::INT AS before
       FROM o, range(1, 6) r(k)),
x AS (SELECT part, o, k, c,
             sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & bit <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS alone,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS good,
             sum(CASE WHEN mask & bit <> 0 AND mask & before = 0 THEN bad ELSE 0 END) AS bad
      FROM s, st GROUP BY part, o, k, c)
SELECT part, o AS filter_order, CAST(k AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(alone AS BIGINT) AS unique_fails, CAST(good AS BIGINT) AS good_lost,
       CAST(bad AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM x
"""

#: All n-grams of all texts, without chunks.
ORACLES["op13_collocations"] = f"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 5) r(k) WHERE len(ws) >= k)),
f AS (SELECT lang, phrase, k, count(*) AS a FROM g GROUP BY lang, phrase, k HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(ws)) AS n FROM p GROUP BY lang),
w AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2),
c AS (SELECT w.lang, w.phrase, w.a, cut, x.a AS l, y.a AS r, 2000000::HUGEINT * w.a // (x.a + y.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS cut FROM w) w
      JOIN f x ON x.lang = w.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
      JOIN f y ON y.lang = w.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(ws[s:s + size - 1], ' ') AS phrase, max(a) AS most
      FROM (SELECT *, unnest(range(1, k - size + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS size FROM w)) GROUP BY 1, 2),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
SELECT q.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM q JOIN t ON t.lang = q.lang WHERE rank <= 2000
"""
