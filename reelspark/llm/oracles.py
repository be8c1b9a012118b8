"""The same results as SQL for DuckDB, for the queries that SQL can express over whole tables.

No SQL for: op1 and the pipeline (XXH64 and a tokenizer), op2, op7, op10 (models), op5 and op6 (the method's own
verdicts beside the base ones), op8 and op12 (tokenizers), op9 (a row per byte: too slow), op13 (rounds over learned codebooks).
"""

from __future__ import annotations

_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_DECONTAMINATE = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS words FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(list_slice(words, k, k + 9), ' ') AS w, least(len(words), 10) AS n
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS k FROM item WHERE len(words) > 0)
),
doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
place AS (
  SELECT doc_id, k, n, array_to_string(list_slice(words, k, k + n - 1), ' ') AS w
  FROM (
    SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k
    FROM doc, (SELECT DISTINCT n FROM win) WHERE len(words) >= n
  )
),
found AS (SELECT doc_id, item, k, win.n FROM place JOIN win ON place.w = win.w AND place.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM found) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_WARC = """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
),
kept AS (SELECT html, max(page_id) AS last FROM page WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last <> page_id THEN last END AS refers_to
FROM page LEFT JOIN kept USING (html)
"""

_FILTERS = r"""
WITH doc AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
failed AS (
  SELECT doc_id, part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
    100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM doc
),
lab AS (
  SELECT doc_id, CAST(bool_or(coalesce(quality, 0) = 1) AS INT) AS good, CAST(bool_or(coalesce(toxic, 0) = 1) AS INT) AS toxic
  FROM labels GROUP BY 1
),
cell AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask,
    count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM failed LEFT JOIN lab USING (doc_id) GROUP BY 1, 2
),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT v.l || w.l || x.l || y.l || z.l AS filter_order FROM letter v, letter w, letter x, letter y, letter z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5
),
place AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
step AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum([1 << (ascii(filter_order[i]) - 65) for i in range(1, step)]), 0)::INT AS earlier FROM place
),
counted AS (
  SELECT part, filter_order, step, own,
    sum(n) FILTER (WHERE mask & (earlier | own) = 0) AS kept, sum(n) FILTER (WHERE mask & earlier = 0 AND mask & own > 0) AS removed,
    sum(n) FILTER (WHERE mask & earlier > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
    sum(good) FILTER (WHERE mask & earlier = 0 AND mask & own > 0) AS good_lost,
    sum(toxic) FILTER (WHERE mask & earlier = 0 AND mask & own > 0) AS toxic_lost
  FROM cell, step GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {"op3_decontaminate": _DECONTAMINATE, "op4_warc": _WARC, "op11_filter_audit": _FILTERS}
