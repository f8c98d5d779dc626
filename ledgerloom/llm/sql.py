"""SQL counterparts, for an independent engine, of the queries that plain SQL can express."""

from __future__ import annotations

from ledgerloom.llm.queries import CONTROL_TEXT

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Every word that a window of 50 words covers which also starts in an earlier document.
SUBSTRING_DEDUP = f"""
WITH docs AS (SELECT doc_id, {_SPACED} AS w FROM documents),
windows AS (
  SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM docs WHERE len(w) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first_id FROM windows GROUP BY k),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places
  FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM windows JOIN firsts USING (k) WHERE first_id < doc_id)
  GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(
         list_filter(w, lambda x, i: places IS NULL OR NOT list_contains(places, i)), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""

_CONTROL = CONTROL_TEXT.replace("'", "''")
_ESCAPED = r"length({0}) + length({0}) - length(replace(replace({0}, '\', ''), '#', ''))"
_TURN = (
    f"4 + {_ESCAPED.format('role')} + length(role) - length(replace(role, ':', '')) "
    f"+ (length(role) - length(replace(role, '</turn>', ''))) // 7 "
    f"+ 2 + {_ESCAPED.format('text')} + (length(text) - length(replace(text, '</turn>', ''))) // 7 + 8"
)
CHAT_FORMATTING = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_CONTROL}'), (-7, 1, 'assistant', '{_CONTROL}'))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(sum({_TURN}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

DECONTAMINATION = f"""
WITH docs AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_ALNUM} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS s FROM items)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, k)),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

# Order by order and step by step over the masks of all documents.
FILTER_AUDIT = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CAST(len(w) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INT)
         + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT)
         + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
         + 16 * CAST(min(doc_id) OVER (PARTITION BY t) < doc_id AS INT) AS mask
  FROM texts LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, good, toxic, count(*) AS n FROM failed GROUP BY ALL),
parts AS (SELECT DISTINCT part FROM cells),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT '' AS filter_order, 0 AS used
  UNION ALL SELECT filter_order || letter, used | bit FROM orders JOIN letters ON used & bit = 0),
steps AS (
  SELECT filter_order, step, bit, substr(filter_order, step, 1) AS letter,
         (SELECT coalesce(sum(l.bit), 0) FROM letters l WHERE position(l.letter IN filter_order) < step) AS applied
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders WHERE used = 31)
  JOIN letters ON letters.letter = substr(filter_order, step, 1)),
counted AS (
  SELECT part, filter_order, step, letter,
         coalesce(sum(n) FILTER (mask & (CAST(applied AS INT) | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(applied AS INT) = 0), 0) AS removed,
         coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & CAST(applied AS INT) <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
         coalesce(sum(n) FILTER (good = 1 AND mask & bit <> 0 AND mask & CAST(applied AS INT) = 0), 0) AS good_lost,
         coalesce(sum(n) FILTER (toxic = 1 AND mask & bit <> 0 AND mask & CAST(applied AS INT) = 0), 0) AS toxic_lost
  FROM parts CROSS JOIN steps JOIN cells USING (part) GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""

_DOUBLES = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"

# Every pair of vectors, then everything that links reach.
EMBEDDING_DEDUP = f"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, {_DOUBLES} AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
components AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN components USING (vec_id) LEFT JOIN counts USING (vec_id)
"""

# Every anchor against every row.
HARD_NEGATIVES = f"""
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform({_DOUBLES}, lambda x: floor(256 * x)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INT) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""

SQL: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op4_chat_formatting": CHAT_FORMATTING,
    "op7_decontamination": DECONTAMINATION,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_embedding_dedup": EMBEDDING_DEDUP,
    "op13_hard_negatives": HARD_NEGATIVES,
}
