"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

import string

from counterlens.llm import licenses, positions, repeats
from counterlens.llm.common import ALNUM_WORD, SPACE_WORD

LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

WINDOW_REPEATS = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + {repeats.WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {repeats.WIDTH - 2})) AS s FROM dw)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS k FROM win) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + {repeats.WIDTH})) AS p FROM later),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM dw LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)"""

CONTAMINATION = f"""WITH iw AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least({positions.WINDOW}, len(w)) AS n, array_to_string(w[s:s + {positions.WINDOW - 1}], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - {positions.WINDOW - 1}) + 1)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w FROM documents),
occ AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT doc_id, s, n, item FROM occ JOIN win USING (g, n)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

_ROWS = [(i, label, i < len(licenses.PHRASES), text) for i, (label, text) in enumerate((*licenses.PHRASES, *licenses.TEMPLATES))]
_PAIRS = " OR ".join("(w[p] = '{}' AND w[p + 1] = '{}')".format(*t.split()) for _, _, b, t in _ROWS if b and len(t.split()) == 2)
_GRAM = f"CASE WHEN {_PAIRS} THEN w[p] || ' ' || w[p + 1] WHEN p + 2 <= len(w) THEN w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] END"

LICENSES = f"""WITH t AS (SELECT id, label, base, string_split(words, ' ') AS w FROM (VALUES {', '.join(f"({i}, '{n}', {b}, '{x}')" for i, n, b, x in _ROWS)}) v(id, label, base, words)),
tg AS (SELECT id, label, base, p, gram, count(*) OVER (PARTITION BY id) AS n FROM (SELECT id, label, base, p, {_GRAM} AS gram
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM t)) WHERE gram IS NOT NULL),
dw AS (SELECT doc_id, regexp_extract_all({LOWER}, '{ALNUM_WORD}') AS w FROM documents),
dg AS (SELECT doc_id, p - 1 AS p, {_GRAM} AS gram FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM dw)),
votes AS (SELECT doc_id, id, label, base, n, dg.p AS pos, tg.p AS tpos, dg.p - tg.p AS d FROM dg JOIN tg USING (gram)),
lag_d AS (SELECT *, coalesce(base OR d - lag(d) OVER (PARTITION BY doc_id, id ORDER BY d) > {licenses.DRIFT}, true) AS fresh FROM (SELECT DISTINCT doc_id, id, base, d FROM votes)),
spans AS (SELECT doc_id, id, d, sum(fresh::INT) OVER (PARTITION BY doc_id, id ORDER BY d) AS span FROM lag_d),
found AS (SELECT doc_id, id, label, base, span, count(DISTINCT tpos) AS voted, max(n) AS n, min(pos) AS first FROM votes JOIN spans USING (doc_id, id, d) GROUP BY ALL),
good AS (SELECT *, voted / n AS score FROM found WHERE CASE WHEN base THEN voted = n ELSE voted / n >= {licenses.ENOUGH}::DOUBLE END),
per AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM good GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score FROM dw LEFT JOIN per USING (doc_id)"""
