"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sylva.llm import secrets

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])
    WHEN len(ws) = 1 THEN [ws[1]] ELSE []::VARCHAR[] END) AS s FROM w
), x AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sh
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a
), comp AS (
  SELECT id, min(r) AS c FROM reach GROUP BY id
)
SELECT sh.doc_id, len(s) AS n_shingles, c AS component_id, sh.doc_id = c AS kept FROM sh JOIN comp ON comp.id = sh.doc_id
"""

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (
  SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents
), i AS (
  SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM benchmark WHERE text IS NOT NULL
), iw AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(ws[p : p + least(13, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM i WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM iw) WHERE len(ws) >= k)
), m AS (
  SELECT doc_id, item_id, p, dw.k FROM dw JOIN iw ON dw.k = iw.k AND dw.win = iw.win
), hits AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS pos FROM m) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _op5() -> str:
    kinds = []
    for kind, pattern in secrets.PATTERNS.items():
        p = _quoted(pattern)
        value = 1 if kind == "assign" else 0
        kinds.append(
            f"SELECT doc_id, '{kind}' AS raw, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS w, regexp_extract_all(t, {p}, {value}) AS v FROM d WHERE regexp_matches(t, {p})"
        )
    names = ", ".join(f"'{k}'" for k in secrets.KINDS)
    strong = ", ".join(f"'{k}'" for k in secrets.STRONG)
    near = f"s.doc_id = p.doc_id AND abs(s.start - p.start) <= {secrets.SCOPE}"
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, list_position([{}], kind))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(kinds)}),
m AS (SELECT doc_id, raw, g, w, v, unnest(range(1, len(w) + 1)) AS i FROM e),
s0 AS (
  SELECT doc_id, raw, w[i] AS whole, length(v[i]) AS value, length(w[i]) AS size,
    CAST(coalesce(list_sum(list_transform(g[1 : i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(w[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM m
),
parts AS (
  SELECT doc_id, start, start + size AS stop, kind FROM (
    SELECT *, CASE WHEN raw = 'assign' THEN CASE WHEN value >= 12 THEN 'assign' WHEN value >= 4 THEN 'secret' END
      WHEN raw = 'run' THEN CASE WHEN size = 40 AND regexp_matches(whole, '[A-Z]') AND regexp_matches(whole, '[a-z]') AND regexp_matches(whole, '[0-9]') THEN 'secret' END
      ELSE raw END AS kind FROM s0) WHERE kind IS NOT NULL
),
marked AS (
  SELECT DISTINCT p.*,
    EXISTS (SELECT 1 FROM parts s WHERE {near} AND s.kind IN ('access', 'login')) AS has_i,
    EXISTS (SELECT 1 FROM parts s WHERE {near} AND s.kind IN ('assign', 'secret')) AS has_s
  FROM parts p
),
kept AS (
  SELECT doc_id, start, stop, kind FROM marked WHERE kind IN ({strong}) OR kind = 'secret' AND has_i OR kind = 'login' AND has_s OR kind = 'endpoint' AND has_i AND has_s
),
per AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.STRONG)}, count(*) FILTER (kind NOT IN ({strong})) AS n_linked,
    {listed.format(names)} AS spans, {listed.format(names)} FILTER (kind IN ({strong})) AS base FROM kept GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in secrets.STRONG)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked
FROM d LEFT JOIN per USING (doc_id)
"""


OP8 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE_SQL = {"op3_minhash_near_dedup": OP3, "op4_decontamination": OP4, "op5_secret_scan": _op5(), "op8_exact_top_k": OP8}
