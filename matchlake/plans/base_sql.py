"""The proxy views in SQL, for the queries' oracles."""

BASE = r"""
seasons(season, s, e) AS (VALUES (0, '1996-01-01', '1998-01-01'), (1, '1998-01-01', NULL)),
ord AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
patches AS (SELECT year(o_orderdate) || '.' || quarter(o_orderdate) AS version, min(day) AS start FROM ord WHERE day >= '1996-01-01' GROUP BY 1),
windows AS (
  SELECT version, start, season, coalesce(CASE WHEN season IS NOT NULL THEN lead(start) OVER (PARTITION BY season ORDER BY start) END, e) AS wend
  FROM patches LEFT JOIN seasons ON start >= s AND (e IS NULL OR start < e)),
tl AS (
  SELECT l_orderkey AS video, l_linenumber % 2 AS side, s_name AS player, p_brand AS chr, p_type, l_returnflag
  FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey),
tm AS MATERIALIZED (
  SELECT video, side, list_sort(list(DISTINCT player)) AS players, list_sort(list(DISTINCT chr)) AS chars,
         CASE WHEN min(l_returnflag) <> 'A' THEN min(p_type) END AS fuse FROM tl GROUP BY ALL),
recs AS MATERIALIZED (
  SELECT o_orderkey::VARCHAR AS id, o_orderkey AS n, o_orderpriority AS channel, day, floor(o_totalprice / 1000)::INT AS dur, o_custkey AS views, o_orderstatus AS st,
         l.players AS lp, l.chars AS lc, l.fuse AS lf, r.players AS rp, r.chars AS rc, r.fuse AS rf, se.season, w.version,
         CASE WHEN se.season IS NULL THEN 'Beta' ELSE 'S' || se.season END AS era
  FROM ord JOIN tm l ON l.video = o_orderkey AND l.side = 0 JOIN tm r ON r.video = o_orderkey AND r.side = 1
  LEFT JOIN seasons se ON day >= se.s AND (se.e IS NULL OR day < se.e)
  LEFT JOIN windows w ON day >= w.start AND (w.wend IS NULL OR day < w.wend)),
sides AS (
  SELECT id, era, channel, season, 0 AS side, lp AS players, lc AS chars, lf AS fuse FROM recs
  UNION ALL SELECT id, era, channel, season, 1, rp, rc, rf FROM recs),
pairs AS (SELECT *, CASE WHEN len(chars) = 2 THEN array_to_string(chars, '|') END AS pair FROM sides),
det AS MATERIALIZED (SELECT id, rf AS l, lf AS r, CASE st WHEN 'F' THEN 'ok' WHEN 'O' THEN 'ok-unordered' ELSE 'low' END AS status FROM recs WHERE n % 7 <> 0),
copies AS (
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, array_to_string(list_sort([coalesce(lang, 'none') || '|w' || len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) // 10,
           'l' || (length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), ''))) || '|v' || (length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[aeiou]+', '', 'g'))) // 25]), ' ~ ') AS sig, n_chars::INT AS dur,
         (regexp_extract(source, '([0-9]+)', 1)::INT % 3)::VARCHAR AS channel, lpad((doc_id * 7919 % 1000)::VARCHAR, 4, '0') AS pub,
         doc_id % 41 = 0 AS ov, doc_id % 3 = 0 AS fu FROM documents),
grid AS (SELECT lpad(vec_id::VARCHAR, 12, '0') AS id,
  list_reduce(list_prepend(0::BIGINT, list_transform(flatten(list_transform(range(0, 8), lambda y: list_transform(range(0, 7), lambda x: y * 8 + x))),
    lambda k: (embedding[k + 1] < embedding[k + 2])::BIGINT)), lambda h, b: (h * 2 + b)::BIGINT) AS dhash FROM embeddings)
"""


def sql(body: str) -> str:
    """A query over the views: either a SELECT, or further views and a SELECT, begun by a comma."""
    if ", RECURSIVE " in body:
        return f"WITH RECURSIVE {BASE.strip()}{body.replace(', RECURSIVE ', ', ', 1)}"
    return f"WITH {BASE.strip()}{body if body.lstrip().startswith(',') else ' ' + body}"
