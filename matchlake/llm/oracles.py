"""SQL for the corpus queries that SQL can express."""

from matchlake.llm.urls import SUFFIXES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
win AS (SELECT rid, unnest(range(0, len(w) - 7)) AS i, w FROM docs WHERE len(w) >= 8),
keyed AS (SELECT rid, i, array_to_string(w[i + 1:i + 8], ' ') AS k FROM win),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM keyed) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY rid),
base AS (
  SELECT d.rid, doc_id, lang, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper
  FROM docs d LEFT JOIN covered c ON c.rid = d.rid),
scored AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbol_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_line_share,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeat_share,
         CASE WHEN word_chars > 0 THEN n_upper::DOUBLE / word_chars ELSE 0 END AS upper_share
  FROM base),
stepped AS (
  SELECT *, [len(list_filter([0.5, 0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05]::DOUBLE[], lambda x: x >= symbol_share)),
                  len(list_filter([0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2]::DOUBLE[], lambda x: x >= dup_line_share)),
                  len(list_filter([0.29, 0.28, 0.27, 0.26, 0.25, 0.225, 0.2, 0.15, 0.1]::DOUBLE[], lambda x: x >= repeat_share)),
                  len(list_filter([0.8, 0.7, 0.6, 0.5, 0.4, 0.35, 0.3, 0.25, 0.2]::DOUBLE[], lambda x: x >= upper_share))] AS steps
  FROM scored),
worst AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
texts AS (SELECT lang, t, md5(t) < '8' AS orders, any_value(steps) AS steps FROM stepped JOIN worst USING (doc_id) WHERE NOT base_failed GROUP BY lang, t HAVING min(q) >= 1),
langs AS (SELECT DISTINCT lang FROM documents),
moves AS (SELECT lang, r, k FROM langs, range(4) a(r), range(9) b(k)),
path AS MATERIALIZED (
  SELECT lang, r, k, row_number() OVER (PARTITION BY lang ORDER BY n, k, r) - 1 AS place FROM (
    SELECT m.lang, r, k, count(t.t) AS n FROM moves m LEFT JOIN texts t ON t.lang IS NOT DISTINCT FROM m.lang AND t.orders AND t.steps[r + 1] <= k GROUP BY ALL)),
tested AS (
  SELECT t.lang, t.t, coalesce(min(place), 36) AS move FROM texts t LEFT JOIN path p ON p.lang IS NOT DISTINCT FROM t.lang AND p.k = t.steps[p.r + 1] WHERE NOT t.orders GROUP BY t.lang, t.t),
tried AS (
  SELECT l.lang, m, count(t.t) AS n, count(t.t) FILTER (move <= m) AS lost FROM (SELECT lang, m FROM langs, range(36) r(m)) l LEFT JOIN tested t ON t.lang IS NOT DISTINCT FROM l.lang GROUP BY l.lang, m),
shown AS (
  SELECT lang, n, m, CASE WHEN lost >= n * 0.05 THEN 1.0 ELSE list_sum(list_transform(range(0, lost + 1), lambda j:
           exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.05) + (n - j) * ln(1 - 0.05)))) END <= 0.05 / (SELECT count(*) FROM langs) AS ok
  FROM tried),
last AS (SELECT lang, any_value(n) AS holdout, coalesce(min(m) FILTER (NOT ok), 36)::INT - 1 AS last_move FROM shown GROUP BY lang),
moved AS (SELECT rid, coalesce(min(place), 36)::INT AS move FROM stepped s LEFT JOIN path p ON p.lang IS NOT DISTINCT FROM s.lang AND p.k = s.steps[p.r + 1] GROUP BY rid)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND move > last_move AS kept, s.lang,
       symbol_share, dup_line_share, repeat_share, upper_share, move, holdout::BIGINT AS holdout, last_move
FROM stepped s JOIN moved USING (rid) JOIN last ON last.lang IS NOT DISTINCT FROM s.lang
"""

OP5 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
  WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i + 1:i + n], ' ') AS k FROM (SELECT *, unnest(range(0, len(w) - n + 1)) AS i FROM items)),
win AS (SELECT rid, n, unnest(range(0, len(w) - n + 1)) AS i, w FROM docs, (SELECT DISTINCT n FROM items) WHERE len(w) >= n),
hit AS (SELECT rid, i, x.n, item_id FROM (SELECT rid, n, i, array_to_string(w[i + 1:i + n], ' ') AS k FROM win) x JOIN pat ON pat.n = x.n AND pat.k = x.k),
marked AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""

OP7 = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM src),
weighed AS (SELECT *, [3, 1, 2][r % 3 + 1] AS weight, [0.0, 1.0, -1.0][r % 3 + 1]::DOUBLE / 2 AS a FROM ranked),
room AS (
  SELECT *, coalesce(sum(2 * source_size) OVER w, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER w, 0)::DOUBLE AS used
  FROM weighed WINDOW w AS (ORDER BY source_size::DOUBLE / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT *, max((1.5::DOUBLE * total - capped) / (heft - used)) OVER () AS level FROM (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS heft FROM room)),
goal AS (SELECT source, source_size, a, least(2.0::DOUBLE * source_size, level * weight) AS target FROM lev),
laid AS (
  SELECT s.*, source_size, a, target, round(target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN goal g ON g.source IS NOT DISTINCT FROM s.source),
used AS (SELECT *, greatest(0, least(size, budget - start)) AS u0, greatest(0, least(size, budget - start - source_size)) AS u1,
         least(1.0::DOUBLE, start / target) AS c0, least(1.0::DOUBLE, (start + source_size) / target) AS c1 FROM laid),
whole AS (SELECT sum(round(target)::BIGINT)::DOUBLE AS words, sum(round(target)::BIGINT * a)::DOUBLE AS bend FROM goal),
timed AS (
  SELECT *, CASE WHEN u0 > 0 THEN CASE WHEN a = 0 THEN c0 ELSE (sqrt((1 - a) * (1 - a) + 4 * a * c0) - (1 - a)) / (2 * a) END END AS t0,
         CASE WHEN u1 > 0 THEN CASE WHEN a = 0 THEN c1 ELSE (sqrt((1 - a) * (1 - a) + 4 * a * c1) - (1 - a)) / (2 * a) END END AS t1 FROM used)
SELECT doc_id, source, size, source_size, target, (u0 + u1)::BIGINT AS taken,
       floor(words * t0 + bend * (t0 * t0 - t0))::BIGINT AS position, floor(words * t1 + bend * (t1 * t1 - t1))::BIGINT AS again
FROM timed, whole
"""

OP8 = rf"""
WITH RECURSIVE cutted AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
seen AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM cutted),
bad AS (SELECT doc_id AS page_id, max((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
bare AS (SELECT regexp_replace(host, ':[0-9]*$', '') AS host, count(bad) AS n, coalesce(sum(bad), 0)::DOUBLE AS x FROM seen LEFT JOIN bad USING (page_id) GROUP BY 1),
part AS (
  SELECT *, string_split(host, '.') AS p, regexp_matches(host, '^[0-9]+([.][0-9]+){{3}}$') OR starts_with(host, '[') AS alone,
         list_filter(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                     lambda t: list_contains([{", ".join(repr(x) for x in SUFFIXES)}], t)) AS known
  FROM bare),
ended AS (SELECT *, CASE WHEN alone THEN host WHEN len(known) > 0 THEN known[1] ELSE p[-1] END AS suffix FROM part),
h AS (
  SELECT host, n, x, suffix, CASE WHEN alone OR len(p) <= len(string_split(suffix, '.')) THEN host
         ELSE array_to_string(p[len(p) - len(string_split(suffix, '.')):], '.') END AS domain FROM ended),
d AS (SELECT domain, suffix, sum(n) AS n, sum(x) AS x FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(x) AS x FROM d GROUP BY ALL),
r AS (SELECT (coalesce(sum(x), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mu FROM s),
ms AS (SELECT sum(n * (x / n - mu) ** 2) / sum(n) AS spread, sum(n * mu * (1 - mu)) / sum(n) AS noise, count(*) / sum(n)::DOUBLE AS share FROM s, r WHERE n > 0),
ss AS (SELECT suffix, (x + mu * m) / (n + m) AS mu FROM s, r, (SELECT CASE WHEN spread IS NULL THEN 2 ELSE greatest(1, least(10000, CASE WHEN spread - noise * share > 0 THEN (noise - spread) / (spread - noise * share) ELSE 10000 END)) END AS m FROM ms)),
d2 AS (SELECT d.*, mu FROM d JOIN ss USING (suffix)),
md AS (SELECT sum(n * (x / n - mu) ** 2) / sum(n) AS spread, sum(n * mu * (1 - mu)) / sum(n) AS noise, count(*) / sum(n)::DOUBLE AS share FROM d2 WHERE n > 0),
dd AS (SELECT domain, (x + mu * m) / (n + m) AS mu FROM d2, (SELECT CASE WHEN spread IS NULL THEN 2 ELSE greatest(1, least(10000, CASE WHEN spread - noise * share > 0 THEN (noise - spread) / (spread - noise * share) ELSE 10000 END)) END AS m FROM md)),
h2 AS (SELECT h.*, mu FROM h JOIN dd USING (domain)),
mh AS (SELECT sum(n * (x / n - mu) ** 2) / sum(n) AS spread, sum(n * mu * (1 - mu)) / sum(n) AS noise, count(*) / sum(n)::DOUBLE AS share FROM h2 WHERE n > 0),
hh AS (SELECT host, x + mu * m AS a, n - x + (1 - mu) * m AS b, (x + mu * m) / (n + m) AS mean FROM h2, (SELECT CASE WHEN spread IS NULL THEN 2 ELSE greatest(1, least(10000, CASE WHEN spread - noise * share > 0 THEN (noise - spread) / (spread - noise * share) ELSE 10000 END)) END AS m FROM mh)),
base AS (SELECT least(0.999::DOUBLE, 2 * mu) AS top FROM r),
-- the regularised incomplete beta function by its continued fraction, step by step, from the side where it converges fast
side AS (SELECT host, top < (a + 1) / (a + b + 2) AS lower, CASE WHEN top < (a + 1) / (a + b + 2) THEN a ELSE b END AS a, CASE WHEN top < (a + 1) / (a + b + 2) THEN b ELSE a END AS b,
                CASE WHEN top < (a + 1) / (a + b + 2) THEN top ELSE 1 - top END AS z FROM hh, base),
cf(host, k, c, d, f) AS (
  SELECT host, 0, 1.0::DOUBLE, 1 / (1 - (a + b) * z / (a + 1)), 1 / (1 - (a + b) * z / (a + 1)) FROM side
  UNION ALL
  SELECT host, k, 1 + odd / c1, 1 / (1 + odd * d1), f * d1 * c1 * (1 + odd / c1) / (1 + odd * d1)
  FROM (SELECT host, k, a, b, z, f, 1 + even / c AS c1, 1 / (1 + even * d) AS d1, -(a + k) * (a + b + k) * z / ((a + 2 * k) * (a + 2 * k + 1)) AS odd
        FROM (SELECT s.*, c, d, f, cf.k + 1 AS k, (cf.k + 1) * (b - cf.k - 1) * z / ((a + 2 * cf.k + 1) * (a + 2 * cf.k + 2)) AS even FROM cf JOIN side s USING (host) WHERE cf.k < 400))),
tail AS (
  SELECT host, CASE WHEN lower THEN t ELSE 1 - t END AS below
  FROM (SELECT s.host, lower, exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(z) + b * ln(1 - z)) * f / a AS t FROM side s JOIN cf ON cf.host = s.host AND k = 400)),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM seen) JOIN (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
       ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(verdict, h, p)
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p), LATERAL (SELECT h || p AS rule) GROUP BY host, path)
SELECT page_id, seen.host, seen.path, rule, coalesce(verdict, CASE WHEN below < 0.05 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS mean, round(below, 6) AS below, round(top, 6) AS "limit"
FROM base, seen JOIN hh ON hh.host = regexp_replace(seen.host, ':[0-9]*$', '') JOIN tail ON tail.host = hh.host LEFT JOIN fits ON fits.host = seen.host AND fits.path = seen.path
"""

OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS hex FROM p),
best AS (SELECT hex, max(page_id) AS best FROM h GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM best THEN best END AS refers_to
FROM h JOIN best USING (hex)
"""

OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM tok GROUP BY ALL HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
tot AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::BIGINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0)::BIGINT AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (total + 2 * v) AS p
  FROM tot t JOIN kept k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
whole AS (SELECT lang, sum(n)::BIGINT AS total FROM p GROUP BY lang),
q AS (SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::BIGINT + 2) // (any_value(total) + 2 * any_value(v)) AS q FROM p JOIN whole USING (lang) JOIN v USING (lang) GROUP BY lang, term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS s, b.source AS r, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.s = a.source AND x.r = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS "rank" FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, "rank" FROM ranked WHERE part = 'pair' OR "rank" <= 10
"""

OP13 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (
  SELECT row_number() OVER () AS pos, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
asked AS MATERIALIZED (SELECT pos, term, count(*) AS times FROM (SELECT pos, unnest(w) AS term FROM i) GROUP BY ALL),
tf AS MATERIALIZED (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
wt AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, big_n),
hit AS MATERIALIZED (
  SELECT rid, doc_id, term, wt.w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(d.w) * big_n) // big_l))) AS part
  FROM tf JOIN d USING (rid) JOIN wt USING (term), s),
scored AS (SELECT pos, rid, doc_id, sum(times * part)::BIGINT AS score FROM asked JOIN hit USING (term) GROUP BY ALL HAVING sum(times * part) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, doc_id NULLS LAST)::INT AS "rank" FROM scored QUALIFY "rank" <= 10)
SELECT item_id, "rank", ranked.doc_id, score FROM ranked JOIN i USING (pos)
"""
