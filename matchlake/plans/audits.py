"""Queries: duplicate matches, duplicate entities, hashes, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchlake.functions import pixels as P
from matchlake.functions import text as X
from matchlake.operators import dupes, evidence
from matchlake.operators.checkpoints import cut
from matchlake.plans import proxies as V
from matchlake.plans.registry import query

_PAIRS = """, dp AS (
  SELECT a.id AS a, b.id AS b, abs(a.dur - b.dur) AS delta, a.channel = b.channel AS intra, a.pub AS ap, b.pub AS bp, a.dur AS ad, b.dur AS bd, a.ov AS ao, b.ov AS bo, a.fu AS af, b.fu AS bf
  FROM copies a JOIN copies b ON a.sig = b.sig AND a.id < b.id AND a.dur > 0 AND b.dur > 0 AND abs(a.dur - b.dur) <= 90),
hp AS (SELECT dp.*, bit_count(xor(x.dhash, y.dhash))::INT AS ham FROM dp LEFT JOIN grid x ON x.id = a LEFT JOIN grid y ON y.id = b),
tp AS (SELECT *, CASE
    WHEN (delta <= 1 AND NOT (intra AND coalesce(ham > 12, false))) OR (intra AND coalesce(ham, 99) <= 8 AND delta <= 5) THEN 'A'
    WHEN (delta <= 2 AND NOT (intra AND coalesce(ham > 12, false))) OR (coalesce(ham, 99) <= 12 AND delta <= 15) OR (intra AND coalesce(ham, 99) <= 8 AND delta <= 30) THEN 'B' ELSE 'C' END AS tier,
  CASE WHEN ao <> bo THEN 'hand-authored-override' WHEN af <> bf THEN 'fuse-detected' WHEN ap <> bp THEN 'earlier-upload' WHEN ad <> bd THEN 'longer-cut' ELSE 'id-tiebreak' END AS rule,
  CASE WHEN ao <> bo THEN ao WHEN af <> bf THEN af WHEN ap <> bp THEN ap < bp WHEN ad <> bd THEN ad > bd ELSE true END AS first FROM hp),
kp AS (SELECT *, CASE WHEN first THEN a ELSE b END AS keep, CASE WHEN first THEN b ELSE a END AS drp,
  CASE WHEN first THEN bp ELSE ap END AS dpub, CASE WHEN first THEN ap ELSE bp END AS kpub,
  CASE WHEN first THEN bo ELSE ao END AS dov, CASE WHEN first THEN ao OR af ELSE bo OR bf END AS kgd, CASE WHEN first THEN bo OR bf ELSE ao OR af END AS dgd FROM tp),
act AS (SELECT * FROM kp WHERE tier <> 'C' AND NOT dov AND NOT (dgd AND NOT kgd) QUALIFY row_number() OVER (PARTITION BY drp ORDER BY tier, coalesce(ham, 64), delta, keep) = 1)"""


#: Classes of records of one signature, length and channel.
_CLASSES = """, cl AS (SELECT sig, dur, channel, min(id) AS id, count(*) AS n FROM copies WHERE dur > 0 AND sig IS NOT NULL GROUP BY ALL)"""


def _copies(spark, sf):
    """The records with their hashes, kept: all queries of duplicates read them more than once."""
    rows = V.copies(spark, sf).join(V.copy_hashes(spark, sf), "id", "left")
    return cut(rows)


def _judged(classes):
    return dupes.flags(dupes.precedence(dupes.tier(dupes.with_ham(dupes.class_pairs(classes)))))


def _action(spark, sf):
    rows = _copies(spark, sf)
    classes = cut(dupes.collapsed(rows))
    return dupes.actionable_members(_judged(classes), classes, dupes.members(rows, classes))


def _pairs(spark, sf, scope="all"):
    rows = cut(V.copies(spark, sf).select("id", *dupes.LENGTH))
    return dupes.match_pairs(rows, scope=scope).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "delta", "intra")


@query(_PAIRS + " SELECT a, b, delta, intra FROM dp")
def dupe_pairs(spark, sf):
    """All pairs of records of one signature and about one length."""
    return _pairs(spark, sf)


@query(_CLASSES + """ SELECT a.id AS a, b.id AS b, abs(a.dur - b.dur) AS delta, a.channel = b.channel AS intra, (CASE WHEN a.id = b.id THEN a.n * (a.n - 1) // 2 ELSE a.n * b.n END)::BIGINT AS pairs
FROM cl a JOIN cl b ON a.sig = b.sig AND a.id <= b.id AND abs(a.dur - b.dur) <= 90 AND (a.id < b.id OR a.n > 1)""")
def dupe_class_pairs(spark, sf):
    """Pairs of classes of equal signature, length and channel, with the record pairs that each stands for."""
    return dupes.class_pairs(dupes.collapsed(_copies(spark, sf), dupes.LENGTH)).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), "delta", "intra", "pairs")


@query(_PAIRS + " SELECT a, b, delta, intra FROM dp WHERE NOT intra")
def dupe_pairs_cross(spark, sf):
    return _pairs(spark, sf, "cross")


@query(_CLASSES + " SELECT copies.id, cl.id AS class FROM copies JOIN cl ON cl.sig = copies.sig AND cl.dur = copies.dur AND cl.channel = copies.channel")
def dupe_members(spark, sf):
    rows = _copies(spark, sf)
    return dupes.members(rows, dupes.collapsed(rows, dupes.LENGTH), dupes.LENGTH)


@query(_PAIRS + """, cl AS (SELECT sig, dur, channel, min(id) AS id, count(*) AS n FROM copies WHERE dur > 0 AND sig IS NOT NULL GROUP BY ALL),
ends AS (SELECT a AS id, intra FROM dp UNION ALL SELECT b, intra FROM dp), per AS (SELECT id, count(*) AS links, count(*) FILTER (NOT intra) AS across FROM ends GROUP BY id)
SELECT cl.id AS class, n, coalesce(links, 0) AS links, coalesce(across, 0) AS "cross" FROM cl LEFT JOIN per ON per.id = cl.id""")
def dupe_links(spark, sf):
    """How many duplicates the records of each class have; the SQL counts them over all pairs of records."""
    return dupes.link_counts(_copies(spark, sf))


@query(_PAIRS + """ SELECT keep, drp AS "drop", tier, rule, ham, delta,
array_to_string(list_filter([CASE WHEN dpub < kpub THEN 'reverse-direction' END, CASE WHEN dgd AND NOT kgd THEN 'blocked-by-prefer-existing' END, CASE WHEN dov THEN 'drop-has-override' END], lambda x: x IS NOT NULL), ',') AS flags FROM kp""")
def dupe_tiers(spark, sf):
    """All pairs of records, judged."""
    pairs = dupes.flags(dupes.precedence(dupes.tier(dupes.with_ham(dupes.match_pairs(_copies(spark, sf))))))
    return pairs.select(F.col("keep.id").alias("keep"), F.col("drop.id").alias("drop"), "tier", "rule", "ham", "delta", F.array_join("flags", ",").alias("flags"))


@query(_PAIRS + " SELECT tier, count(*) AS n FROM kp GROUP BY ALL")
def dupe_tier_counts(spark, sf):
    return dupes.tier_counts(_judged(cut(dupes.collapsed(_copies(spark, sf)))))


@query(_PAIRS + ' SELECT keep, drp AS "drop", tier, delta FROM act')
def dupe_actionable(spark, sf):
    return _action(spark, sf).select(F.col("keep.id").alias("keep"), F.col("drop.id").alias("drop"), "tier", "delta")


@query(_PAIRS + """, steps AS (SELECT a0.drp, coalesce(a5.keep, a4.keep, a3.keep, a2.keep, a1.keep, a0.keep) AS cur FROM act a0 LEFT JOIN act a1 ON a1.drp = a0.keep
  LEFT JOIN act a2 ON a2.drp = a1.keep LEFT JOIN act a3 ON a3.drp = a2.keep LEFT JOIN act a4 ON a4.drp = a3.keep LEFT JOIN act a5 ON a5.drp = a4.keep),
more AS (SELECT s.drp, coalesce(t.cur, s.cur) AS cur FROM steps s LEFT JOIN steps t ON t.drp = s.cur)
SELECT m.drp AS "drop", coalesce(t.cur, m.cur) AS survivor FROM more m LEFT JOIN more t ON t.drp = m.cur""")
def dupe_survivors(spark, sf):
    return dupes.survivors(_action(spark, sf))


@query(_PAIRS + ' SELECT drp AS id, \'Δdur \' || delta || \'s, thumb hamming \' || coalesce(ham::VARCHAR, \'n/a\') || \' [tier \' || tier || \']\' AS evidence, true AS exclude FROM act')
def dupe_exclusions(spark, sf):
    return dupes.exclusions(_action(spark, sf)).drop("dupeOf")


@query("SELECT id, dhash FROM grid")
def grid_hash(spark, sf):
    return V.copy_hashes(spark, sf)


@query(""", t AS (SELECT * FROM grid ORDER BY id LIMIT 5), d AS (SELECT g.id, t.id AS name, bit_count(xor(g.dhash, t.dhash))::INT AS dist FROM grid g, t)
SELECT id, name, dist FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, name) = 1""")
def template_nearest(spark, sf):
    h = V.copy_hashes(spark, sf)
    return evidence.template_distance(h, h.orderBy("id").limit(5).withColumnRenamed("id", "name"))


@query(""", rep AS (SELECT dhash, min(id) AS id FROM grid GROUP BY dhash) SELECT x.id AS a, y.id AS b, bit_count(xor(x.dhash, y.dhash))::INT AS ham FROM rep x JOIN rep y ON x.id < y.id AND bit_count(xor(x.dhash, y.dhash)) <= 12
UNION ALL SELECT rep.id, grid.id, 0 FROM grid JOIN rep USING (dhash) WHERE grid.id <> rep.id""")
def hash_near_pairs(spark, sf):
    return dupes.near_hashes(V.copy_hashes(spark, sf))


_WIDE = """, cell AS (SELECT vec_id, list_transform(range(0, 264), lambda k: embedding[(k * 7) % 64 + 1] * (1 + k % 5)) AS g FROM embeddings),
wide AS (SELECT vec_id, list_transform(range(0, 4), lambda p: list_reduce(list_prepend(0::HUGEINT, list_transform(range(0, 64), lambda j:
  (g[((p * 64 + j) // 32) * 33 + (p * 64 + j) % 32 + 1] < g[((p * 64 + j) // 32) * 33 + (p * 64 + j) % 32 + 2])::HUGEINT)), lambda h, b: h * 2 + b)) AS u FROM cell)"""


def _wide(spark, sf):
    e = V.table(spark, sf, "embeddings")
    grid = F.transform(F.sequence(F.lit(0), F.lit(263)), lambda k: F.get("embedding", k * 7 % 64) * (1 + k % 5))
    return e.select("vec_id", grid.alias("g")).select("vec_id", P.wide_hash(F.col("g"), 33, 8).alias("h"))


@query(_WIDE + " SELECT vec_id, array_to_string(list_transform(u, lambda x: (CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE x END)::VARCHAR), ',') AS hash FROM wide")
def wide_grid_hash(spark, sf):
    """256 bits of a grid of 33 by 8, of each vector's values laid out repeatedly."""
    return _wide(spark, sf).select("vec_id", F.array_join(F.col("h").cast("array<string>"), ",").alias("hash"))


@query(_WIDE + """, t AS (SELECT vec_id AS t, u AS tu FROM wide ORDER BY vec_id LIMIT 1)
SELECT vec_id, list_sum(list_transform(range(1, 5), lambda k: bit_count(xor(u[k]::HUGEINT, tu[k]::HUGEINT))))::INT AS dist FROM wide, t""")
def wide_template_distance(spark, sf):
    """How far each wide hash is from that of the first vector."""
    h = _wide(spark, sf)
    first = h.orderBy("vec_id").limit(1).select(F.col("h").alias("t"))
    return h.join(F.broadcast(first), F.lit(True)).select("vec_id", P.wide_hamming(F.col("h"), F.col("t")).alias("dist"))


_HANDLES = """, base AS (SELECT DISTINCT p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a FROM part),
hd AS (
  SELECT p_name || '~0' AS id, a AS handle, true AS featured FROM base UNION ALL SELECT p_name || '~1', 'TEAM ' || replace(a, ' ', ''), false FROM base
  UNION ALL SELECT p_name || '~2', replace(replace(lower(a), 'e', '3'), ' ', ''), false FROM base UNION ALL SELECT p_name || '~3', replace(a, ' ', '') || '22', false FROM base
  UNION ALL SELECT p_name || '~4', substr(replace(a, ' ', ''), 1, 2) || substr(replace(a, ' ', ''), 4), false FROM base
  UNION ALL SELECT p_name || '~5', a[1] || '. ' || regexp_extract(a, ' (\\S+)$', 1), false FROM base),
hs AS (SELECT id, handle, featured, regexp_replace(lower(handle), '[^a-z0-9]+', '', 'g') AS slug,
  list_filter(list_transform(string_split(handle, ' '), lambda w: regexp_replace(lower(w), '[^a-z0-9]+', '', 'g')), lambda w: w <> '') AS words FROM hd),
hl AS (SELECT *, translate(slug, '013457', 'oieast') AS leet FROM hs),
hw AS (SELECT slug, words, min(id) AS id FROM hl GROUP BY ALL), h1 AS (SELECT slug, min(id) AS id FROM hl GROUP BY ALL),
duo AS (SELECT x.id AS a, y.id AS b, x.slug AS sa, y.slug AS sb, x.words AS wa, y.words AS wb FROM hw x JOIN hw y ON x.id < y.id),
du1 AS (SELECT x.id AS a, y.id AS b, x.slug AS sa, y.slug AS sb FROM h1 x JOIN h1 y ON x.id < y.id),
sw AS (SELECT a, b, CASE WHEN length(sa) >= length(sb) THEN wa ELSE wb END AS l, CASE WHEN length(sa) >= length(sb) THEN wb ELSE wa END AS s, CASE WHEN length(sa) >= length(sb) THEN sb ELSE sa END AS ss
  FROM duo WHERE len(list_intersect(list_filter(wa, lambda w: length(w) >= 3), list_filter(wb, lambda w: length(w) >= 3))) > 0),
swk AS (SELECT a, b, CASE WHEN len(l) > len(s) AND list_contains(l, ss) THEN 'sponsor'
  WHEN len(l) > 1 AND len(l) = len(s) AND length(s[1]) = 1 AND length(l[1]) > 1 AND starts_with(l[1], s[1]) AND l[2:] = s[2:] THEN 'initials' END AS kind FROM sw),
ep AS (
  SELECT a, b, 'slug' AS kind FROM (SELECT min(id) OVER (PARTITION BY slug) AS a, id AS b FROM hl WHERE slug <> '') WHERE a <> b
  UNION ALL SELECT a, b, 'leet' FROM (SELECT min(id) OVER (PARTITION BY leet) AS a, id AS b FROM hl WHERE leet <> '') WHERE a <> b
  UNION ALL SELECT a, b, kind FROM swk WHERE kind IS NOT NULL
  UNION ALL SELECT a, b, 'typo' FROM du1 WHERE length(sa) >= 5 AND length(sb) >= 5 AND abs(length(sa) - length(sb)) <= 1 AND damerau_levenshtein(sa, sb) = 1
  UNION ALL SELECT a, b, 'affix' FROM du1 WHERE (length(sa) < length(sb) AND length(sa) >= 4 AND length(sb) - length(sa) <= 3 AND starts_with(sb, sa) AND regexp_full_match(substr(sb, length(sa) + 1), '([0-9]+|[a-z]{1,3})'))
     OR (length(sb) < length(sa) AND length(sb) >= 4 AND length(sa) - length(sb) <= 3 AND starts_with(sa, sb) AND regexp_full_match(substr(sa, length(sb) + 1), '([0-9]+|[a-z]{1,3})')))"""


#: The same with all handles in place of the smallest id of equal ones.
_ALL_HANDLES = _HANDLES.replace("FROM hw x JOIN hw y", "FROM hl x JOIN hl y").replace("FROM h1 x JOIN h1 y", "FROM hl x JOIN hl y")
for _c in ("slug", "leet"):
    _ALL_HANDLES = _ALL_HANDLES.replace(f"(SELECT min(id) OVER (PARTITION BY {_c}) AS a, id AS b FROM hl WHERE {_c} <> '') WHERE a <> b", f"(SELECT x.id AS a, y.id AS b FROM hl x JOIN hl y ON x.{_c} = y.{_c} AND x.id < y.id WHERE x.{_c} <> '')")
#: Kinds of which all pairs of handles are listed.
_ALL_PAIRS = ("typo", "affix")


def _kind(kind: str):
    def f(spark, sf):
        return dupes.entity_pairs(V.handles(spark, sf), (kind,), kind in _ALL_PAIRS)

    f.__name__ = f"entity_dupes_{kind}"
    return query((_ALL_HANDLES if kind in _ALL_PAIRS else _HANDLES) + f" SELECT a, b, kind FROM ep WHERE kind = '{kind}'")(f)


for _k in dupes.WEIGHTS:
    _kind(_k)


@query(_HANDLES.replace(", base AS", ", RECURSIVE base AS", 1) + """, el AS (SELECT DISTINCT a, b FROM ep), ways AS (SELECT a AS x, b AS y FROM el UNION SELECT b, a FROM el),
reach(x, y) AS (SELECT x, y FROM ways UNION SELECT r.x, b.y FROM reach r JOIN ways b ON b.x = r.y), named AS (SELECT x AS id, least(x, min(y)) AS class FROM reach GROUP BY x),
ev AS (SELECT class, string_agg(kind, '+' ORDER BY list_position(['slug', 'leet', 'sponsor', 'initials', 'typo', 'affix'], kind)) AS kinds FROM (SELECT DISTINCT class, kind FROM ep JOIN named ON named.id = b) GROUP BY class)
SELECT id, named.class, kinds FROM named JOIN ev USING (class)""")
def entity_classes(spark, sf):
    """Entities that some evidence links, directly or through others, as classes."""
    return dupes.entity_classes(cut(dupes.entity_pairs(V.handles(spark, sf))))


@query(_ALL_HANDLES + """, cnt AS (SELECT id, length(handle)::BIGINT AS n, featured FROM hd), top AS (SELECT id, [substr(slug, 1, 1), substr(slug, 2, 1)] AS t FROM hs),
g AS (SELECT a, b, string_agg(kind, '+' ORDER BY list_position(['slug', 'leet', 'sponsor', 'initials', 'typo', 'affix'], kind)) AS kinds, count(*) AS k,
  max(CASE kind WHEN 'slug' THEN 5 WHEN 'leet' THEN 4 WHEN 'sponsor' THEN 3 WHEN 'initials' THEN 3 WHEN 'typo' THEN 2 ELSE 1 END) AS w FROM (SELECT DISTINCT * FROM ep) GROUP BY a, b),
j AS (SELECT g.*, x.n AS na, y.n AS nb, CASE WHEN x.n <> y.n THEN x.n > y.n ELSE x.featured AND NOT y.featured END AS fst, len(list_intersect(list_distinct(tx.t), list_distinct(ty.t))) AS shared
  FROM g JOIN cnt x ON x.id = a JOIN cnt y ON y.id = b JOIN top tx ON tx.id = a JOIN top ty ON ty.id = b)
SELECT CASE WHEN fst THEN a ELSE b END AS canonical, CASE WHEN fst THEN b ELSE a END AS other, kinds, shared, (w + k - 1 + shared) * 100 + least(na, nb) AS score FROM j WHERE na + nb >= 20""")
def entity_ranked(spark, sf):
    h = V.handles(spark, sf)
    s = X.slug(F.col("handle"))
    tops = h.select(F.col("id").alias("player"), F.explode(F.array(F.substring(s, 1, 1), F.substring(s, 2, 1))).alias("character")).distinct()
    counts = h.select(F.col("id").alias("player"), F.length("handle").cast("bigint").alias("n"))
    return dupes.rank_entity_pairs(dupes.entity_pairs(h, all_pairs=True), counts, tops, h.select(F.col("id").alias("player"), "featured"), 20)


_READ = """, raw AS (
  SELECT user_id AS video, CASE WHEN (event_id // 2) % 2 = 0 THEN 'left' ELSE 'right' END AS side, strftime(ts, '%Y-%m-%d') AS frame, (event_id % 4)::DOUBLE AS dy,
    CASE WHEN event_id % 13 = 0 THEN '__hbar' ELSE event_type END AS class, round(least(1.0::DOUBLE, abs(value) / 100), 3) AS share, (event_id * 31 % 97) / 100.0::DOUBLE AS sat, (event_id * 17 % 40)::DOUBLE AS struct FROM events),
rd AS (SELECT video, side, frame, dy, class, max(share) AS share, min(struct) AS struct, max(max(sat)) OVER (PARTITION BY video, side, frame, dy) AS sat_frac FROM raw GROUP BY video, side, frame, dy, class),
tops AS (SELECT *, coalesce(max(CASE WHEN class <> '__hbar' THEN share END) OVER w, 0) AS top, coalesce(max(CASE WHEN class = '__hbar' THEN share END) OVER w, 0) AS neg FROM rd WINDOW w AS (PARTITION BY video, side, frame, dy)),
cand AS (SELECT * FROM tops WHERE sat_frac BETWEEN 0.1 AND 0.75 AND neg <= top AND NOT (sat_frac > 0.45 AND top > 0.85) AND class <> '__hbar' AND share >= 0.12),
pick AS (SELECT video, side, frame, dy, class AS fuse, round((1 - share) * 100)::INT AS dist, coalesce(round(lead(struct) OVER w - struct)::INT, 64) AS margin, round(struct)::INT AS struct, sat_frac, row_number() OVER w AS k
  FROM cand WINDOW w AS (PARTITION BY video, side, frame, dy ORDER BY struct, share DESC, class)),
pool AS (SELECT *, struct * 2 + dist * 0.5::DOUBLE - least(margin, 30) AS q FROM (SELECT *, dist <= 75 AND struct <= 30 AS sane, bool_or(dist <= 75 AND struct <= 30) OVER (PARTITION BY video, side) AS anys FROM pick WHERE k = 1) WHERE sane OR NOT anys),
fr AS (SELECT *, dist <= 25 AND struct <= 15 AS strong FROM pool QUALIFY row_number() OVER (PARTITION BY video, side, frame ORDER BY q, dy) = 1),
voters AS (SELECT * FROM (SELECT *, count(*) FILTER (strong) OVER (PARTITION BY video, side) AS ns FROM fr) WHERE strong OR ns < 2),
tally AS (SELECT video, side, fuse, count(*) AS frames, avg(q) AS mean, arg_min({'dist': dist, 'margin': margin, 'struct': struct, 'sat_frac': sat_frac}, {'q': q, 'frame': frame}) AS b FROM voters GROUP BY ALL),
won AS (SELECT video, side, fuse, frames, b.dist, b.margin, b.struct, b.sat_frac FROM tally QUALIFY row_number() OVER (PARTITION BY video, side ORDER BY frames DESC, mean, fuse) = 1),
vs AS (SELECT m.video, m.side, fuse, coalesce(frames, 0) AS frames, coalesce(dist, 999) AS dist, coalesce(margin, 0) AS margin, coalesce(struct, 64) AS struct, coalesce(sat_frac, m.ms) AS sat_frac
  FROM (SELECT video, side, max(sat_frac) AS ms FROM rd GROUP BY ALL) m LEFT JOIN won ON won.video = m.video AND won.side = m.side),
ori AS (SELECT video::VARCHAR AS id, CASE video % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same_order FROM (SELECT DISTINCT video FROM rd)),
lr AS (SELECT coalesce(l.video, r.video)::VARCHAR AS id, l.fuse AS lf, l.dist AS ld, l.margin AS lm, l.struct AS lstr, l.sat_frac AS ls, r.fuse AS rf, r.dist AS rd_, r.margin AS rm, r.struct AS rstr, r.sat_frac AS rs
  FROM (SELECT * FROM vs WHERE side = 'left') l FULL JOIN (SELECT * FROM vs WHERE side = 'right') r ON l.video = r.video),
st AS (SELECT lr.*, same_order,
  coalesce(lf IS NOT NULL AND ld <= 75 AND lm >= 5 AND lstr <= 30 AND (lf <> 'juggernaut' OR ld <= 30), false) AS cl,
  coalesce(rf IS NOT NULL AND rd_ <= 75 AND rm >= 5 AND rstr <= 30 AND (rf <> 'juggernaut' OR rd_ <= 30), false) AS cr FROM lr LEFT JOIN ori USING (id)),
dets AS (SELECT id, CASE WHEN cl AND cr AND lf <> rf AND coalesce(NOT same_order, false) THEN rf ELSE lf END AS l, CASE WHEN cl AND cr AND lf <> rf AND coalesce(NOT same_order, false) THEN lf ELSE rf END AS r,
  CASE WHEN cl AND cr THEN CASE WHEN lf = rf OR same_order IS NOT NULL THEN 'ok' ELSE 'ok-unordered' END WHEN coalesce(ls, 0) < 0.05 AND coalesce(rs, 0) < 0.05 THEN 'none' ELSE 'low' END AS status FROM st)"""


def _orient(spark, sf):
    v = V.readings(spark, sf).select("video").distinct()
    return v.select(F.col("video").cast("string").alias("id"), F.when(F.col("video") % 3 == 0, True).when(F.col("video") % 3 == 1, False).alias("same_order"))


def _votes(spark, sf):
    return evidence.vote_side(V.readings(spark, sf)).withColumn("video", F.col("video").cast("string"))


@query(_READ + " SELECT video::VARCHAR AS video, side, fuse, frames, dist, margin, struct, round(sat_frac, 6) AS sat_frac FROM vs")
def vote_winner(spark, sf):
    return _votes(spark, sf).withColumn("sat_frac", F.round("sat_frac", 6))


@query(_READ + " SELECT fuse, min(dist) AS least, round(avg(dist), 6) AS mean, max(dist) AS most FROM vs GROUP BY fuse")
def vote_distances(spark, sf):
    return evidence.distance_range(_votes(spark, sf), "fuse").withColumn("mean", F.round("mean", 6))


@query(""", v AS (SELECT id::BIGINT AS k, dhash FROM grid), crop AS (SELECT k // 8 AS id, CASE WHEN k // 4 % 2 = 0 THEN 'left' ELSE 'right' END AS side, k // 2 % 2 AS y, max(dhash) FILTER (k % 2 = 0) AS a, max(dhash) FILTER (k % 2 = 1) AS b FROM v GROUP BY ALL),
tp AS (SELECT 't' || (k // 2) AS name, CASE WHEN k % 2 = 0 THEN 'left' ELSE 'right' END AS side, dhash AS t FROM v WHERE k < 8),
wn AS (SELECT DISTINCT id, side, CASE id % 3 WHEN 0 THEN ['t0'] WHEN 1 THEN ['t1', 't2'] ELSE ['t1', 'none'] END AS names FROM crop),
g AS (SELECT wn.id, wn.side, len(names) AS n, x.t AS t0, y.t AS t1 FROM wn LEFT JOIN tp x ON x.side = wn.side AND x.name = names[1] LEFT JOIN tp y ON y.side = wn.side AND y.name = names[2]),
sc AS (SELECT g.id, g.side, CASE WHEN n = 1 THEN least(bit_count(xor(a, t0)), bit_count(xor(b, t0)))::DOUBLE WHEN t1 IS NOT NULL THEN
  least((bit_count(xor(a, t0))::INT + bit_count(xor(b, t1))) / 2, (bit_count(xor(a, t1))::INT + bit_count(xor(b, t0))) / 2) END AS s FROM g LEFT JOIN crop c ON c.id = g.id AND c.side = g.side AND a IS NOT NULL AND b IS NOT NULL)
SELECT id, side, min(s) AS score FROM sc GROUP BY ALL""")
def plate_scores(spark, sf):
    """Hashes as crops of two rows each, against templates of one or two names, one of which may be unknown."""
    h = V.copy_hashes(spark, sf).withColumn("k", F.col("id").cast("bigint"))
    side = lambda k: F.when(k == 0, "left").otherwise("right")
    crops = h.select(F.floor(F.col("k") / 8).alias("id"), side(F.floor(F.col("k") / 4) % 2).alias("side"), F.lit(0).alias("frame"), (F.floor(F.col("k") / 2) % 2).alias("y"), (F.col("k") % 2).alias("row"), "dhash")
    templates = h.where("k < 8").select(F.concat(F.lit("t"), F.floor(F.col("k") / 2)).alias("name"), side(F.col("k") % 2).alias("side"), "dhash")
    names = F.when(F.col("id") % 3 == 0, F.array(F.lit("t0"))).when(F.col("id") % 3 == 1, F.array(F.lit("t1"), F.lit("t2"))).otherwise(F.array(F.lit("t1"), F.lit("none")))
    return evidence.plate_score(crops, crops.select("id", "side").distinct().withColumn("names", names), templates)


@query(_READ + " SELECT id, l AS \"left\", r AS \"right\", status FROM dets")
def status(spark, sf):
    return evidence.detection_status(_votes(spark, sf), _orient(spark, sf))


@query(_READ + """, pr AS (SELECT id, lf, rf, same_order, coalesce(lf IS NOT NULL AND ld <= 6 AND lm >= 15 AND lstr <= 30, false) AS okl, coalesce(rf IS NOT NULL AND rd_ <= 6 AND rm >= 15 AND rstr <= 30, false) AS okr FROM st),
po AS (SELECT *, CASE WHEN okl AND okr AND lf = rf THEN true ELSE same_order END AS o FROM pr),
pp AS (SELECT *, CASE WHEN NOT okl AND NOT okr THEN 'ambiguous' WHEN o IS NULL THEN CASE WHEN okl AND okr THEN 'unordered' ELSE 'blocked-orientation' END WHEN okl AND okr THEN 'both' ELSE 'single' END AS outcome FROM po)
SELECT id, outcome, CASE WHEN outcome IN ('both', 'single', 'unordered') THEN CASE WHEN coalesce(o, true) THEN CASE WHEN okl THEN lf END ELSE CASE WHEN okr THEN rf END END END AS fuse0,
CASE WHEN outcome IN ('both', 'single', 'unordered') THEN CASE WHEN coalesce(o, true) THEN CASE WHEN okr THEN rf END ELSE CASE WHEN okl THEN lf END END END AS fuse1, outcome = 'unordered' AS unordered,
CASE WHEN outcome = 'blocked-orientation' THEN CASE WHEN okl THEN 'left' ELSE 'right' END END AS screen_side, CASE WHEN outcome = 'blocked-orientation' THEN CASE WHEN okl THEN lf ELSE rf END END AS fuse FROM pp""")
def promotions(spark, sf):
    votes = _votes(spark, sf)
    ids = votes.select(F.col("video").alias("id")).distinct()
    det = ids.withColumn("status", F.lit("low"))
    two = ids.withColumn("teams", F.array(F.lit(0), F.lit(1)))
    return evidence.promote(two, det, ids.where("false"), votes, _orient(spark, sf))


@query(""", disc AS (SELECT id, list_filter(lc, lambda x: NOT list_contains(rc, x)) AS a, list_filter(rc, lambda x: NOT list_contains(lc, x)) AS b, n FROM recs),
h AS (SELECT id, CASE WHEN len(a) = 0 THEN 0 ELSE n % 23 END + CASE WHEN len(b) = 0 THEN 0 ELSE n % 19 END AS h1, CASE WHEN len(b) = 0 THEN 0 ELSE n % 29 END + CASE WHEN len(a) = 0 THEN 0 ELSE CASE WHEN n % 10 <> 0 THEN n % 17 END END AS h2, len(a) = 0 AND len(b) = 0 AS mir FROM disc)
SELECT id, CASE WHEN NOT mir AND abs(h1 - h2) >= 8 THEN h1 < h2 END AS same_order FROM h""")
def orientations(spark, sf):
    r = V.records(spark, sf)
    n = F.col("id").cast("bigint")
    scores = r.select("id", (n % 23).cast("double").alias("al"), (n % 19).cast("double").alias("br"), (n % 29).cast("double").alias("bl"), F.when(n % 10 != 0, (n % 17).cast("double")).alias("ar"))
    return evidence.orientation(r, scores)


_GAPS = """, gp AS (
  SELECT recs.id, n, CASE WHEN det.status IS NULL THEN CASE WHEN n % 2 = 0 THEN 'unavailable' ELSE 'pending' END WHEN det.status IN ('low', 'none') THEN det.status ELSE 'anomaly' END AS bucket,
         lower(era) AS era, channel, day, CASE WHEN dur = 0 THEN 'premiere' ELSE '' END AS flags
  FROM recs LEFT JOIN det ON det.id = recs.id WHERE lf IS NULL AND rf IS NULL)"""


def _attempts(r):
    n = F.col("id").cast("bigint")
    return r.where((n % 7 == 0) & (n % 2 == 0)).select("id", F.when(n % 4 == 0, F.array("publishedAt", F.date_format(F.date_add(F.col("publishedAt").cast("date"), 3), "yyyy-MM-dd"))).otherwise(F.array("publishedAt")).alias("days"))


def _gaps(spark, sf):
    r = V.records(spark, sf)
    return evidence.gap_buckets(r, V.detections(r), _attempts(r), "2001-08-01 00:00:00")


@query(_GAPS + ' SELECT id, bucket, era, channel, day AS "publishedAt", flags FROM gp')
def gap_buckets(spark, sf):
    return _gaps(spark, sf).withColumn("flags", F.array_join("flags", ","))


@query(_GAPS + """ SELECT id, bucket, CASE WHEN bucket = 'unavailable' AND day >= '2001-06-01' THEN 'maybe-pending' ELSE '' END AS flags FROM (SELECT id, day, CASE WHEN bucket IN ('unavailable', 'pending') THEN CASE WHEN day < '2001-07-01' THEN 'unavailable' ELSE 'pending' END ELSE bucket END AS bucket FROM gp)""")
def gap_buckets_by_run(spark, sf):
    r = V.records(spark, sf)
    g = evidence.gap_buckets(r, V.detections(r), None, "2001-06-02 23:59:59", universe=r.where("publishedAt < '2001-07-01'"))
    return g.select("id", "bucket", F.array_join(F.array_remove("flags", "premiere"), ",").alias("flags"))


@query(_GAPS + """ SELECT gp.id, bucket, views AS "viewCount", season FROM gp JOIN recs ON recs.id = gp.id WHERE recs.n % 4 <> 0""")
def joined_gaps(spark, sf):
    r = V.records(spark, sf)
    return evidence.join_gaps(_gaps(spark, sf), r.where(F.col("id").cast("bigint") % 4 != 0)).select("id", "bucket", "viewCount", "season")


@query(_GAPS + " SELECT id FROM gp WHERE bucket = 'low' AND era = 's1'")
def gap_filter(spark, sf):
    return evidence.filter_gaps(_gaps(spark, sf), "low", "s1").select("id")


@query(_GAPS + " SELECT id FROM gp ORDER BY CASE era WHEN 'beta' THEN 0 WHEN 's0' THEN 1 ELSE 2 END, day, id LIMIT 50")
def first_gaps(spark, sf):
    """The first fifty gaps in their order."""
    return evidence.order_gaps(_gaps(spark, sf)).limit(50).select("id")


@query(_GAPS + " SELECT id, row_number() OVER (ORDER BY CASE era WHEN 'beta' THEN 0 WHEN 's0' THEN 1 ELSE 2 END, day, id)::INT AS row FROM gp WHERE bucket IN ('low', 'none')")
def review_rows(spark, sf):
    return evidence.review_rows(_gaps(spark, sf))


@query(_GAPS + " SELECT count(*) FILTER (era IN ('beta', 's0')) AS old, count(*) AS reviewable, round(100.0 * count(*) FILTER (era IN ('beta', 's0')) / count(*))::INT AS percent FROM gp WHERE bucket IN ('low', 'none')")
def old_era_share(spark, sf):
    return evidence.old_era_share(_gaps(spark, sf))


@query(_GAPS + " SELECT bucket, count(*) AS n FROM gp GROUP BY ALL")
def gap_tally(spark, sf):
    return evidence.status_tally(_gaps(spark, sf), "bucket")


@query(_GAPS + """ SELECT gp.id, bucket, gp.era, 'match ' || gp.id AS title, CASE WHEN gp.n % 5 = 0 THEN 'X' END AS "left", CASE WHEN gp.n % 10 = 0 THEN 'Y' END AS "right", gp.n % 5 = 0 AS saved FROM gp WHERE gp.n % 3 > 0""")
def review_queue(spark, sf):
    r = V.records(spark, sf)
    n = F.col("id").cast("bigint")
    ov = r.where(n % 5 == 0).select("id", F.lit("X").alias("left"), F.when(n % 10 == 0, "Y").alias("right"))
    return evidence.review_queue(_gaps(spark, sf).withColumn("frames", n % 3), r, ov)


@query("""SELECT id, lf AS fuse, CASE WHEN n % 2 = 0 AND lf = rf THEN 0 WHEN n % 2 = 0 THEN CASE WHEN rf IS NOT NULL AND lf = rf THEN 0 ELSE 1 END END::INT AS owner FROM recs WHERE lf IS NOT NULL""")
def orient_queue(spark, sf):
    r = V.records(spark, sf).withColumn("lf", F.get("teams", F.lit(0))["fuse"])
    n = F.col("id").cast("bigint")
    rf = F.get("teams", F.lit(1))["fuse"]
    ov = r.where(n % 2 == 0).select("id", F.array(rf, F.col("lf")).alias("fuses"))
    return evidence.orient_queue(r.where("lf is not null").select("id", F.col("lf").alias("fuse")), ov)


@query("SELECT id FROM det WHERE id NOT IN (SELECT id FROM recs WHERE season = 1)")
def orphans(spark, sf):
    r = V.records(spark, sf)
    return evidence.orphans(V.detections(r), r.where("season = 1")).select("id")


@query("SELECT id FROM recs WHERE id NOT IN (SELECT id FROM det) ORDER BY id LIMIT 40")
def backlog(spark, sf):
    r = V.records(spark, sf)
    return evidence.backlog(r, V.detections(r), 40)


@query("SELECT id, CASE WHEN n % 4 = 0 THEN 2 ELSE 1 END::INT AS n, CASE WHEN n % 4 = 0 THEN strftime(day::DATE + 3, '%Y-%m-%d') ELSE day END AS last, n % 4 = 0 AS persistent FROM recs WHERE n % 14 = 0")
def attempt_summary(spark, sf):
    return evidence.attempt_summary(_attempts(V.records(spark, sf)))


@query(""", x AS (SELECT list_zip(CASE WHEN status = 'ok-unordered' THEN list_sort([lf, rf], 'ASC', 'NULLS LAST') ELSE [lf, rf] END, CASE WHEN status = 'ok-unordered' THEN list_sort([l, r], 'ASC', 'NULLS LAST') ELSE [l, r] END) AS z FROM recs JOIN det USING (id) WHERE status <> 'low'),
u AS (SELECT unnest(z) AS p FROM x) SELECT p[1] AS truth, p[2] AS seen, count(*) AS n FROM u GROUP BY ALL""")
def confusion_matrix(spark, sf):
    r = V.records(spark, sf)
    labels = r.select("id", F.get("teams", F.lit(0))["fuse"].alias("left"), F.get("teams", F.lit(1))["fuse"].alias("right"))
    return evidence.confusion(labels, V.detections(r))


@query("SELECT floor(dur / 4)::BIGINT * 4 AS bin, count(*) AS n FROM recs GROUP BY ALL")
def duration_histogram(spark, sf):
    return evidence.histogram(V.records(spark, sf), "durationSec")


@query("""SELECT id, 'stale' AS kind FROM recs WHERE n % 3 = 0 AND id NOT IN (SELECT id FROM det WHERE status IN ('low', 'none'))
UNION ALL SELECT id, 'absent' FROM det WHERE status = 'low' AND id::BIGINT % 3 <> 0""")
def sheet_drift(spark, sf):
    r = V.records(spark, sf)
    return evidence.sheet_drift(r.where(F.col("id").cast("bigint") % 3 == 0).select("id"), V.detections(r))


_PIX = """, px AS (SELECT l_orderkey AS video, l_quantity / 50 AS r, least(1.0::DOUBLE, l_discount * 10) AS g, least(1.0::DOUBLE, l_tax * 12.5::DOUBLE) AS b FROM lineitem),
p2 AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM px),
p3 AS (SELECT *, CASE WHEN mx = 0 THEN 0 ELSE d / mx END AS sat, CASE WHEN d = 0 THEN 0 ELSE (CASE WHEN mx = r THEN (g - b) / d WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END) * 60 END AS h0 FROM p2),
p4 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h, sat >= 0.35 AND mx >= 0.3 AS lit FROM p3)"""


@query(_PIX + """, cs(class, hue) AS (VALUES ('amber', 40.0), ('teal', 172.0), ('violet', 262.0), ('red', 355.0)),
ev AS (SELECT video, sum(CASE WHEN lit THEN sat ELSE 0 END) AS weight, count(*) FILTER (lit)::DOUBLE / count(*) AS sat_frac FROM p4 GROUP BY video),
nr AS (SELECT video, sat, arg_min(class, least(abs(h - hue), 360 - abs(h - hue))) AS class, min(least(abs(h - hue), 360 - abs(h - hue))) AS dd FROM (SELECT *, row_number() OVER () AS rid FROM p4 WHERE lit), cs GROUP BY rid, video, sat)
SELECT video, class, round(sum(sat) / any_value(weight), 6) AS share, round(any_value(sat_frac), 6) AS sat_frac FROM nr JOIN ev USING (video) WHERE dd < 22 GROUP BY video, class""")
def hue_votes(spark, sf):
    classes = spark.createDataFrame([("amber", 40.0), ("teal", 172.0), ("violet", 262.0), ("red", 355.0)], "class string, hue double")
    return evidence.hue_shares(V.pixels(spark, sf), classes).withColumns({"share": F.round("share", 6), "sat_frac": F.round("sat_frac", 6)})


@query(_PIX + """, q AS (SELECT video % 50 AS k, sum(sin(radians(h)) * sat) AS y, sum(cos(radians(h)) * sat) AS x FROM p4 WHERE lit GROUP BY 1)
SELECT k, round(CASE WHEN degrees(atan2(y, x)) < 0 THEN degrees(atan2(y, x)) + 360 ELSE degrees(atan2(y, x)) END, 4) AS hue FROM q""")
def template_hue(spark, sf):
    return evidence.template_hue(V.pixels(spark, sf).withColumn("k", F.col("video") % 50), "k").withColumn("hue", F.round("hue", 4))


@query(""", v AS (SELECT 1 AS version, id FROM recs WHERE day < '1997-01-01' UNION ALL SELECT 2, id FROM recs WHERE day < '1999-01-01' UNION ALL SELECT 3, id FROM recs WHERE day < '1999-01-01'),
dv AS (SELECT version, id FROM v WHERE id::BIGINT % 7 <> 0), gr AS (SELECT max(version) - 1 AS version FROM dv a WHERE NOT EXISTS (SELECT 1 FROM dv b WHERE b.id = a.id AND b.version = a.version - 1))
SELECT v.id, v.version FROM v JOIN gr USING (version)""")
def growth_snapshot(spark, sf):
    r = V.records(spark, sf).select("id", "publishedAt")
    v = None
    for k, end in ((1, "1997-01-01"), (2, "1999-01-01"), (3, "1999-01-01")):
        part = r.where(F.col("publishedAt") < end).select(F.lit(k).alias("version"), "id")
        v = part if v is None else v.union(part)
    return evidence.last_growth_snapshot(v.where(F.col("id").cast("bigint") % 7 != 0), v)
