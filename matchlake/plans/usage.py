"""Queries: statistics, periods, facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import periods, query as facets, stats
from matchlake.plans import proxies as V
from matchlake.plans.registry import query


@query("SELECT era, c AS character, count(*) AS n FROM (SELECT era, unnest(list_distinct(list_concat(lc, rc))) AS c FROM recs) GROUP BY ALL")
def usage_by_era(spark: SparkSession, sf: str) -> DataFrame:
    return stats.character_usage(V.records(spark, sf), by_era=True)


@query("SELECT c AS character, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(lc, rc))) AS c FROM recs) GROUP BY ALL")
def usage_by_character(spark, sf):
    return stats.character_usage(V.records(spark, sf))


@query("SELECT era, count(*) AS records, count(*) FILTER (lf IS NOT NULL OR rf IS NOT NULL) AS with_fuse FROM recs GROUP BY ROLLUP (era)")
def totals_by_era(spark, sf):
    return stats.totals(V.records(spark, sf))


@query("SELECT fuse, count(*) AS n FROM sides WHERE fuse IS NOT NULL GROUP BY ALL")
def fuse_usage(spark, sf):
    return stats.fuse_usage(V.records(spark, sf))


@query("SELECT era, fuse, count(*) AS n FROM sides WHERE fuse IS NOT NULL GROUP BY ALL")
def fuse_by_era(spark, sf):
    return stats.fuse_usage(V.records(spark, sf), by_era=True)


@query(""", u AS (SELECT era, fuse, count(*) AS n FROM sides WHERE fuse IS NOT NULL GROUP BY ALL)
SELECT era, fuse, n, round(100.0 * n / sum(n) OVER (PARTITION BY era))::INT AS share, greatest(3, round(100.0 * n / sum(n) OVER (PARTITION BY era))::INT) AS bar,
greatest(4, round(100.0 * n / max(n) OVER (PARTITION BY era))::INT) AS of_most FROM u""")
def fuse_share(spark, sf):
    return stats.fuse_share(V.records(spark, sf))


@query("SELECT pair, count(*) AS n FROM pairs WHERE pair IS NOT NULL GROUP BY ALL")
def pair_usage(spark, sf):
    return stats.pair_usage(V.records(spark, sf))


@query("SELECT player, c AS character, count(*) AS n FROM (SELECT player, unnest(chars) AS c FROM (SELECT unnest(players) AS player, chars FROM sides)) GROUP BY ALL")
def player_characters(spark, sf):
    return stats.player_characters(V.records(spark, sf))


@query("SELECT player, pair, count(*) AS n FROM (SELECT unnest(players) AS player, pair FROM pairs WHERE pair IS NOT NULL) GROUP BY ALL")
def player_pairs(spark, sf):
    return stats.player_pairs(V.records(spark, sf))


@query(""", m AS (SELECT array_to_string(lc, '|') AS a, array_to_string(rc, '|') AS b FROM recs WHERE len(lc) = 2 AND len(rc) = 2)
SELECT a, b, count(*) AS n FROM (SELECT a, b FROM m UNION ALL SELECT b, a FROM m) GROUP BY ALL""")
def matchups(spark, sf):
    return stats.matchups(V.records(spark, sf))


@query("SELECT version, start, season, wend AS \"end\" FROM windows")
def patch_windows(spark, sf):
    return V.windows(spark, sf).select("version", "start", "season", "end")


@query("SELECT id, version AS \"patchVersion\", season FROM recs")
def patch_of_record(spark, sf):
    return V.records(spark, sf).select("id", "patchVersion", "season")


@query("""SELECT 'Beta' AS parent, 0 AS ord, '' AS children UNION ALL
SELECT 'S' || season, season + 1, (SELECT coalesce(string_agg(version, ',' ORDER BY start), '') FROM windows w WHERE w.season = seasons.season) FROM seasons""")
def patch_groups(spark, sf):
    return periods.patch_groups(V.seasons(spark), V.windows(spark, sf)).withColumn("children", F.array_join("children", ","))


@query(""", marked AS (SELECT CASE WHEN version LIKE '%.4' THEN 'S' || substr(version, 4, 1) ELSE version END AS version, CASE WHEN version LIKE '%.3' THEN replace(start, '-', '/') ELSE start END AS start FROM patches),
w AS (SELECT m.*, season FROM marked m LEFT JOIN seasons ON start >= s AND (e IS NULL OR start < e))
SELECT version, 'not-a-day' AS rule FROM marked WHERE NOT regexp_full_match(start, '\\d{4}-\\d{2}-\\d{2}')
UNION ALL SELECT version, 'era-token' FROM marked WHERE regexp_matches(version, '(?i)^(S\\d+|Beta)$')
UNION ALL SELECT version, 'duplicate' FROM marked GROUP BY version HAVING count(*) > 1
UNION ALL SELECT version, 'outside-seasons' FROM w WHERE season IS NULL
UNION ALL SELECT version, 'late-opening' FROM (SELECT season, arg_min(version, start) AS version, min(start) AS first FROM w WHERE season IS NOT NULL GROUP BY season) JOIN seasons USING (season) WHERE first <> s""")
def boundary_violations(spark, sf):
    v = F.col("version")
    marked = V.patches(spark, sf).withColumn("start", F.when(v.endswith(".3"), F.regexp_replace("start", "-", "/")).otherwise(F.col("start")))
    marked = marked.withColumn("version", F.when(v.endswith(".4"), F.concat(F.lit("S"), F.substring(v, 4, 1))).otherwise(v))
    return periods.boundary_violations(V.seasons(spark), marked)


@query("SELECT id FROM recs WHERE channel IN ('1-URGENT', '5-LOW', '2-HIGH')")
def facet_source(spark, sf):
    return facets.browse(V.records(spark, sf), sources=["1-URGENT", "rest"], groups={"rest": ["5-LOW", "2-HIGH"]}).select("id")


@query("SELECT id FROM recs WHERE era = 'S0' OR version = '1999.2'")
def facet_patch(spark, sf):
    return facets.browse(V.records(spark, sf), patches=["S0", "1999.2"]).select("id")


@query("SELECT version FROM windows WHERE season = 0 UNION SELECT 'S0' UNION SELECT '1999.2'")
def facet_tokens(spark, sf):
    groups = periods.patch_groups(V.seasons(spark), V.windows(spark, sf))
    return periods.expand_tokens(spark.createDataFrame([("S0",), ("1999.2",)], "token string"), groups)


@query("""SELECT version, list_position(['S0', '1999'], min_by(t, p)) AS ord FROM (
SELECT 'S0' AS t, 0 AS p, 'S0' AS version UNION ALL SELECT '1999', 1, version FROM windows WHERE starts_with(version, '1999.') UNION ALL SELECT '1999.2', 2, '1999.2') GROUP BY version""")
def facet_tokens_retired(spark, sf):
    """A token that is no more stands for a year's patches; one of these that is named again counts once."""
    w = V.windows(spark, sf).where("version like '1999.%'")
    retired = w.groupBy(F.lit("1999").alias("token")).agg(F.array_sort(F.collect_list("version")).alias("versions"))
    tokens = spark.createDataFrame([("S0", 1), ("1999", 2), ("1999.2", 3)], "token string, ord int")
    return periods.retire_tokens(tokens, retired).select("version", "ord.ord")


@query("SELECT id FROM recs WHERE lf IN (SELECT min(p_type) FROM part) OR rf IN (SELECT min(p_type) FROM part)")
def facet_fuse(spark, sf):
    first = V.table(spark, sf, "part").agg(F.min("p_type")).first()[0]
    return facets.browse(V.records(spark, sf), fuses=[first]).select("id")


_TWO = "(SELECT list(b ORDER BY b)[1:2] FROM (SELECT DISTINCT p_brand AS b FROM part))"


def _two(spark, sf) -> list[str]:
    return [r[0] for r in V.table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand").limit(2).collect()]


@query(f"SELECT id FROM recs WHERE list_has_all(list_concat(lc, rc), {_TWO})")
def facet_chars(spark, sf):
    return facets.browse(V.records(spark, sf), chars=_two(spark, sf)).select("id")


@query(f"SELECT id FROM recs WHERE list_has_all(lc, {_TWO}) OR list_has_all(rc, {_TWO})")
def facet_same_side(spark, sf):
    return facets.browse(V.records(spark, sf), chars=_two(spark, sf), same_side=True).select("id")


@query("SELECT id FROM recs WHERE list_contains(lp, (SELECT min(s_name) FROM supplier)) OR list_contains(rp, (SELECT min(s_name) FROM supplier))")
def facet_player(spark, sf):
    return facets.browse(V.records(spark, sf), players=[V.table(spark, sf, "supplier").agg(F.min("s_name")).first()[0]]).select("id")


@query("SELECT id FROM recs WHERE contains(lower(array_to_string(list_concat(lp, rp), chr(10))), '0007') AND contains(lower(array_to_string(list_concat(lp, rp), chr(10))), 'supplier')")
def text_filter(spark, sf):
    return facets.browse(V.records(spark, sf), q="Supplier 0007").select("id")


@query("SELECT id, CASE WHEN st <> 'O' THEN lf END AS a, CASE WHEN st <> 'O' THEN rf END AS b, CASE WHEN st = 'O' THEN array_to_string(list_sort(list_filter([lf, rf], lambda x: x IS NOT NULL)), '+') END AS pair FROM recs")
def fuse_attribution(spark, sf):
    return facets.fuse_attribution(V.records(spark, sf).withColumn("fusesUnordered", F.col("st") == "O"))


@query(""", u AS (SELECT player, c, count(*) AS n FROM (SELECT player, unnest(chars) AS c FROM (SELECT unnest(players) AS player, chars FROM sides)) GROUP BY ALL)
SELECT * FROM (SELECT player, c AS character, n, row_number() OVER (PARTITION BY player ORDER BY n DESC, c)::INT AS rank FROM u) WHERE rank <= 3""")
def top_characters_per_player(spark, sf):
    return stats.top_characters(V.records(spark, sf), 3)


def _fuses(spark, sf):
    """A registry of the types: id, name, active, aliases."""
    t = V.table(spark, sf, "part").select("p_type").distinct()
    return t.select(F.col("p_type").alias("id"), F.lower("p_type").alias("name"), F.col("p_type").contains("A").alias("active"))


@query(""", u AS (SELECT fuse, count(*) AS n FROM sides WHERE fuse IS NOT NULL GROUP BY ALL)
SELECT fuse, n, lower(fuse) AS name, row_number() OVER (ORDER BY n DESC, fuse)::INT AS rank FROM u""")
def fuse_rank(spark, sf):
    return stats.rank_fuses(stats.fuse_usage(V.records(spark, sf)), _fuses(spark, sf))


@query(""", u AS (SELECT era, fuse, count(*) AS n FROM sides WHERE fuse IS NOT NULL GROUP BY ALL)
SELECT era, fuse, n, lower(fuse) AS name, row_number() OVER (PARTITION BY era ORDER BY n DESC, fuse)::INT AS rank FROM u""")
def fuse_rank_by_era(spark, sf):
    return stats.rank_fuses(stats.fuse_usage(V.records(spark, sf), by_era=True), _fuses(spark, sf), by_era=True)


@query("SELECT row_number() OVER (ORDER BY contains(id, 'A') DESC, lower(id), id)::INT AS rank, id FROM (SELECT DISTINCT p_type AS id FROM part)")
def fuse_catalog(spark, sf):
    return stats.fuse_catalog(_fuses(spark, sf))


@query("SELECT DISTINCT era, coalesce(season, -1) AS ord FROM recs")
def era_timeline(spark, sf):
    return stats.era_timeline(V.records(spark, sf))


@query("SELECT pair, count(*) AS n FROM pairs WHERE pair IS NOT NULL GROUP BY ALL ORDER BY n DESC, pair LIMIT 10")
def top_pairs(spark, sf):
    return stats.top_pairs(V.records(spark, sf), 10)


@query(""", b AS (SELECT DISTINCT p_brand AS b FROM part UNION SELECT DISTINCT p_type FROM part)
SELECT x.b || '|' || y.b AS pair FROM b x JOIN b y ON x.b < y.b WHERE x.b || '|' || y.b NOT IN (SELECT pair FROM pairs WHERE pair IS NOT NULL)""")
def never_paired(spark, sf):
    """The roster is the brands and, as characters that nobody plays, the types."""
    part = V.table(spark, sf, "part")
    return stats.never_paired(V.records(spark, sf), part.select(F.col("p_brand").alias("id")).union(part.select("p_type")).distinct())


@query("SELECT player, count(*) AS n FROM (SELECT unnest(list_distinct(list_concat(lp, rp))) AS player FROM recs) GROUP BY ALL")
def entity_counts(spark, sf):
    return stats.entity_counts(V.records(spark, sf))


@query("SELECT id FROM recs ORDER BY n LIMIT 25")
def samples(spark, sf):
    return stats.sample(V.records(spark, sf).withColumn("ord", F.col("id").cast("bigint")), 25, "ord").select("id")


@query("""SELECT round(100.0 * avg((season IS NOT NULL)::INT), 1) AS season, round(100.0 * avg((version IS NOT NULL)::INT), 1) AS version,
round(100.0 * avg((st = 'F')::INT), 1) AS label, round(100.0 * avg((lf IS NOT NULL OR rf IS NOT NULL)::INT), 1) AS fuse FROM recs""")
def fill_rates(spark, sf):
    return stats.fill_rates(V.records(spark, sf))


@query("SELECT CASE WHEN st = 'P' THEN 'low' ELSE 'high' END AS \"parseConfidence\", count(*) AS n FROM recs GROUP BY ALL")
def confidence_counts(spark, sf):
    return stats.confidence_counts(V.records(spark, sf))


@query("SELECT count(*) FILTER (lf IS NOT NULL OR rf IS NOT NULL) AS with_fuse, count(*) AS records, count(*) FILTER (lf IS NOT NULL OR rf IS NOT NULL) >= 0.95 * count(*) AS passes FROM recs")
def coverage(spark, sf):
    return stats.coverage(V.records(spark, sf))


@query(""", fixed AS (SELECT era, channel FROM recs WHERE lf IS NULL AND rf IS NULL)
SELECT coalesce(era, 'all') AS era, coalesce(channel, 'all') AS channel, count(*) AS n FROM fixed GROUP BY CUBE (era, channel)""")
def gap_spread(spark, sf):
    r = V.records(spark, sf).where(~F.exists("teams", lambda t: t["fuse"].isNotNull()))
    return stats.spread(r.withColumn("era", X.era_key(F.col("season"))))


@query(""", d AS (SELECT *, CASE WHEN n % 4 = 0 THEN n % 3 WHEN n % 4 = 1 THEN n % 2 END AS lab FROM recs)
SELECT channel, count(*) AS n, count(lab) AS season, count(*) FILTER (n % 4 = 0) AS patch, 0::BIGINT AS fuse FROM d GROUP BY ALL""")
def metadata_coverage(spark, sf):
    return stats.metadata_coverage(V.titles(spark, sf), ["double down", "freestyle"])


_GRACE = """, lab AS (SELECT recs.*, s, CASE WHEN n % 5 = 0 THEN 0 WHEN n % 5 = 1 THEN 1 END AS l FROM recs LEFT JOIN seasons USING (season)),
g AS (SELECT *, coalesce(l = season - 1 AND day < strftime(s::DATE + INTERVAL 40 DAY, '%Y-%m-%d'), false) AS graced FROM lab)"""


def _graced(spark, sf):
    n = F.col("id").cast("bigint") % 5
    r = V.bare_records(spark, sf).withColumn("labeled", F.when(n == 0, 0).when(n == 1, 1))
    return periods.with_grace(r, V.seasons(spark), days=40)


@query(_GRACE + " SELECT id, CASE WHEN graced THEN l ELSE season END AS season, graced, NOT graced AND l IS NOT NULL AND l IS DISTINCT FROM season AS stale_label FROM g")
def season_grace(spark, sf):
    return _graced(spark, sf).select("id", "season", "graced", "stale_label")


@query(_GRACE + " SELECT count(*) FILTER (graced) AS graced, count(*) FILTER (NOT graced AND l IS NOT NULL AND l IS DISTINCT FROM season) AS stale FROM g")
def stale_labels(spark, sf):
    return _graced(spark, sf).agg(F.count_if("graced").alias("graced"), F.count_if("stale_label").alias("stale"))


@query(_GRACE + """, m AS (SELECT id, version, CASE WHEN graced THEN l ELSE season END AS season FROM g)
SELECT m.id, CASE WHEN w.season IS NOT DISTINCT FROM m.season THEN m.version END AS "patchVersion" FROM m LEFT JOIN windows w ON w.version = m.version""")
def contradicting_patches(spark, sf):
    w = V.windows(spark, sf)
    return periods.null_contradicting_patch(periods.with_patch(_graced(spark, sf), w), w).select("id", "patchVersion")


_DIFF = """, d AS (SELECT id, CASE WHEN n % 9 = 0 THEN 1 ELSE season END AS old,
CASE WHEN n % 50 = 1 THEN 1 WHEN n % 50 = 2 THEN NULL WHEN n % 50 = 3 THEN 0 WHEN n % 50 = 30 THEN 0 ELSE season END AS new FROM recs)"""


def _diff(spark, sf):
    r = V.records(spark, sf)
    n = F.col("id").cast("bigint")
    manual = r.where(n % 50 == 30).select("id", F.lit(True).alias("season_given"), F.lit(0).alias("season"))
    old = r.withColumn("season", F.when(n % 9 == 0, 1).otherwise(F.col("season")))
    return periods.season_diff(old, V.overrides(r), manual, V.seasons(spark))


@query(_DIFF + " SELECT * FROM d")
def season_diff(spark, sf):
    return _diff(spark, sf)


@query(_DIFF + """, x AS (SELECT 'old' AS kind, old AS v FROM d UNION ALL SELECT 'new', new FROM d)
SELECT kind, CASE WHEN v IS NULL THEN 'Beta' ELSE 'S' || v END AS era, count(*) AS n FROM x GROUP BY ALL""")
def season_distribution(spark, sf):
    return periods.season_distribution(_diff(spark, sf))


@query(_DIFF + " SELECT count(*) FILTER (old IS DISTINCT FROM new) AS changed, count(*) FILTER (old IS DISTINCT FROM new) <= 20 AS passes FROM d")
def change_gate(spark, sf):
    return periods.change_gate(_diff(spark, sf))
