"""Seasons and patches: interval joins, computed windows, and their checks.

Intervals of a dimension don't overlap. A dimension of few rows (MOST) is held by each task; a larger one is joined by a sweep over both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators.asof import as_of

#: Rows of a dimension that each task may hold: under 2 MB.
MOST = 10_000
#: Days after a season's start within which a label of the season before is believed.
GRACE_DAYS = 2
SEASONS = "season int, start string, end string, todo string"
PATCHES = "version string, start string, includes array<string>, note string, todo string"


def _day(c: str) -> F.Column:
    """Days are compared as text, so empty and odd ones lie before all seasons."""
    return F.substring(F.coalesce(F.col(c), F.lit("")), 1, 10)


def _within(day, start, end):
    return (day >= start) & (end.isNull() | (day < end))


def placed(df: DataFrame, day: F.Column, dim: DataFrame, start: str, end: str) -> DataFrame:
    """df with the columns of the row of dim whose interval (start to before end, open if null) holds the day; nulls where none does."""
    rows = dim.limit(MOST + 1).collect()
    if len(rows) <= MOST:
        held = F.broadcast(df.sparkSession.createDataFrame(rows, dim.schema))
        return df.join(held, _within(day, held[start], held[end]), "left")
    swept = as_of(df.withColumn("_day", day), "_day", dim, start)
    inside = _within(F.col("_day"), F.col("_at")[start], F.col("_at")[end])
    return swept.select(*df.columns, *(F.when(inside, F.col("_at")[c]).alias(c) for c in dim.columns))


def with_season(df: DataFrame, seasons: DataFrame, day_col: str = "publishedAt") -> DataFrame:
    """df with season and season_start, null before all seasons."""
    s = seasons.select(F.col("season"), F.col("start").alias("season_start"), F.col("end").alias("_season_end"))
    return placed(df, _day(day_col), s, "season_start", "_season_end").drop("_season_end")


def patch_windows(patches: DataFrame, seasons: DataFrame) -> DataFrame:
    """patches with their season and end: the next start within the season, else the season's end."""
    s = seasons.select(F.col("season"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    of = placed(patches, F.col("start"), s, "_s", "_e")
    nxt = F.lead("start").over(Window.partitionBy("season").orderBy("start"))
    return of.withColumn("end", F.coalesce(F.when(F.col("season").isNotNull(), nxt), F.col("_e"))).drop("_s", "_e")


def with_patch(df: DataFrame, windows: DataFrame, day_col: str = "publishedAt") -> DataFrame:
    """df with patchVersion: the window that holds the day."""
    p = windows.select(F.col("version").alias("patchVersion"), F.col("start").alias("_ps"), F.col("end").alias("_pe"))
    return placed(df, _day(day_col), p, "_ps", "_pe").drop("_ps", "_pe")


def with_grace(df: DataFrame, seasons: DataFrame, label_col: str = "labeled", day_col: str = "publishedAt", days: int = GRACE_DAYS) -> DataFrame:
    """df with season, graced and stale_label: a label one season earlier wins shortly after a season's start; other labels that differ are stale."""
    dated = with_season(df, seasons, day_col)
    graced = F.coalesce((F.col(label_col) == F.col("season") - 1) & (_day(day_col) < X.add_days(F.col("season_start"), days)), F.lit(False))
    stale = ~graced & F.col(label_col).isNotNull() & ~F.col(label_col).eqNullSafe(F.col("season"))
    made = dated.withColumns({"graced": graced, "stale_label": stale})
    return made.withColumn("season", F.when(F.col("graced"), F.col(label_col)).otherwise(F.col("season"))).drop("season_start")


def null_contradicting_patch(df: DataFrame, windows: DataFrame) -> DataFrame:
    """patchVersion is null where its season isn't the record's."""
    p = windows.select(F.col("version").alias("_v"), F.col("season").alias("_ps"))
    kept = F.when(F.col("_ps").eqNullSafe(F.col("season")), F.col("patchVersion"))
    return df.join(p, F.col("patchVersion") == F.col("_v"), "left").withColumn("patchVersion", kept).drop("_v", "_ps")


def patch_groups(seasons: DataFrame, windows: DataFrame) -> DataFrame:
    """(parent, ord, children): Beta, then seasons with their patches in order."""
    kids = windows.where("season is not null").groupBy("season").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "version"))), lambda x: x["version"]).alias("children"))
    own = seasons.select("season").join(kids, "season", "left").select(X.era_key(F.col("season")).alias("parent"), (F.col("season") + 1).alias("ord"), F.coalesce("children", F.array().cast("array<string>")).alias("children"))
    beta = seasons.sparkSession.range(1).select(F.lit("Beta").alias("parent"), F.lit(0).alias("ord"), F.array().cast("array<string>").alias("children"))
    return beta.unionByName(own)


def expand_tokens(tokens: DataFrame, groups: DataFrame) -> DataFrame:
    """Versions (and eras) that tokens (token) stand for: a parent stands for itself and its children."""
    g = groups.select(F.col("parent").alias("token"), F.explode(F.concat(F.array("parent"), "children")).alias("version"))
    return tokens.join(g, "token", "left").select(F.coalesce("version", "token").alias("version")).distinct()


def retire_tokens(tokens: DataFrame, retired: DataFrame) -> DataFrame:
    """(version, ord) of tokens (token, ord) in their order, each once: a retired token (token, versions) gives its versions in its place."""
    rows = tokens.join(retired.select("token", "versions"), "token", "left")
    each = rows.select("ord", F.posexplode(F.coalesce("versions", F.array("token"))).alias("pos", "version"))
    return each.groupBy("version").agg(F.min(F.struct("ord", "pos")).alias("ord"))


def boundary_violations(seasons: DataFrame, patches: DataFrame) -> DataFrame:
    """(version, rule): days that are none, versions that look like eras, repeats, hotfixes with a row of their own, starts out of order or of season, and seasons that don't open with a patch."""
    w = patch_windows(patches, seasons)
    numbered = patches.withColumn("_before", F.lag("start").over(Window.orderBy("ord"))) if "ord" in patches.columns else patches.withColumn("_before", F.lit(None).cast("string"))
    bad = [
        patches.where(~F.col("start").rlike(r"^\d{4}-\d{2}-\d{2}$")).select("version", F.lit("not-a-day").alias("rule")),
        patches.where(F.col("version").rlike(r"(?i)^(S\d+|Beta)$")).select("version", F.lit("era-token").alias("rule")),
        patches.groupBy("version").count().where("count > 1").select("version", F.lit("duplicate").alias("rule")),
        patches.select("version", F.explode("includes").alias("inc")).join(patches.select(F.col("version").alias("inc")).distinct(), "inc").select("version", F.lit("included-row").alias("rule")),
        numbered.where(F.col("start") <= F.col("_before")).select("version", F.lit("out-of-order").alias("rule")),
        w.where("season is null").select("version", F.lit("outside-seasons").alias("rule")),
        w.groupBy("season").agg(F.min_by(F.struct("version", "start", "todo"), "start").alias("f")).join(seasons.select("season", F.col("start").alias("_s"), F.col("todo").alias("_t")), "season").where("f.start <> _s and f.todo is null and _t is null").select("f.version", F.lit("late-opening").alias("rule")),
    ]
    out = bad[0]
    for b in bad[1:]:
        out = out.unionByName(b)
    return out


def season_diff(df: DataFrame, overrides: DataFrame, manual: DataFrame, seasons: DataFrame) -> DataFrame:
    """(id, old, new) of every record: explicit seasons of overrides, then of manual rows, else by date. overrides: (id, patch map); manual: (id, season_given, season)."""
    dated = with_season(df.withColumnRenamed("season", "old"), seasons).withColumnRenamed("season", "dated")
    ov = overrides.where(F.map_contains_key("patch", F.lit("season"))).select("id", F.col("patch")["season"].cast("int").alias("_os"), F.lit(True).alias("_o"))
    mv = manual.where("season_given").select("id", F.col("season").alias("_ms"), F.lit(True).alias("_m"))
    new = F.when(F.col("_o"), F.col("_os")).when(F.col("_m"), F.col("_ms")).otherwise(F.col("dated"))
    return dated.join(ov, "id", "left").join(mv, "id", "left").select("id", "old", new.alias("new"))


def season_distribution(diff: DataFrame) -> DataFrame:
    """(kind, era, n) of old and new seasons."""
    both = diff.select(F.explode(F.array(F.struct(F.lit("old").alias("kind"), X.era_key(F.col("old")).alias("era")), F.struct(F.lit("new").alias("kind"), X.era_key(F.col("new")).alias("era")))).alias("x"))
    return both.groupBy("x.kind", "x.era").agg(F.count("*").alias("n"))


def change_gate(diff: DataFrame, limit: int = 20) -> DataFrame:
    """(changed, passes)."""
    return diff.agg(F.count_if(~F.col("old").eqNullSafe(F.col("new"))).alias("changed")).withColumn("passes", F.col("changed") <= limit)
