"""Layers on parsed records, in this order: detections, overrides, manual rows, exclusions, patch consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.functions import text as X
from matchlake.operators import periods


def merge_detections(df: DataFrame, detections: DataFrame) -> DataFrame:
    """Confident detections (id, left, right, status) set both sides' fuses; unordered ones are flagged."""
    d = detections.where(F.col("status").isin("ok", "ok-unordered")).select("id", F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("status").alias("_s"))
    out = df.join(d, "id", "left")
    apply = F.col("_s").isNotNull() & (F.size("teams") == 2)
    fused = F.transform("teams", lambda t, i: t.withField("fuse", F.when(i == 0, F.col("_l")).otherwise(F.col("_r"))))
    loose = F.when(apply & (F.col("_s") == "ok-unordered"), True).otherwise(F.col("fusesUnordered"))
    return out.withColumns({"teams": F.when(apply, fused).otherwise(F.col("teams")), "fusesUnordered": loose}).drop("_l", "_r", "_s")


def apply_overrides(df: DataFrame, overrides: DataFrame) -> DataFrame:
    """overrides: (id, patch map<string, string>), a value in JSON for each key. A key that is there replaces the column, by null too; others stay, and nothing is derived anew."""
    o = overrides.select("id", F.col("patch").alias("_p"))
    out = df.join(o, "id", "left")
    merged = F.col("_p").isNotNull() & ~F.coalesce(F.try_element_at("_p", F.lit("exclude")) == "true", F.lit(False))
    made = {}
    for f in df.schema.fields:
        if f.name == "id":
            continue
        raw = F.try_element_at("_p", F.lit(f.name))
        nested = isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))
        value = F.from_json(raw, f.dataType) if nested else raw.cast(f.dataType)
        made[f.name] = F.when(merged & F.map_contains_key("_p", F.lit(f.name)), value).otherwise(F.col(f.name))
    return out.withColumns(made).drop("_p")


def drop_excluded(df: DataFrame, overrides: DataFrame) -> DataFrame:
    return df.join(overrides.where(F.try_element_at("patch", F.lit("exclude")) == "true").select("id"), "id", "left_anti")


def manual_records(manual: DataFrame, seasons: DataFrame, windows: DataFrame) -> DataFrame:
    """Hand-written rows with defaults. season_given and version_given tell an explicit null from none."""
    dated = periods.with_patch(periods.with_season(manual.withColumnsRenamed({"season": "_season", "patchVersion": "_version"}), seasons), windows)
    return dated.withColumns(
        {
            "season": F.when(F.col("season_given"), F.col("_season")).otherwise(F.col("season")),
            "patchVersion": F.when(F.col("version_given"), F.col("_version")).otherwise(F.col("patchVersion")),
            "channel": F.lit("manual"),
            "channelName": F.coalesce("channelName", "tournament"),
            "thumbnail": F.coalesce("thumbnail", X.picture(F.col("id"))),
            "durationSec": F.coalesce("durationSec", F.lit(0)),
            "viewCount": F.coalesce("viewCount", F.lit(0)),
            "matchType": F.coalesce("matchType", F.lit("tournament")),
            "parseConfidence": F.lit("manual"),
            "tags": F.array_sort(F.array_distinct(F.concat(X.round_tags(F.col("title")), F.coalesce("tags", F.array().cast("array<string>")), F.when(X.same_pair(F.get("teams", F.lit(0))["characters"], F.get("teams", F.lit(1))["characters"]), F.array(F.lit("mirror"))).otherwise(F.array().cast("array<string>"))))),
        }
    ).drop("_season", "_version", "season_start", "season_given", "version_given")


def union_manual(df: DataFrame, manual: DataFrame) -> DataFrame:
    return df.unionByName(manual, allowMissingColumns=True)


def layered(parsed: DataFrame, detections: DataFrame, overrides: DataFrame, manual: DataFrame, windows: DataFrame) -> DataFrame:
    """All layers. Overrides touch parsed rows alone, exclusions all."""
    merged = apply_overrides(merge_detections(parsed, detections), overrides)
    return periods.null_contradicting_patch(drop_excluded(union_manual(merged, manual), overrides), windows)


def manual_violations(manual: DataFrame, raw_ids: DataFrame, characters: DataFrame, fuses: DataFrame) -> DataFrame:
    """(id, rule) of hand-written rows that must not land."""
    teams = manual.select("id", F.posexplode_outer("teams").alias("side", "t"))
    rows = [
        manual.where(F.coalesce("id", F.lit("")) == "").select("id", F.lit("missing-id").alias("rule")),
        manual.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate-id")),
        manual.join(raw_ids, "id", "left_semi").select("id", F.lit("id-in-dumps")),
        manual.where(F.coalesce("title", F.lit("")) == "").select("id", F.lit("missing-title")),
        manual.where(F.try_to_timestamp("publishedAt").isNull()).select("id", F.lit("bad-date")),
        manual.where(F.coalesce("tournament", F.lit("")) == "").select("id", F.lit("missing-tournament")),
        manual.where(F.coalesce(F.size("teams"), F.lit(0)) != 2).select("id", F.lit("not-two-teams")),
        manual.where(~F.col("matchType").isin("ranked", "tournament", "duo")).select("id", F.lit("bad-match-type")),
        teams.where(F.col("t").isNotNull() & (F.coalesce(F.size(F.filter("t.players", lambda x: F.trim(x) != "")), F.lit(0)) <= 0)).select("id", F.lit("no-players")).distinct(),
        teams.select("id", F.explode("t.characters").alias("c")).join(characters.select(F.col("id").alias("c")), "c", "left_anti").select("id", F.lit("unknown-character")).distinct(),
        teams.where("t.fuse is not null").select("id", F.col("t.fuse").alias("f")).join(fuses.select(F.col("id").alias("f")), "f", "left_anti").select("id", F.lit("unknown-fuse")).distinct(),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out
