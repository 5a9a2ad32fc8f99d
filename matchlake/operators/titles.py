"""Titles to records: every step is a column expression; names are resolved as distinct tokens and joined back by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import periods, resolve
from matchlake.operators.checkpoints import cut, kept

#: Rows of a dictionary that each task may hold.
MOST = 10_000


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed here, once: behind a generator of one row the optimizer does not copy their expressions into each use."""
    made = df.select("*", F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("_once"))
    return made.withColumns({n: F.col(f"_once.{n}") for n in columns}).drop("_once")


def parse_titles(raw: DataFrame, brand: str) -> DataFrame:
    """raw with fail_stage (team-split, team-extract or null) and segs: array of (players, characters), raw, left first."""
    one = settled(raw, _core=F.trim(X.strip_suffix(X.strip_prefix(X.norm_ws(F.col("title")), brand))))
    two = settled(one, _s=X.split_teams(F.col("_core")))
    three = settled(two, _l=X.extract_team(F.col("_s.left")), _r=X.extract_team(F.col("_s.right")))
    fail = F.when(F.col("_s").isNull(), "team-split").when(F.col("_l").isNull() | F.col("_r").isNull(), "team-extract")
    return settled(three, fail_stage=fail, segs=F.when(fail.isNull(), F.array("_l", "_r"))).drop("_core", "_s", "_l", "_r")


def tokens(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(characters, players): (id, side, pos, token, ord) of each token; ord follows the rows' own ord, then place."""
    teams = parsed.where("fail_stage is null").select("id", "ord", F.posexplode("segs").alias("side", "s"))
    made = []
    teams = settled(teams, _players=X.strip_accolades(F.col("s.players")))
    for column in (X.split_chars(F.col("s.characters")), X.split_players(F.col("_players"))):
        rows = teams.select("id", "side", "ord", F.posexplode(column).alias("pos", "token"))
        made.append(rows.withColumn("ord", F.struct("ord", "side", "pos")))
    return made[0], made[1]


def side_reasons(name: Column | str, n_characters: Column, found: Column, n_players: Column) -> Column:
    """Why one side makes its record low. found: array of (token, character, how), with all that are unresolved or fuzzy."""
    name = F.lit(name) if isinstance(name, str) else name
    none = F.array().cast("array<string>")
    return F.concat(
        F.when(n_characters != 2, F.array(F.concat(F.lit("team "), name, F.lit(": "), n_characters, F.lit(" character(s) (expected 2)")))).otherwise(none),
        F.transform(F.filter(found, lambda x: x["how"] == "none"), lambda x: F.concat(F.lit('unresolved character "'), x["token"], F.lit('" on '), name)),
        F.transform(F.filter(found, lambda x: x["how"] == "fuzzy"), lambda x: F.concat(F.lit('fuzzy character "'), x["token"], F.lit('" → '), x["character"], F.lit(" on "), name)),
        F.when(n_players == 0, F.array(F.concat(F.lit("team "), name, F.lit(": no players parsed")))).otherwise(none),
    )


def structural_failure(stage: Column) -> Column:
    return F.array(F.concat(F.lit("structural failure ("), stage, F.lit(")")))


def confidence(reasons: Column) -> Column:
    return F.when(F.size(reasons) > 0, "low").otherwise("high")


def build_records(raw: DataFrame, characters: DataFrame, players: DataFrame, fuses: list[tuple[str, str]], seasons: DataFrame, patches: DataFrame, brand: str) -> tuple[DataFrame, DataFrame]:
    """(records with reasons, discovered players). raw: ord, id, channel, title, description, publishedAt, thumbnail, durationSec, viewCount."""
    parsed = cut(parse_titles(raw, brand))  # four branches follow
    chars, names = map(cut, tokens(parsed))
    c = resolve.resolve_characters(chars.drop("ord"), resolve.alias_dim(characters))
    p, discovered = resolve.resolve_players(names, players)
    ordered = lambda x: F.array_sort(F.collect_list(x))
    by_team = c.groupBy("id", "side").agg(ordered(F.struct("pos", "token", "character", "how", "notes")).alias("cs"))
    who = p.groupBy("id", "side").agg(ordered(F.struct("pos", F.col("player").alias("id"), F.col("display").alias("displayName"))).alias("ps"))
    base = parsed.where("fail_stage is null").select("id", F.posexplode("segs").alias("side", "s"))
    team = base.join(by_team, ["id", "side"], "left").join(who, ["id", "side"], "left")
    cs = F.coalesce("cs", F.array().cast("array<struct<pos:int,token:string,character:string,how:string,notes:array<string>>>"))
    ps = F.coalesce("ps", F.array().cast("array<struct<pos:int,id:string,displayName:string>>"))
    name = F.when(F.col("side") == 0, "left").otherwise("right")
    made = F.struct(
        "side",
        name.alias("name"),
        F.transform(ps, lambda x: F.struct(x["id"].alias("id"), x["displayName"].alias("displayName"))).alias("players"),
        F.array_distinct(F.filter(F.transform(cs, lambda x: x["character"]), lambda x: x.isNotNull())).alias("characters"),
        X.scan_alias(F.concat(F.col("s.players"), F.lit(" ("), F.col("s.characters"), F.lit(")")), fuses).alias("fuse"),
        F.flatten(F.transform(cs, lambda x: x["notes"])).alias("notes"),
        side_reasons(name, F.size(cs), cs, F.size(ps)).alias("reasons"),
    )
    both = team.select("id", made.alias("t")).groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    out = parsed.drop("segs").join(both, "id", "left")
    out = settled(out, rounds=X.round_tags(F.col("title")))
    rounds = F.col("rounds")
    some = F.col("fail_stage").isNull()
    empty = F.array().cast("array<string>")
    first, second = F.get("ts", F.lit(0)), F.get("ts", F.lit(1))
    mirror = F.when(some & X.same_pair(first["characters"], second["characters"]), F.array(F.lit("mirror"))).otherwise(empty)
    most = F.when(some, F.greatest(F.size(first["players"]), F.size(second["players"]))).otherwise(0)
    teams = F.when(some, F.transform("ts", lambda t: F.struct(t["name"].alias("side"), t["players"].alias("players"), t["characters"].alias("characters"), t["fuse"].alias("fuse"))))
    out = settled(
        out,
        **{
            "teams": F.coalesce(teams, F.array().cast("array<struct<side:string,players:array<struct<id:string,displayName:string>>,characters:array<string>,fuse:string>>")),
            "tags": F.array_sort(F.array_distinct(F.concat(rounds, mirror, F.when(some, F.flatten(F.transform("ts", lambda t: t["notes"]))).otherwise(empty)))),
            "matchType": X.match_type(most, rounds),
            "reasons": F.when(some, F.flatten(F.transform("ts", lambda t: t["reasons"]))).otherwise(structural_failure(F.col("fail_stage"))),
            "labeled": X.labeled_season(F.col("description")),
            "patch": X.patch_label(F.col("description")),
        },
    )
    out = out.withColumns(
        {
            "allCharacters": F.array_distinct(F.flatten(F.transform("teams", lambda t: t["characters"]))),
            "allPlayers": F.array_distinct(F.flatten(F.transform("teams", lambda t: t["players"]["id"]))),
            "parseConfidence": confidence(F.col("reasons")),
            "rawUnparsed": F.when(~some, F.col("title")),
            "fusesUnordered": F.lit(False),
        }
    ).drop("ts", "fail_stage", "rounds")
    windows = periods.patch_windows(patches, seasons)
    return periods.with_patch(periods.with_grace(out, seasons), windows), discovered


def judged(raw: DataFrame, characters: DataFrame, brand: str) -> DataFrame:
    """(id, reasons, parseConfidence) of all titles, those that build_records gives them: players are counted, as no reason asks who they are, and of
    the characters only tokens that are unresolved or fuzzy come back to their titles. What titles leave is kept once, without their text."""
    part = lambda k, c: F.get("segs", F.lit(k))[c]
    parsed = settled(parse_titles(raw, brand), **{f"_p{k}": X.strip_accolades(part(k, "players")) for k in (0, 1)})
    split = settled(parsed, **{f"chars{k}": X.split_chars(part(k, "characters")) for k in (0, 1)}, **{f"players{k}": F.size(X.split_players(F.col(f"_p{k}"))) for k in (0, 1)})
    rows = kept(split.select("id", "fail_stage", "chars0", "chars1", "players0", "players1"))
    tokens = rows.where("fail_stage is null").select("id", F.posexplode(F.array("chars0", "chars1")).alias("side", "chars")).select("id", "side", F.posexplode("chars").alias("pos", "token"))
    named = resolve.resolve_characters(tokens.select("token").distinct(), resolve.alias_dim(characters))
    odd = kept(named.where("how in ('none', 'fuzzy')").select("token", "character", "how"))
    n = odd.count()
    at = tokens.join(F.broadcast(odd) if n <= MOST else odd, "token").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "token", "character", "how"))).alias("odd"))
    none = F.array().cast(at.schema["odd"].dataType)
    both = rows.join(at, "id", "left").withColumn("odd", F.coalesce("odd", none)) if n else rows.withColumn("odd", none)
    of = lambda k: F.filter("odd", lambda x: x["side"] == k)
    why = F.concat(*(side_reasons(name, F.size(f"chars{k}"), of(k), F.col(f"players{k}")) for k, name in enumerate(("left", "right"))))
    reasons = F.when(F.col("fail_stage").isNull(), why).otherwise(structural_failure(F.col("fail_stage")))
    out = settled(both, reasons=reasons)
    return out.select("id", "reasons", confidence(F.col("reasons")).alias("parseConfidence"))


def low_confidence(records: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """Reasons (id, reasons) of records that are still low; records with reasons of their own need no others."""
    low = records.where("parseConfidence = 'low'")
    return low.select("id", "reasons") if reasons is None else reasons.join(low.select("id"), "id", "left_semi")


def new_players(discovered: DataFrame) -> DataFrame:
    return discovered.orderBy(F.desc("n"), "id")


def off_shape(raw: DataFrame) -> DataFrame:
    return raw.where(~X.expected_shape(F.col("title")))
