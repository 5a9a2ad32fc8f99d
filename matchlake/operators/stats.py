"""Usage, pairing, matchup and era statistics, as long tables.

records: id, season, patchVersion, channel, teams array<struct<side, players array<struct<id, displayName>>, characters, fuse>>,
allCharacters, allPlayers. Each statistic explodes once and aggregates on the map side before its only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.functions import text as X

def _n() -> Column:
    return F.count("*").alias("n")


def character_usage(df: DataFrame, by_era: bool = False) -> DataFrame:
    """Once a record."""
    rows = df.select(X.era_key(F.col("season")).alias("era"), F.explode("allCharacters").alias("character"))
    return rows.groupBy(*(["era"] if by_era else []), "character").agg(_n())


def totals(df: DataFrame) -> DataFrame:
    """(era, records, with_fuse) by era; era null for all."""
    fused = F.exists("teams", lambda t: t["fuse"].isNotNull())
    return df.select(X.era_key(F.col("season")).alias("era"), fused.alias("f")).rollup("era").agg(F.count("*").alias("records"), F.count_if("f").alias("with_fuse"))


def teams(df: DataFrame) -> DataFrame:
    """One row a team: id, era, channel, side, players, characters, fuse, pair."""
    rows = df.select("id", "channel", X.era_key(F.col("season")).alias("era"), F.inline("teams"))
    return rows.withColumn("pair", X.pair_key(F.col("characters")))


def fuse_usage(df: DataFrame, by_era: bool = False) -> DataFrame:
    return teams(df).where("fuse is not null").groupBy(*(["era"] if by_era else []), "fuse").agg(_n())


def pair_usage(df: DataFrame) -> DataFrame:
    return teams(df).where("pair is not null").groupBy("pair").agg(_n())


def player_characters(df: DataFrame) -> DataFrame:
    rows = teams(df).select(F.explode("players.id").alias("player"), "characters").select("player", F.explode("characters").alias("character"))
    return rows.groupBy("player", "character").agg(_n())


def player_pairs(df: DataFrame) -> DataFrame:
    return teams(df).where("pair is not null").select(F.explode("players.id").alias("player"), "pair").groupBy("player", "pair").agg(_n())


def matchups(df: DataFrame) -> DataFrame:
    """Both directions of each match of two full teams, so a mirror counts twice on the diagonal."""
    a, b = (X.pair_key(F.get("teams", F.lit(k))["characters"]) for k in (0, 1))
    rows = df.where(F.size("teams") == 2).select(a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    both = rows.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("m"))
    return both.groupBy("m.a", "m.b").agg(_n())


def fuse_share(df: DataFrame) -> DataFrame:
    """Percent of an era's picks, drawn at 3 at least, and of its largest, drawn at 4 at least."""
    u = fuse_usage(df, by_era=True)
    era = Window.partitionBy("era")
    share, most = 100.0 * F.col("n") / F.sum("n").over(era), 100.0 * F.col("n") / F.max("n").over(era)
    return u.select("era", "fuse", "n", F.round(share).cast("int").alias("share"), F.greatest(F.lit(3), F.round(share).cast("int")).alias("bar"), F.greatest(F.lit(4), F.round(most).cast("int")).alias("of_most"))


def rank_fuses(usage: DataFrame, registry: DataFrame, by_era: bool = False) -> DataFrame:
    """Fuses of the registry (id, name) by usage, then id."""
    w = Window.partitionBy(*(["era"] if by_era else [])).orderBy(F.desc("n"), "fuse")
    known = usage.join(F.broadcast(registry.select(F.col("id").alias("fuse"), "name")), "fuse")  # a registry has tens of rows
    return known.withColumn("rank", F.row_number().over(w))


def fuse_catalog(registry: DataFrame) -> DataFrame:
    """(rank, id): active ones first, then by name."""
    return registry.select(F.row_number().over(Window.orderBy(F.desc("active"), F.collate("name", "UNICODE"), "id")).alias("rank"), "id")


def era_timeline(df: DataFrame) -> DataFrame:
    return df.select("season").distinct().select(X.era_key(F.col("season")).alias("era"), F.coalesce("season", F.lit(-1)).alias("ord")).orderBy("ord")


def top_pairs(df: DataFrame, n: int) -> DataFrame:
    return pair_usage(df).orderBy(F.desc("n"), "pair").limit(n)


def never_paired(df: DataFrame, characters: DataFrame) -> DataFrame:
    """Pairs of the roster (id; tens of rows) that no team plays."""
    b = F.broadcast(characters.select(F.col("id").alias("b")))
    grid = characters.select(F.col("id").alias("a")).join(b, F.col("a") < F.col("b")).select(F.concat_ws("|", "a", "b").alias("pair"))
    return grid.join(pair_usage(df), "pair", "left_anti")


def top_characters(df: DataFrame, n: int) -> DataFrame:
    """(player, character, n, rank): each player's n most played, ties by name."""
    w = Window.partitionBy("player").orderBy(F.desc("n"), "character")
    return player_characters(df).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def entity_counts(df: DataFrame) -> DataFrame:
    return df.select(F.explode("allPlayers").alias("player")).groupBy("player").agg(_n())


def fill_rates(df: DataFrame) -> DataFrame:
    """Percent of records with a season, version, label and fuse, to one decimal."""
    rate = lambda c, name: F.round(100.0 * F.avg(c.cast("int")), 1).alias(name)
    fused = F.exists("teams", lambda t: t["fuse"].isNotNull())
    return df.agg(rate(F.col("season").isNotNull(), "season"), rate(F.col("patchVersion").isNotNull(), "version"), rate(F.col("patch").isNotNull(), "label"), rate(fused, "fuse"))


def confidence_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("parseConfidence").agg(_n())


def metadata_coverage(raw: DataFrame, aliases: list[str]) -> DataFrame:
    """Descriptions by channel that name a season, a patch or a fuse."""
    d = F.col("description")
    fuse = "(?i)(" + "|".join(aliases) + ")"
    return raw.groupBy("channel").agg(F.count("*").alias("n"), F.count_if(d.rlike(r"(?i)Season\s*(\d+)")).alias("season"), F.count_if(d.rlike(r"(?i)Patch\s*:")).alias("patch"), F.count_if(d.rlike(fuse)).alias("fuse"))


def coverage(df: DataFrame, floor: float = 0.95) -> DataFrame:
    """(with_fuse, records, passes)."""
    fused = F.count_if(F.exists("teams", lambda t: t["fuse"].isNotNull()))
    return df.agg(fused.alias("with_fuse"), F.count("*").alias("records")).withColumn("passes", F.col("with_fuse") >= floor * F.col("records"))


def spread(df: DataFrame, rows: str = "era", columns: str = "channel") -> DataFrame:
    """Counts by row and column with totals ('all')."""
    return df.cube(rows, columns).agg(_n(), F.grouping_id().alias("g")).select(F.when(F.col("g").bitwiseAND(2) > 0, "all").otherwise(F.col(rows)).alias(rows), F.when(F.col("g").bitwiseAND(1) > 0, "all").otherwise(F.col(columns)).alias(columns), "n")


def raised() -> Column:
    """The counters (name, k1, k2) that a record raises, each as often as it counts."""
    kind = "struct<name:string,k1:string,k2:string>"
    key = lambda name, k1=None, k2=None: F.struct(F.lit(name).alias("name"), *((F.lit(None) if k is None else k).cast("string").alias(n) for n, k in (("k1", k1), ("k2", k2)))).cast(kind)
    some = lambda cond, *keys: F.when(cond, F.array(*keys)).otherwise(F.array().cast(f"array<{kind}>"))
    era = X.era_key(F.col("season"))
    fused = lambda t: t["fuse"].isNotNull()
    each = lambda made: F.flatten(F.transform("teams", made))
    return F.concat(
        F.array(key("totals.replays"), key("totals.byPatch", era)),
        some(F.exists("teams", fused), key("totals.withFuse")),
        F.transform("allCharacters", lambda c: key("characterUsage", c)),
        F.transform("allCharacters", lambda c: key("byPatchUsage", era, c)),
        each(lambda t: some(F.size(t["characters"]) == 2, key("pairingUsage", X.pair_key(t["characters"])))),
        each(lambda t: some(fused(t), key("fuseUsage", t["fuse"]), key("fuseByPatch", era, t["fuse"]))),
    )


def contract_stats(df: DataFrame, characters: DataFrame, players: DataFrame) -> DataFrame:
    """(name, k1, k2, n): all statistics in one long table, as a sink takes them. A record names all counters that it raises, so one scan and one shuffle do."""
    counted = df.select(F.explode(raised()).alias("k")).groupBy("k.name", "k.k1", "k.k2").agg(_n())
    none = F.lit(None).cast("string")
    for name, rows in (("totals.characters", characters), ("totals.players", players)):
        counted = counted.union(rows.agg(_n()).select(F.lit(name), none, none, "n"))
    return counted


def sample(df: DataFrame, n: int, by: str) -> DataFrame:
    """The first n by an ordinal."""
    return df.orderBy(by).limit(n)
