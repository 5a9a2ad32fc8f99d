"""Faceted record queries: predicates on records, composed by AND. All are filters that reach the scan where the column is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X


def source(ids: list[str], groups: dict[str, list[str]] | None = None) -> Column:
    """Channels, and groups of channels by name, any of which fits."""
    flat = [c for i in ids for c in (groups or {}).get(i, [i])]
    return F.col("channel").isin(flat)


def patch(tokens: list[str]) -> Column:
    """Eras stand for all of a season, other tokens for one patch."""
    return X.era_key(F.col("season")).isin(tokens) | F.coalesce(F.col("patchVersion").isin(tokens), F.lit(False))


def fuse(ids: list[str]) -> Column:
    """A team with any of them; teams without one never fit."""
    return F.exists("teams", lambda t: F.coalesce(t["fuse"].isin(ids), F.lit(False)))


def characters(ids: list[str], same_side: bool = False) -> Column:
    """All of them, on one side if asked for."""
    wanted = F.array(*map(F.lit, ids))
    missing = lambda have: F.size(F.array_except(wanted, have)) == 0
    return F.exists("teams", lambda t: missing(t["characters"])) if same_side else missing(F.col("allCharacters"))


def player(ids: list[str]) -> Column:
    return F.arrays_overlap("allPlayers", F.array(*map(F.lit, ids)))


def text(q: str) -> Column:
    """Each blank-parted token stands in some player's name."""
    names = F.lower(F.array_join(F.flatten(F.transform("teams", lambda t: t["players"]["displayName"])), "\n"))
    out = F.lit(True)
    for token in q.lower().split():
        out = out & names.contains(token)
    return out


def browse(df: DataFrame, sources: list[str] | None = None, groups: dict | None = None, patches: list[str] | None = None, fuses: list[str] | None = None, chars: list[str] | None = None, same_side: bool = False, players: list[str] | None = None, q: str | None = None) -> DataFrame:
    """records that fit all that is asked for."""
    asked = [
        (sources, lambda: source(sources, groups)),
        (patches, lambda: patch(patches)),
        (fuses, lambda: fuse(fuses)),
        (chars, lambda: characters(chars, same_side)),
        (players, lambda: player(players)),
        (q, lambda: text(q)),
    ]
    for given, predicate in asked:
        if given:
            df = df.where(predicate())
    return df


def needs_characters(df: DataFrame) -> DataFrame:
    """Manual rows with a todo or an empty side."""
    return df.where(F.col("todo").isNotNull() | F.exists("teams", lambda t: F.size(t["characters"]) == 0))


def fuse_attribution(df: DataFrame) -> DataFrame:
    """(id, a, b, pair): fuses by side where the order is known, else the unbound pair."""
    a, b = (F.get("teams", F.lit(k))["fuse"] for k in (0, 1))
    loose = F.coalesce(F.col("fusesUnordered"), F.lit(False))
    return df.select("id", F.when(~loose, a).alias("a"), F.when(~loose, b).alias("b"), F.when(loose, F.concat_ws("+", F.array_sort(F.array_compact(F.array(a, b))))).alias("pair"))
