"""Data-quality gates: each returns violations, and none means pass; and fingerprints of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.functions import text as X


def contract_violations(replays: DataFrame, df: DataFrame, windows: DataFrame) -> DataFrame:
    """(id, rule): records without a replay, replays without two sides, tokens that are no era or version, or of another season."""
    w = F.broadcast(windows.select(F.col("version").alias("patch"), F.col("season").alias("_ws")))
    fine = replays.where(~F.col("patch").rlike(r"^(Beta|S\d+)$")).join(w, "patch", "left").join(df.select("id", F.col("season").alias("_rs")), "id")
    rows = [
        df.join(replays, "id", "left_anti").select("id", F.lit("no-replay").alias("rule")),
        replays.where(F.size("sides") != 2).select("id", F.lit("not-two-sides")),
        fine.where("_ws is null").select("id", F.lit("unknown-token")),
        fine.where(F.col("_ws").isNotNull() & ~F.col("_ws").eqNullSafe(F.col("_rs"))).select("id", F.lit("season-differs")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out


def count_parity(df: DataFrame, replays: DataFrame, stats: DataFrame) -> DataFrame:
    """(name, found, wanted) where the replays or the statistics' total (name, k1, k2, n) aren't as many as the records."""
    wanted = df.agg(F.count("*").alias("wanted"))
    found = replays.agg(F.lit("replays").alias("name"), F.count("*").alias("found")).unionByName(stats.where("name = 'totals.replays'").select("name", F.col("n").alias("found")))
    return found.join(F.broadcast(wanted), F.lit(True)).where("found <> wanted")  # one row of counts against two


def to_replay(df: DataFrame) -> DataFrame:
    """The contract's rows: id, sides, date, patch, source, title, views, thumb; durationSec, fuses and fusesUnordered null where they are left out."""
    none = F.array().cast("array<string>")
    side = lambda t: F.struct(F.coalesce(F.get(t["players"]["id"], F.lit(0)), F.lit("")).alias("player"), F.when(F.size(t["players"]) > 1, t["players"]["id"]).alias("players"), t["characters"].alias("characters"))
    empty = F.struct(F.lit("").alias("player"), F.lit(None).cast("array<string>").alias("players"), none.alias("characters"))
    a, b = (F.get("teams", F.lit(k))["fuse"] for k in (0, 1))
    return df.select(
        "id",
        F.when(F.size("teams") == 2, F.transform("teams", side)).otherwise(F.array(empty, empty)).alias("sides"),
        F.col("publishedAt").alias("date"),
        X.patch_token(F.col("patchVersion"), F.col("season")).alias("patch"),
        F.col("channel").alias("source"),
        "title",
        F.col("viewCount").alias("views"),
        F.col("thumbnail").alias("thumb"),
        F.when(F.col("durationSec") > 0, F.col("durationSec")).alias("durationSec"),
        F.when(a.isNotNull() | b.isNotNull(), F.array(a, b)).alias("fuses"),
        F.when(F.col("fusesUnordered"), True).alias("fusesUnordered"),
    )


def stale_snapshot(existing: DataFrame, raw: DataFrame, manual: DataFrame, fetched_at: str, published_at: str) -> DataFrame:
    """Published ids that the raw dumps lack (hand-written ones aside), if the dumps are older than the publication."""
    lost = existing.select("id").join(raw.select("id"), "id", "left_anti").join(manual.select("id"), "id", "left_anti")
    return lost.where(F.lit(fetched_at).cast("timestamp") < F.lit(published_at).cast("timestamp"))


def row_hash(df: DataFrame) -> Column:
    """60 bits of a digest of a row's columns in the order of their names, as a number that may be summed; another engine can compute it."""
    text = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in sorted(df.columns)))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, hash): the same for the same rows in any order."""
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row_hash(df)), F.lit(0)).cast("string").alias("hash"))


def hash_tree(df: DataFrame, key: str = "id", levels: int = 3) -> DataFrame:
    """(node, rows, hash) of a snapshot: rows fall into leaves by the first hex digits of their key's digest, and a node stands for all leaves that begin with it;
    '' for all. Sums merge, so a node is the sum of those below it, and the trees of parts add up to that of the whole."""
    leaves = df.select(F.substring(F.md5(F.col(key).cast("string")), 1, levels).alias("leaf"), row_hash(df).alias("h")).groupBy("leaf").agg(F.count("*").alias("rows"), F.sum("h").alias("hash"))
    up = leaves.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.substring("leaf", F.lit(1), n))).alias("node"), "rows", "hash")
    return up.groupBy("node").agg(F.sum("rows").alias("rows"), F.sum("hash").cast("decimal(38,0)").alias("hash"))


def changed_ranges(old: DataFrame, new: DataFrame, levels: int = 3) -> DataFrame:
    """(node, old_rows, new_rows) of the leaves in which two snapshots' trees differ, found from the top: only below nodes that differ are nodes compared."""
    a = old.select("node", F.col("rows").alias("old_rows"), F.col("hash").alias("_a"))
    b = new.select("node", F.col("rows").alias("new_rows"), F.col("hash").alias("_b"))
    above = None
    for level in range(levels + 1):
        x, y = (t.where(F.length("node") == level) for t in (a, b))
        if above is not None:
            under = above.select(F.col("node").alias("_p"))
            x, y = (t.join(under, F.substring("node", 1, level - 1) == F.col("_p"), "left_semi") for t in (x, y))
        both = x.join(y, "node", "full")
        above = both.where(~F.col("old_rows").eqNullSafe(F.col("new_rows")) | ~F.col("_a").eqNullSafe(F.col("_b")))
    return above.select("node", F.coalesce("old_rows", F.lit(0)).alias("old_rows"), F.coalesce("new_rows", F.lit(0)).alias("new_rows"))


def changed_keys(old: DataFrame, new: DataFrame, ranges: DataFrame, key: str = "id", levels: int = 3) -> DataFrame:
    """(key, change) of rows that were added, removed or changed, looked for in the leaves (node) that differ. Keys are unique in each snapshot."""

    def within(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col(key), row_hash(df).alias(name), F.substring(F.md5(F.col(key).cast("string")), 1, levels).alias("node"))
        return rows.join(ranges.select("node"), "node", "left_semi").drop("node")

    both = within(old, "_a").join(within(new, "_b"), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def content_changed(old: DataFrame, new: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Rows, without volatile columns, that one side has more often than the other: (columns, n), n above 0 for new ones."""
    names = [c for c in new.columns if c not in ignore]
    both = old.select(*names, F.lit(-1).alias("_d")).unionByName(new.select(*names, F.lit(1).alias("_d")))
    return both.groupBy(*names).agg(F.sum("_d").alias("n")).where("n <> 0")


def window_violations(df: DataFrame, start: str, end: str, season: int, version: str) -> DataFrame:
    """Rows of a date window, hand-written ones aside, that carry another season or patch."""
    day = F.substring("publishedAt", 1, 10)
    inside = df.where((day >= start) & (day < end) & (F.col("parseConfidence") != "manual"))
    return inside.where(~F.col("season").eqNullSafe(F.lit(season)) | ~F.col("patchVersion").eqNullSafe(F.lit(version)))
