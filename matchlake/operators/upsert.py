"""Batch upserts: entries are validated by joins, rejected ones keep their reason, accepted ones rewrite the table.

overrides: (id, left, right, unordered, extra), where extra tells that an entry overrides more than fuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _last(entries: DataFrame) -> DataFrame:
    """Of entries (id, …, ord) for one id the last counts."""
    names = [c for c in entries.columns if c not in ("id", "ord")]
    return entries.groupBy("id").agg(F.max_by(F.struct(*names), "ord").alias("_e")).select("id", "_e.*")


def judge_verdicts(entries: DataFrame, gaps: DataFrame, df: DataFrame, fuses: DataFrame) -> DataFrame:
    """entries (id, left, right, unordered, ord) with their reason for rejection, null if accepted."""
    known = fuses.select(F.col("id").alias("_f"))
    j = entries.join(gaps.select("id", F.lit(True).alias("_gap")), "id", "left").join(df.select("id", F.size("teams").alias("_n")), "id", "left")
    for c in ("left", "right"):
        j = j.join(F.broadcast(known.withColumnRenamed("_f", f"_{c}")), F.col(c) == F.col(f"_{c}"), "left")  # a registry has tens of rows
    bad = lambda c: F.col(c).isNotNull() & F.col(f"_{c}").isNull()
    reason = (
        F.when(F.col("_gap").isNull(), "not-in-report")
        .when(~F.col("_n").eqNullSafe(F.lit(2)), "not-two-teams")
        .when(bad("left") | bad("right"), "unknown-fuse")
        .when(F.col("unordered") & (F.col("left").isNull() | F.col("right").isNull()), "unordered-needs-both")
    )
    return j.withColumn("reason", reason).select(*entries.columns, "reason")


def apply_verdicts(overrides: DataFrame, entries: DataFrame, gaps: DataFrame, df: DataFrame, fuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, rejected). Two nulls clear: an entry of fuses alone goes, another loses its fuses."""
    judged = judge_verdicts(entries, gaps, df, fuses)
    good = _last(judged.where("reason is null").drop("reason")).select("id", F.col("left").alias("_l"), F.col("right").alias("_r"), F.col("unordered").alias("_u"), F.lit(True).alias("_new"))
    j = overrides.withColumn("_old", F.lit(True)).join(good, "id", "full_outer")
    clear = F.col("_l").isNull() & F.col("_r").isNull()
    new = F.coalesce("_new", F.lit(False))
    kept = j.where(~(new & clear & (F.col("_old").isNull() | ~F.coalesce("extra", F.lit(False)))))
    pick = lambda n, o: F.when(new, F.col(n)).otherwise(F.col(o)).alias(o)
    loose = F.when(new & ~clear, F.col("_u")).otherwise(F.coalesce("unordered", F.lit(False))).alias("unordered")
    return kept.select("id", pick("_l", "left"), pick("_r", "right"), loose, F.coalesce("extra", F.lit(False)).alias("extra")), judged.where("reason is not null")


def apply_orientation(overrides: DataFrame, assignments: DataFrame, queue: DataFrame, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overrides, rejected). assignments: (id, owner, ord); queue: (id, fuse). The owner's team gets the fuse, the other none."""
    j = assignments.join(queue.select("id", "fuse"), "id", "left").join(df.where(F.size("teams") == 2).select("id", F.lit(True).alias("_two")), "id", "left")
    ok = F.col("fuse").isNotNull() & F.col("_two").isNotNull() & F.coalesce(F.col("owner").isin(0, 1), F.lit(False))
    good = _last(j.where(ok).select("id", F.when(F.col("owner") == 0, F.col("fuse")).alias("left"), F.when(F.col("owner") == 1, F.col("fuse")).alias("right"), F.lit(False).alias("unordered"), F.lit(False).alias("extra"), "ord"))
    return overrides.join(good, "id", "left_anti").unionByName(good.select(*overrides.columns)), j.where(~ok).select(*assignments.columns)


def apply_manual_edits(manual: DataFrame, edits: DataFrame, characters: DataFrame, fuses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manual, notes). edits: (id, left, right arrays of characters, fuse_left, fuse_right, with_fuses, ord); notes: (id, note) of rejections and warnings."""
    known, fuse = characters.select(F.col("id").alias("c")), fuses.select(F.col("id").alias("f"))
    odd = edits.select("id", F.explode(F.concat("left", "right")).alias("c")).join(known, "c", "left_anti").select("id", F.lit("unknown-character").alias("note"))
    odd = odd.union(edits.where("with_fuses").select("id", F.explode(F.array("fuse_left", "fuse_right")).alias("f")).where("f is not null").join(fuse, "f", "left_anti").select("id", F.lit("unknown-fuse")))
    odd = odd.union(edits.join(manual, "id", "left_anti").select("id", F.lit("not-manual"))).union(edits.join(manual.where(F.coalesce(F.size("teams"), F.lit(0)) != 2), "id", "left_semi").select("id", F.lit("not-two-teams"))).distinct()
    good = _last(edits.join(odd.select("id").distinct(), "id", "left_anti"))
    g = good.select("id", *(F.col(c).alias(f"_{c}") for c in good.columns if c != "id"), F.lit(True).alias("_e"))
    j = manual.join(g, "id", "left")
    chars = lambda i: F.array_distinct(F.when(i == 0, F.col("_left")).otherwise(F.col("_right")))
    new = F.transform("teams", lambda t, i: t.withField("characters", chars(i)).withField("fuse", F.when(F.col("_with_fuses"), F.when(i == 0, F.col("_fuse_left")).otherwise(F.col("_fuse_right"))).otherwise(t["fuse"])))
    out = j.withColumn("teams", F.when(F.col("_e"), new).otherwise(F.col("teams"))).withColumn("todo", F.when(F.col("_e").isNull(), F.col("todo"))).select(*manual.columns)
    size = lambda c: F.size(F.array_distinct(c))
    warn = good.select("id", F.explode(F.array_compact(F.array(*(F.when(size(c) == 0, f"{c}-empty").when(size(c) % 2 == 1, f"{c}-odd") for c in ("left", "right"))))).alias("note"))
    return out, odd.union(warn)


def log_attempts(log: DataFrame, ids: DataFrame, day: str) -> DataFrame:
    """The log (id, days) with today for these ids, once a day."""
    rows = log.select("id", F.explode("days").alias("d")).union(ids.select("id", F.lit(day).alias("d")))
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("d")).alias("days"))
