"""Statistics kept up to date by counters of days: a run counts the records that changed, takes off what they counted before, and rewrites only the
buckets of their days.

counters: (day, name, k1, k2, n), the statistics of `stats.contract_stats` a day. They add up: over days to the statistics,
over runs to the state. A counter that comes to 0 goes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.operators import stats
from matchlake.sources import versions

KEY = ["day", "name", "k1", "k2"]


def counters(df: DataFrame, day: str = "publishedAt") -> DataFrame:
    rows = df.select(F.substring(day, 1, 10).alias("day"), F.explode(stats.raised()).alias("k"))
    return rows.groupBy("day", F.col("k.name").alias("name"), F.col("k.k1").alias("k1"), F.col("k.k2").alias("k2")).agg(F.count("*").alias("n"))


def added(*parts: DataFrame) -> DataFrame:
    """Counters of all parts together."""
    summed = reduce(DataFrame.unionByName, parts).groupBy(*KEY).agg(F.sum("n").alias("n"))
    return summed.where("n <> 0")


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """What changed records add to the counters: before and after hold these records alone, as they were and as they are. One that is new is missing before,
    one that was excluded is missing after; one whose day or season moved leaves the old counters and enters the new ones."""
    return added(counters(after), counters(before).withColumn("n", -F.col("n")))


def start(df: DataFrame, path: str, buckets: int = versions.BUCKETS) -> int:
    """Counters of all records, as a table in versions."""
    return versions.create(counters(df), path, ["day"], buckets)


def apply(spark: SparkSession, path: str, batch: str, change: DataFrame) -> int:
    """The version with a delta added; a batch counts once however often it is applied."""
    return versions.upsert(spark, path, batch, change, added)


def totals(state: DataFrame) -> DataFrame:
    """(name, k1, k2, n) of all days in state."""
    return state.groupBy("name", "k1", "k2").agg(F.sum("n").alias("n"))
