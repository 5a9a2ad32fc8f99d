"""An index of facets: records are numbered and kept by blocks of numbers; facets of few values (channel, patch, fuse, character) have a bitmap
a value and block, those of many (player, name) the places in the block. A question is answered on the index first, by union
within a facet and intersection across facets, and then reads the blocks that hold an answer.

It gives what `query.browse` gives over the same records. Nulls stand under no value; rows that repeat have numbers of
their own, so each is given back; an empty table has an empty index.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.functions import text as X
from matchlake.operators import numbering

#: Numbers of a block, as Spark's bitmaps have it.
BLOCK = 32_768
_BITMAPS = "side int, value string, _block long, bits binary, facet string"
_PLACES = "value string, _block long, at array<int>, facet string"


def _values(facet: str, values: Column, side: Column | None = None) -> Column:
    kind = "array<struct<facet:string,side:int,value:string>>"
    named = F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), (F.lit(None) if side is None else side).cast("int").alias("side"), v.cast("string").alias("value")))
    return F.coalesce(named.cast(kind), F.array().cast(kind))


def _posted(rows: DataFrame, *values: Column) -> DataFrame:
    long = rows.select("_block", F.bitmap_bit_position("_num").alias("_at"), F.inline(F.concat(*values)))
    return long.where("value is not null")


def build(df: DataFrame, folder: str, order: tuple[str, ...] = ("publishedAt", "id")) -> None:
    """Keeps records and their index in a new folder; numbers follow the order, so what is asked together should lie together in it."""
    spark = df.sparkSession
    rows = numbering.numbered(df, *order).withColumn("_num", F.col("_n") + 1).drop("_n")
    rows.withColumn("_block", F.bitmap_bucket_number("_num")).write.partitionBy("_block").parquet(f"{folder}/records")
    spark.createDataFrame([(df.schema.json(),)], "columns string").coalesce(1).write.json(f"{folder}/columns")
    kept = _records(spark, folder)
    sides = F.flatten(F.transform("teams", lambda t, k: _values("side", t["characters"], k)))
    few = _posted(
        kept,
        _values("channel", F.array("channel")),
        _values("patch", F.array(X.era_key(F.col("season")), F.col("patchVersion"))),
        _values("fuse", F.col("teams")["fuse"]),
        _values("character", F.col("allCharacters")),
        F.coalesce(sides, F.array().cast("array<struct<facet:string,side:int,value:string>>")),
    )
    bitmaps = few.groupBy("facet", "side", "value", "_block").agg(F.bitmap_construct_agg("_at").alias("bits"))
    bitmaps.sortWithinPartitions("facet", "value").write.partitionBy("facet").parquet(f"{folder}/bitmaps")
    many = _posted(kept, _values("player", F.col("allPlayers")), _values("name", F.transform(F.flatten(F.col("teams")["players"]), lambda p: F.lower(p["displayName"]))))
    places = many.groupBy("facet", "value", "_block").agg(F.collect_set(F.col("_at").cast("int")).alias("at"))  # a block's numbers at most
    places.sortWithinPartitions("facet", "value").write.partitionBy("facet").parquet(f"{folder}/places")


def _records(spark: SparkSession, folder: str) -> DataFrame:
    columns = spark.read.schema("columns string").json(f"{folder}/columns").first()[0]
    schema = T.StructType.fromJson(json.loads(columns)).add("_num", "long").add("_block", "long")
    return spark.read.schema(schema).parquet(f"{folder}/records")


def _either(found: DataFrame) -> DataFrame:
    return found.groupBy("_block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _all(found: DataFrame, n: int, *by: str) -> DataFrame:
    """The intersection of n bitmaps a block, where all are there."""
    return found.groupBy("_block", *by).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_have")).where(F.col("_have") == n).drop("_have")


def _numbers(found: DataFrame) -> DataFrame:
    """(_block, _num) of the bits that are set."""
    octets = found.select("_block", F.posexplode(F.regexp_extract_all(F.hex("bits"), F.lit(".."), F.lit(0))).alias("k", "octet")).where("octet <> '00'")
    bits = octets.select("_block", "k", F.conv("octet", 16, 10).cast("int").alias("v")).select("_block", "k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.getbit("v", i) == 1)).alias("i"))
    return bits.select("_block", ((F.col("_block") - 1) * BLOCK + F.col("k") * 8 + F.col("i") + 1).alias("_num"))


def browse(spark: SparkSession, folder: str, sources: list[str] | None = None, groups: dict | None = None, patches: list[str] | None = None, fuses: list[str] | None = None, chars: list[str] | None = None, same_side: bool = False, players: list[str] | None = None, q: str | None = None) -> DataFrame:
    """Records that fit all that is asked for, as `query.browse` takes it."""
    bitmaps = spark.read.schema(_BITMAPS).parquet(f"{folder}/bitmaps")
    places = spark.read.schema(_PLACES).parquet(f"{folder}/places")
    valued = lambda facet, values: bitmaps.where((F.col("facet") == facet) & F.col("value").isin(values))

    def placed(facet: str, fits: Column) -> DataFrame:
        at = places.where((F.col("facet") == facet) & fits).select("_block", F.explode("at").alias("_at"))
        return at.groupBy("_block").agg(F.bitmap_construct_agg(F.col("_at").cast("long")).alias("bits"))

    found = []
    if sources:
        found.append(_either(valued("channel", [c for i in sources for c in (groups or {}).get(i, [i])])))
    if patches:
        found.append(_either(valued("patch", patches)))
    if fuses:
        found.append(_either(valued("fuse", fuses)))
    if chars:
        wanted = sorted(set(chars))
        found.append(_either(_all(valued("side", wanted), len(wanted), "side")) if same_side else _all(valued("character", wanted), len(wanted)))
    if players:
        found.append(placed("player", F.col("value").isin(players)))
    found += [placed("name", F.contains("value", F.lit(token))) for token in (q or "").lower().split()]
    records = _records(spark, folder)
    if found:
        hits = _all(reduce(DataFrame.unionByName, (x.select("_block", "bits") for x in found)), len(found))
        records = records.join(_numbers(hits), ["_block", "_num"], "left_semi")
    return records.drop("_block", "_num")
