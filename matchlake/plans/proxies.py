"""Match records and their layers, derived from the given tables; and the same views in SQL.

A record is an order with line items on both sides (line number odd or even); a side's players are its suppliers, its
characters the brands, its fuse the first type unless a line was returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchlake.functions import text as X
from matchlake.operators import periods

BRAND = "ARENA"
SEASON_ROWS = [(0, "1996-01-01", "1998-01-01", None), (1, "1998-01-01", None, None)]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seasons(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEASON_ROWS, periods.SEASONS)


def day(c: str = "o_orderdate"):
    return F.date_format(c, "yyyy-MM-dd")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """A patch starts with the first order of a quarter from 1996."""
    o = table(spark, sf, "orders").where("o_orderdate >= '1996-01-01'")
    version = F.concat_ws(".", F.year("o_orderdate"), F.quarter("o_orderdate"))
    starts = o.groupBy(version.alias("version")).agg(F.min(day()).alias("start"))
    return starts.select("version", "start", F.lit(None).cast("array<string>").alias("includes"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("todo"))


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return periods.patch_windows(patches(spark, sf), seasons(spark))


def team_long(spark: SparkSession, sf: str) -> DataFrame:
    """One row a line item: video, side, player, chr, p_type, l_returnflag."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_linenumber") % 2).alias("side"), "l_returnflag")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    return li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").alias("video"), "side", F.col("s_name").alias("player"), F.col("p_brand").alias("chr"), "p_type", "l_returnflag")


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with line items on both sides: each side's players, characters and fuse in columns of their own, so that those a query doesn't use are not carried. A record's lines meet once."""
    lines = team_long(spark, sf).repartition("video")
    own = lambda k, c: F.when(F.col("side") == k, F.col(c))
    names = lambda k, c: F.array_sort(F.collect_set(own(k, c)))
    columns = [x for k in (0, 1) for x in (names(k, "player").alias(f"players{k}"), names(k, "chr").alias(f"characters{k}"), F.when(F.min(own(k, "l_returnflag")) != "A", F.min(own(k, "p_type"))).alias(f"fuse{k}"))]
    both = lines.groupBy("video").agg(F.count_if(F.col("side") == 0).alias("lines0"), F.count_if(F.col("side") == 1).alias("lines1"), *columns).where("lines0 > 0 and lines1 > 0")
    o = table(spark, sf, "orders")
    return both.join(o, F.col("video") == F.col("o_orderkey"))


def teams() -> Column:
    """The two teams of a row of sides, left first."""
    team = lambda k, side: F.struct(F.lit(side).alias("side"), F.transform(f"players{k}", lambda p: F.struct(p.alias("id"), p.alias("displayName"))).alias("players"), F.col(f"characters{k}").alias("characters"), F.col(f"fuse{k}").alias("fuse"))
    return F.array(team(0, "left"), team(1, "right"))


def bare_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records without season and patch."""
    return sides(spark, sf).withColumn("teams", teams()).select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.col("o_orderpriority").alias("channel"),
        day().alias("publishedAt"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("durationSec"),
        F.col("o_custkey").alias("viewCount"),
        F.col("o_orderstatus").alias("st"),
        "teams",
        F.array_distinct(F.flatten(F.transform("teams", lambda x: x["characters"]))).alias("allCharacters"),
        F.array_distinct(F.flatten(F.transform("teams", lambda x: x["players"]["id"]))).alias("allPlayers"),
        F.lit(False).alias("fusesUnordered"),
        F.concat(F.lit("match "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("thumbnail"),
        F.when(F.col("o_orderstatus") == "F", F.lit("12th May 2026")).alias("patch"),
        F.when(F.col("o_orderstatus") == "P", "low").otherwise("high").alias("parseConfidence"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    return periods.with_patch(periods.with_season(bare_records(spark, sf), seasons(spark)).drop("season_start"), windows(spark, sf))


def detections(df: DataFrame) -> DataFrame:
    """id, left, right, status by the record's state; every seventh has none."""
    fuse = lambda k: F.get("teams", F.lit(k))["fuse"]
    status = F.when(F.col("st") == "F", "ok").when(F.col("st") == "O", "ok-unordered").otherwise("low")
    return df.where(F.col("id").cast("bigint") % 7 != 0).select("id", fuse(1).alias("left"), fuse(0).alias("right"), status.alias("status"))


def overrides(df: DataFrame) -> DataFrame:
    """id, patch: every fiftieth names a season, another also nulls it, another is excluded, another views."""
    n = F.col("id").cast("bigint")
    m = lambda *kv: F.create_map(*(F.lit(x).cast("string") for x in kv))
    patch = F.when(n % 50 == 1, m("season", 1)).when(n % 50 == 2, m("season", None)).when(n % 50 == 3, m("exclude", "true", "season", 0)).when(n % 50 == 4, m("viewCount", 7))
    return df.select("id", patch.alias("patch")).where("patch is not null")


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """Raw rows whose titles are put together from records, in several styles, some off shape."""
    n = F.col("o_orderkey")
    text = lambda k, sep: F.concat(F.array_join(f"players{k}", " + "), F.lit(" ("), F.array_join(f"characters{k}", sep), F.lit(")"))
    lead = F.when(n % 11 == 0, f"NEW PATCH {BRAND} ▰ ").when(n % 11 == 1, f"  {BRAND}  ▰   Rank 1 NA ").otherwise(f"{BRAND} ▰ ")
    tail = F.when(n % 5 == 0, " ▰ Grand Finals").when(n % 5 == 1, " ▰ Top 8 semi-finals").otherwise(" ▰ High Level")
    core = F.when(n % 17 == 0, F.concat(text(0, "-"), F.lit(" beats "), text(1, "-"))).otherwise(F.concat(text(0, "-"), F.lit(" vs "), text(1, " / ")))
    label = F.when(n % 4 == 0, F.concat(F.lit("(Season "), n % 3, F.lit(")\nPatch: 31st feb 1999"))).when(n % 4 == 1, F.concat(F.lit("Season "), n % 2)).otherwise("no label")
    return sides(spark, sf).select(
        n.cast("string").alias("id"),
        n.alias("ord"),
        F.col("o_orderpriority").alias("channel"),
        F.concat(lead, core, tail).alias("title"),
        label.alias("description"),
        day().alias("publishedAt"),
        F.lit(None).cast("string").alias("thumbnail"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("durationSec"),
        F.col("o_custkey").alias("viewCount"),
        teams().alias("teams"),
    )


def copies(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as recordings: the sides are named by language, words, lines and vowels of the whole text, the duration is the length."""
    from matchlake.operators import dupes

    d = table(spark, sf, "documents")
    n = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    words = F.floor(F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))) / 10)
    vowels = F.floor((F.length(text) - F.length(F.regexp_replace(text, "[aeiou]+", ""))) / 25)
    side = lambda player, character: F.struct(F.array(F.struct(F.lit("none").alias("id"), player.alias("displayName"))).alias("players"), F.array(character).alias("characters"))
    teams = F.array(side(F.coalesce("lang", F.lit("none")), F.concat(F.lit("w"), words)), side(F.concat(F.lit("l"), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))), F.concat(F.lit("v"), vowels)))
    return d.select(
        F.lpad(n.cast("string"), 12, "0").alias("id"),
        dupes.signature(teams).alias("sig"),
        F.col("n_chars").cast("int").alias("durationSec"),
        (F.regexp_extract("source", "([0-9]+)", 1).cast("int") % 3).cast("string").alias("channel"),
        F.lpad((n * 7919 % 1000).cast("string"), 4, "0").alias("publishedAt"),
        (n % 41 == 0).alias("has_override"),
        (n % 3 == 0).alias("has_fuse"),
    )


def copy_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """A 56-bit hash of each vector, taken as that of the document of its number; others have none."""
    from matchlake.functions import pixels as P

    e = table(spark, sf, "embeddings")
    return e.select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("id"), P.gradient_hash(F.col("embedding"), 8, 8).alias("dhash"))


def handles(spark: SparkSession, sf: str) -> DataFrame:
    """Handles made of part names, plain and in variants: id, handle, featured."""
    p = table(spark, sf, "part").select("p_name").distinct()
    a = F.initcap("p_name")
    kinds = F.array(
        F.struct(F.lit("0").alias("k"), a.alias("handle")),
        F.struct(F.lit("1").alias("k"), F.concat(F.lit("TEAM "), F.regexp_replace(a, " ", "")).alias("handle")),
        F.struct(F.lit("2").alias("k"), F.regexp_replace(F.regexp_replace(F.lower(a), "e", "3"), " ", "").alias("handle")),
        F.struct(F.lit("3").alias("k"), F.concat(F.regexp_replace(a, " ", ""), F.lit("22")).alias("handle")),
        F.struct(F.lit("4").alias("k"), F.concat(F.substring(F.regexp_replace(a, " ", ""), 1, 2), F.substr(F.regexp_replace(a, " ", ""), F.lit(4))).alias("handle")),
        F.struct(F.lit("5").alias("k"), F.concat(F.substring(a, 1, 1), F.lit(". "), F.regexp_extract(a, r" (\S+)$", 1)).alias("handle")),
    )
    return p.select("p_name", F.explode(kinds).alias("x")).select(F.concat_ws("~", "p_name", "x.k").alias("id"), "x.handle", (F.col("x.k") == "0").alias("featured"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as measurements: a user's day is a frame, an event a reading of one of two sides."""
    e = table(spark, sf, "events")
    n = F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("video"),
        F.when(F.expr("event_id div 2") % 2 == 0, "left").otherwise("right").alias("side"),
        F.date_format("ts", "yyyy-MM-dd").alias("frame"),
        (n % 4).cast("double").alias("dy"),
        F.when(n % 13 == 0, "__hbar").otherwise(F.col("event_type")).alias("class"),
        # three places as SQL rounds them, by the product; round(x, 3) goes by x in decimal, and differs at fives
        (F.round(F.least(F.lit(1.0), F.abs(F.col("value")) / 100) * 1000) / 1000).alias("share"),
        ((n * 31 % 97) / 100.0).alias("sat"),
        (n * 17 % 40).cast("double").alias("struct"),
    )
    # one row a class of a crop, and one saturation a crop
    return rows.groupBy("video", "side", "frame", "dy", "class").agg(F.max("share").alias("share"), F.min("struct").alias("struct"), F.max("sat").alias("_s")).withColumn("sat_frac", F.expr("max(_s) over (partition by video, side, frame, dy)")).drop("_s")


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("video"), (F.col("l_quantity") / 50).alias("r"), F.least(F.lit(1.0), F.col("l_discount") * 10).alias("g"), F.least(F.lit(1.0), F.col("l_tax") * 12.5).alias("b"))


def flat(df: DataFrame) -> DataFrame:
    """A record in flat columns."""
    t = lambda k: F.get("teams", F.lit(k))
    return df.select("id", "season", "patchVersion", "viewCount", t(0)["fuse"].alias("lf"), t(1)["fuse"].alias("rf"), "fusesUnordered")


era = X.era_key
