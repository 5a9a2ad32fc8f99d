"""Balanced shards by label propagation under capacity quotas.

Documents that share a link (a hub, here the hash of the text) belong together. They start in hashed shards; in each round
a hub's documents move to the shard that holds most of them (those of a hub beyond a shard's share, to as many as it
fills), as far as that shard's quota allows. Unlinked documents fill the shards up, and what exceeds a quota at the end
moves to where there is room, unlinked ones first, then those of big hubs, so that counts differ by one at most.

Tallies are by (hub, shard), so a hub costs as many rows as there are shards. Hubs with over n / 1024 documents, of which
there are fewer than 1024, are joined by broadcast; all others have few rows a key. Places within shards come from counts
of hashed pieces, so no task numbers a whole shard.

Cases: a null text has size 1 and the checksum of an empty one; repeated rows are documents of their own with the same
link; a hub beyond a shard's quota fills several; fewer documents than shards leave shards empty; an empty table gives an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut
from matchlake.operators.numbering import numbered_within

ROUNDS = 3
#: Hubs with more than this share of the documents are joined by broadcast.
HOT = 1024
#: Hubs with more than this share of a shard move document by document, and give way to smaller ones.
BIG = 8
#: Pieces that a shard's documents are numbered in.
PIECES = 2048


def lookup(values: dict[int, int | float], key: Column) -> Column:
    """The value of a shard, from a literal of one value a shard."""
    return F.element_at(F.array(*(F.lit(values[k]) for k in sorted(values))), key.cast("int") + 1)


def chance(*by: Column | str) -> Column:
    """A number in [0, 1) that hangs on these values alone."""
    return F.pmod(F.xxhash64(*by), F.lit(1 << 30)) / float(1 << 30)


def per_shard(df: DataFrame, shards: int) -> dict[int, int]:
    """Rows of each shard: so many numbers to the driver."""
    return dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in df.groupBy("shard").count().collect()}


def with_hub(rows: DataFrame, hubs: DataFrame, n: int, *columns: str) -> DataFrame:
    """rows left-joined to columns of hubs (hub, members, ...)."""
    hot = hubs.where(F.col("members") > n / HOT).select(F.col("hub").alias("_hot"), *(F.col(c).alias(f"_hot_{c}") for c in columns))
    cold = hubs.where(F.col("members") <= n / HOT).select(F.col("hub").alias("_cold"), *(F.col(c).alias(f"_cold_{c}") for c in columns))
    out = rows.join(F.broadcast(hot), rows["hub"] == hot["_hot"], "left")
    key = F.when(F.col("_hot").isNull(), F.col("hub")).otherwise(F.xxhash64("place", F.lit(1)))  # hot rows are spread
    out = out.withColumn("_key", key).join(cold, F.col("_key") == F.col("_cold"), "left")
    made = [F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{c}")).otherwise(F.col(f"_cold_{c}")).alias(c) for c in columns]
    return out.select(*rows.columns, *made)


def propagated(linked: DataFrame, n: int, quota: dict[int, int], rounds: int) -> DataFrame:
    """linked (…, hub, place, shard) with the shards after so many rounds."""
    shards = len(quota)
    for k in range(0 if linked.isEmpty() else rounds):
        tally = linked.groupBy("hub", "shard").agg(F.count("*").alias("here"))
        ranked = F.sort_array(F.collect_list(F.struct("here", (-F.col("shard")).alias("shard"))), asc=False)  # a shard each at most
        wanted = tally.groupBy("hub").agg(F.sum("here").alias("members"), ranked.alias("tops"))
        # a hub beyond one shard's share aims at as many as it fills, its largest ones
        wanted = wanted.withColumn("tops", F.transform(F.slice("tops", F.lit(1), F.ceil(F.col("members") * shards / max(1, sum(quota.values()))).cast("int")), lambda t: -t["shard"]))
        voted = with_hub(linked, wanted, n, "tops", "members")
        spread = F.get("tops", F.pmod(F.xxhash64("place", F.lit(3)), F.size("tops")).cast("int"))
        voted = voted.withColumn("wish", F.when(F.array_contains("tops", F.col("shard")), F.col("shard")).otherwise(spread))
        moving = F.col("wish") != F.col("shard")
        held = per_shard(linked, shards)
        asked = dict.fromkeys(range(shards), 0) | {r[0]: r[1] for r in voted.where(moving).groupBy("wish").count().collect()}
        room = {s: min(1.0, max(0, quota[s] - held[s]) / max(1, asked[s])) for s in range(shards)}
        # whole hubs move, but for big ones
        draw = F.when(F.col("members") > n / (BIG * shards), chance("place", F.lit(k))).otherwise(chance("hub", F.lit(k)))
        shard = F.when(moving & (draw < lookup(room, F.col("wish"))), F.col("wish")).otherwise(F.col("shard"))
        linked = cut(voted.withColumn("shard", shard).select(*linked.columns))
    return linked


def numbered(rows: DataFrame) -> DataFrame:
    """rows with slot: their place within their shard, by kind (small hubs', big hubs', unlinked)."""
    rows = rows.withColumn("piece", F.col("kind") * PIECES + F.pmod(F.xxhash64("place", F.lit(2)), F.lit(PIECES)))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("shard", "piece").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "piece").orderBy("place")
    return rows.withColumn("_n", F.row_number().over(within)).join(pieces, ["shard", "piece"]).withColumn("slot", F.col("offset") + F.col("_n") - 1).drop("_n", "offset", "piece")


def filled(rows: DataFrame, quota: dict[int, int]) -> DataFrame:
    """numbered rows, with those beyond their shard's quota moved to where there is room."""
    held = per_shard(rows, len(quota))
    over, free, gaps = {}, 0, []
    for s in sorted(quota):
        over[s] = sum(max(0, held[t] - quota[t]) for t in range(s))
        if held[s] < quota[s]:
            gaps.append((s, free, held[s]))
            free += quota[s] - held[s]
    surplus = F.col("slot") - lookup(quota, F.col("shard"))
    turn = lookup(over, F.col("shard")) + surplus
    to = reduce(lambda c, g: F.when(turn >= g[1], F.struct(F.lit(g[0]).alias("shard"), (turn - g[1] + g[2]).alias("slot"))).otherwise(c), gaps, F.struct(F.col("shard"), F.col("slot")))
    at = F.when(surplus >= 0, to).otherwise(F.struct("shard", "slot"))
    return rows.withColumn("_at", at).withColumn("shard", F.col("_at.shard")).withColumn("slot", F.col("_at.slot").cast("bigint")).drop("_at")


def read_order(docs: DataFrame) -> Column | None:
    """Where a row stands in the files that docs are read from, which were written in order; None if docs are no files."""
    order = F.struct("_metadata.file_name", "_metadata.row_index")
    try:
        docs.select(order)
    except AnalysisException:
        return None
    return order


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, order: Column | None = None) -> DataFrame:
    """id, size, text_crc32, shard and slot of each row: counts of shards differ by one at most, and equal texts lie together as far as these quotas allow.
    With an order, the slots of each shard follow it."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    turn = [] if order is None else [order.alias("turn")]
    rows = docs.select(F.col(id_col), *turn, (F.length(raw) + 1).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("hub"))
    rows = cut(rows.withColumn("place", F.xxhash64(id_col, "hub")).withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")))
    n = rows.count()
    quota = {s: n // shards + (s < n % shards) for s in range(shards)}
    shared = rows.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1")
    kind = F.when(F.col("members").isNull(), 2).when(F.col("members") > n / (BIG * shards), 1).otherwise(0)
    rows = cut(with_hub(rows, shared, n, "members").withColumn("kind", kind).drop("members"))
    small = propagated(rows.where("kind = 0"), n, quota, rounds)
    taken = per_shard(small, shards)
    big = propagated(rows.where("kind = 1"), n, {s: max(0, quota[s] - taken[s]) for s in quota}, rounds)
    placed = cut(numbered(small.unionByName(big).unionByName(rows.where("kind = 2"))))
    out = filled(placed, quota)
    if turn:
        out = numbered_within(out.drop("slot"), "shard", "turn", "place").withColumn("slot", F.col("_k") - 1)
    return out.select(id_col, "size", "text_crc32", "shard", "slot")
