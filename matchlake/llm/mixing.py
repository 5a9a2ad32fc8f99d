"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight and a share of the words to take; no source gives more than twice its size, and what that leaves
over is dealt out anew by weight (water-filling: the level rises until no further source is full). A source's documents are
laid end to end in hashed order, repeatedly if the target asks for more than once, and the mix takes the words below the
target. A source's weight changes over the training, linearly in time. The integral of its schedule is its demand up to a
time; inverted, it gives each document the time at which its source's demand reaches it, and the demand of all sources up
to that time is its position: the word of the training that it begins at. Documents are range-sorted by position.

Cases: a null text has size 0 and is never taken; a null source is the last source; equal rows lie side by side and
differ in what is taken only where the target ends; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.common import cut, words
from matchlake.operators.numbering import numbered

#: Weights of the sources in order, repeated; and by how much each weight rises (or falls) from the training's start to its end, relative to its mean.
WEIGHTS, SLOPES = (3, 1, 2), (0.0, 1.0, -1.0)
#: Words to take, as a share of all; times that a source is used at most.
SHARE, EPOCHS = 1.5, 2
#: Leading hex digits of the hash that deal a source out over 16^3 pieces, so that prefix sums need no task with a whole source.
PIECE_DIGITS = 3


def cyclic(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(no_source, source, source_size, slope, target) from sizes by source."""
    ranked = numbered(sizes, "no_source", "source").withColumn("weight", cyclic(weights, F.col("_n")))
    ranked = cut(ranked.select("no_source", "source", "source_size", "weight", cyclic(SLOPES, F.col("_n")).alias("slope")))
    total, level, full = ranked.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:  # sources that are full at this level give twice their size, and the rest shares what is left; the level only rises
        is_full = F.lit(epochs) * F.col("source_size") <= F.lit(level) * F.col("weight")
        capped, n, heft = ranked.agg(F.sum(F.when(is_full, epochs * F.col("source_size"))), F.count(F.when(is_full, 1)), F.sum(F.when(~is_full, F.col("weight")))).first()
        if n == full or not heft:
            break
        level, full = (share * total - (capped or 0)) / heft, n
    target = F.least((epochs * F.col("source_size")).cast("double"), F.lit(level) * F.col("weight"))
    return ranked.select("no_source", "source", "source_size", "slope", target.alias("target"))


def moment(slope: Column, share: Column) -> Column:
    """When a source whose weight runs from 1 - slope / 2 to 1 + slope / 2 (times its mean) has given this share of its target, in [0, 1]."""
    a = slope / 2
    return F.when(a == 0, share).otherwise((F.sqrt((1 - a) * (1 - a) + 4 * a * share) - (1 - a)) / (2 * F.when(a != 0, a)))


def demand(plan: DataFrame) -> Callable[[Column], Column]:
    """The words that all sources together have given at a time: two numbers to the driver."""
    whole, bend = plan.agg(F.sum(F.round("target").cast("bigint")), F.sum(F.round("target").cast("bigint") * (F.col("slope") / 2))).first()
    return lambda t: F.lit(float(whole or 0)) * t + F.lit(float(bend or 0)) * (t * t - t)


def laid(docs: DataFrame, id_col: str, text_col: str, source_col: str, rows: bool, **how) -> DataFrame:
    """id, no_source, source, size, source_size, target, taken, at (positions of each use) of each row; and _row, all its columns, if asked for."""
    text_key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_key).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col), F.lit("")).alias("source"),
        F.size(words(F.col(text_col))).cast("bigint").alias("size"),
        key.alias("key"),
        F.substring(key, 1, PIECE_DIGITS).alias("piece"),
        *([F.struct(*(docs[c] for c in docs.columns)).alias("_row")] if rows else []),
    )
    if not rows:
        sized = cut(sized)
    pieces = cut(sized.groupBy("no_source", "source", "piece").agg(F.sum("size").alias("piece_size")))
    plan = cut(targets(pieces.groupBy("no_source", "source").agg(F.sum("piece_size").alias("source_size")), **how))
    given = demand(plan)
    before = Window.partitionBy("no_source", "source").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("piece_start", F.coalesce(F.sum("piece_size").over(before), F.lit(0))).join(plan, ["no_source", "source"]).drop("piece_size")
    within = Window.partitionBy("no_source", "source", "piece").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    # the within-piece sums are the hottest source's rows over 4096 pieces; the join keeps that partitioning
    placed = sized.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(pieces, ["no_source", "source", "piece"])
    start = F.col("piece_start") + F.col("start")
    budget = F.round("target").cast("bigint")
    use = [F.greatest(F.lit(0), F.least(F.col("size"), budget - start - k * F.col("source_size"))) for k in range(EPOCHS)]
    at = [F.when(u > 0, given(moment(F.col("slope"), F.least(F.lit(1.0), (start + k * F.col("source_size")) / F.col("target"))))) for k, u in enumerate(use)]
    columns = ("id", "no_source", "source", "size", "source_size", "target", *(["_row"] if rows else []))
    return placed.select(*columns, sum(use[1:], use[0]).cast("bigint").alias("taken"), F.array(*at).alias("at"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """id, size, source_size, target, taken, position (the word of the training that its first words come as, null if none are taken), again (that of its second use) and source, sorted by position."""
    out = laid(docs, id_col, text_col, source_col, False, **how).select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        "taken",
        *(F.floor(F.get("at", F.lit(k))).alias(c) for k, c in enumerate(("position", "again"))),
        F.when(~F.col("no_source"), F.col("source")).alias(source_col),
    )
    return out.repartitionByRange("position", id_col).sortWithinPartitions("position", id_col)


def curriculum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """docs in training order: each as often as the mix uses it, range-sorted by position; those that it doesn't use go."""
    used = laid(docs, id_col, text_col, source_col, True, **how).select("_row", "id", F.explode(F.array_compact("at")).alias("_at"))
    return used.repartitionByRange("_at", "id").sortWithinPartitions("_at", "id").select("_row.*")
