"""Numbers of rows in an order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.checkpoints import cut


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df with _n, each row's number from 0 in this order, which should be total: rows are ranged into sorted pieces, and a piece starts where those before it end."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    pieces = cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumns({"_piece": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = pieces.groupBy("_piece").agg(F.count("*").alias("_size"))  # a row a piece
    starts = sizes.select("_piece", (F.sum("_size").over(Window.orderBy("_piece")) - F.col("_size")).alias("_start"))
    return pieces.join(F.broadcast(starts), "_piece").withColumn("_n", F.col("_start") + F.col("_at")).drop("_piece", "_at", "_start")


def numbered_within(df: DataFrame, key: str, *order: str) -> DataFrame:
    """df with _k, each row's number from 1 within its key."""
    rows = numbered(df, key, *order)
    first = rows.groupBy(key).agg(F.min("_n").alias("_first"))
    return rows.join(first, key).withColumn("_k", F.col("_n") - F.col("_first") + 1).drop("_n", "_first")
