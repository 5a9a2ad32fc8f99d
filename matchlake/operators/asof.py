"""The last start at or before each row, by a sweep over both in one order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchlake.operators.checkpoints import cut


def as_of(df: DataFrame, key: str, starts: DataFrame, start: str, out: str = "_at") -> DataFrame:
    """df with `out`, the row of starts (a struct) with the greatest start not above df's key, null where there is none. Starts are distinct.

    Both are ranged into pieces by key, starts before rows of their key; rows of one key may span pieces. A piece's rows take the last start
    before them in it, or else what the pieces before it end with, which is a row a piece. Nothing of the size of either side is broadcast."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    row, of = F.struct(*(df[c] for c in df.columns)), F.struct(*starts.columns)
    rows = df.select(F.col(key).alias("_k"), F.lit(1).alias("_kind"), F.xxhash64(key, F.monotonically_increasing_id()).alias("_tie"), row.alias("_r"))
    own = starts.where(F.col(start).isNotNull()).select(F.col(start).alias("_k"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_tie"), of.alias("_s"))
    both = own.unionByName(rows, allowMissingColumns=True).repartitionByRange(width, "_k", "_kind", "_tie")
    pieces = cut(both.withColumn("_piece", F.spark_partition_id()))
    ends = pieces.where("_kind = 0").groupBy("_piece").agg(F.max_by("_s", "_k").alias("_e"))  # a row a piece
    every = pieces.select("_piece").distinct().join(ends, "_piece", "left")
    carried = every.select("_piece", F.last("_e", ignorenulls=True).over(Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    so_far = Window.partitionBy("_piece").orderBy("_k", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = pieces.withColumn("_last", F.last("_s", ignorenulls=True).over(so_far)).where("_kind = 1")
    return swept.join(carried, "_piece", "left").select("_r.*", F.coalesce("_last", "_before").alias(out))
