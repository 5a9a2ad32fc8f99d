"""Tables in versions: rows lie in buckets by a hash of some columns, and a version names the folder of each bucket.

A batch rewrites the buckets that its changes fall into and adds a version: files of other buckets stay as they are, and
older versions stay readable. Rows become visible with the manifest, which is written last, and a batch that the table
has is not applied again, so a job that was lost midway is run again as it is. One writer at a time. The number of
buckets is fixed when a table is made; a manifest has a row a bucket. Nulls are a key like others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchlake.operators.checkpoints import cut

BUCKETS = 64
#: Tasks that write a bucket.
PIECES = 8
_MANIFEST = "batch string, keys array<string>, columns string, bucket int, folder string, version int"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def history(spark: SparkSession, path: str) -> DataFrame:
    """(version, batch, bucket, folder, …): a row a bucket and version."""
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests")


def _version(spark: SparkSession, path: str, version: int | None) -> list[Row]:
    rows = history(spark, path)
    if version is None:
        version = rows.agg(F.max("version")).first()[0]
    return rows.where(F.col("version") == version).collect()


def _rows(spark: SparkSession, columns: str, folders: list[str]) -> DataFrame:
    schema = T.StructType.fromJson(json.loads(columns))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(df: DataFrame, path: str, keys: list[str], buckets: int) -> dict[int, str]:
    """The folder of each bucket that has rows."""
    folder = f"{path}/rows/{uuid.uuid4().hex}"
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]
    piece = F.pmod(F.xxhash64(*hashed), F.lit(PIECES))
    df.withColumn("_bucket", _bucket(keys, buckets)).repartition("_bucket", piece).write.partitionBy("_bucket").parquet(folder)
    found = df.sparkSession.read.schema("_bucket int").parquet(folder).distinct().collect()
    return {r[0]: f"{folder}/_bucket={r[0]}" for r in found}


def _publish(spark: SparkSession, path: str, version: int, batch: str, keys: list[str], columns: str, folders: dict[int, str | None]) -> int:
    rows = [(batch, keys, columns, b, f) for b, f in sorted(folders.items())]
    made = spark.createDataFrame(rows, "batch string, keys array<string>, columns string, bucket int, folder string")
    made.coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/version={version}")
    return version


def create(df: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS, batch: str = "create") -> int:
    """A new table at path, as its version 0; rows with the same keys share a bucket."""
    written = _write(df, path, keys, buckets)
    return _publish(df.sparkSession, path, 0, batch, keys, df.schema.json(), {b: written.get(b) for b in range(buckets)})


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the last if none is given."""
    rows = _version(spark, path, version)
    return _rows(spark, rows[0].columns, [r.folder for r in rows if r.folder])


def upsert(spark: SparkSession, path: str, batch: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> int:
    """The version with the batch applied. merge makes the new rows of the touched buckets of their old ones and the changes, which have the table's keys;
    it must keep each row's keys."""
    done = history(spark, path).where(F.col("batch") == batch).agg(F.max("version")).first()[0]
    if done is not None:
        return done
    last = _version(spark, path, None)
    keys, columns = last[0]["keys"], last[0]["columns"]
    placed = cut(changes.withColumn("_bucket", _bucket(keys, len(last))))
    touched = {r[0] for r in placed.select("_bucket").distinct().collect()}
    old = _rows(spark, columns, [r.folder for r in last if r.folder and r.bucket in touched])
    new = merge(old, placed.drop("_bucket")).select(*old.columns)
    written = _write(new, path, keys, len(last)) if touched else {}
    folders = {r.bucket: written.get(r.bucket) if r.bucket in touched else r.folder for r in last}
    return _publish(spark, path, last[0].version + 1, batch, keys, columns, folders)
