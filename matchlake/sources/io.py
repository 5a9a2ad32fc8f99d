"""Readers and writers of dumps, registries, layers and reports. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchlake.functions import text as X
from matchlake.sources.keyed import RANGE, keyed_entries

RAW = "id string, title string, description string, publishedAt string, thumbnail string, durationSec int, viewCount bigint"
DUMP = "id string, snippet struct<title:string,description:string,publishedAt:string,thumbnails:map<string,struct<url:string>>>, contentDetails struct<duration:string>, statistics struct<viewCount:string>"
CHARACTERS = "id string, name string, extra struct<aliases:array<string>>"
PLAYERS = "id string, handle string, featured boolean, extra struct<aliases:array<string>>"
FUSE = "id string, name string, aliases array<string>, active boolean, accent string"


def _array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of a JSON array, parsed one by one as the file is read, with their order in it; a malformed file fails."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.monotonically_increasing_id().alias("ord"), "*")


def read_raw(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Dumps of several channels (channel to path), in that order: channel, ord within all, and the record."""
    out = None
    for k, (channel, path) in enumerate(paths.items()):
        part = _array(spark, path, RAW).withColumn("channel", F.lit(channel)).withColumn("ord", F.col("ord") + F.lit(k).cast("bigint") * (1 << 48))
        out = part if out is None else out.unionByName(part)
    return out


def normalize_dump(df: DataFrame) -> DataFrame:
    """API items as flat records, with defaults for what is missing."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return df.select(
        "id",
        text("snippet.title").alias("title"),
        text("snippet.description").alias("description"),
        text("snippet.publishedAt").alias("publishedAt"),
        X.thumbnail(F.col("snippet.thumbnails"), F.col("id")).alias("thumbnail"),
        X.iso_duration(F.coalesce("contentDetails.duration", F.lit(""))).alias("durationSec"),
        F.coalesce(F.col("statistics.viewCount").cast("bigint"), F.lit(0)).alias("viewCount"),
    )


def hydrate(ids: DataFrame, meta: DataFrame) -> DataFrame:
    """ids (id, ord) in upload order with their metadata (id, ord, …): of several rows the last, ids without any go."""
    names = [c for c in meta.columns if c not in ("id", "ord")]
    last = meta.groupBy("id").agg(F.max_by(F.struct(*names), "ord").alias("m"))
    return ids.join(last, "id").select("ord", "id", "m.*")


def read_registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array-form registry with its order; its file must be there."""
    return _array(spark, path, schema)


def read_keyed_json(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE) -> DataFrame:
    """An id-keyed object as rows, with its order (ord, which can be sorted by); keys that start with // are comments. Read in byte ranges, see keyed."""
    rows = keyed_entries(spark, path, range_bytes).where(~F.col("key").startswith("//"))
    return rows.select("ord", "key", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("v")).select("ord", "key", "v.*")


def read_overrides(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """(id, patch): each entry's keys with their values in JSON, a JSON null as a null value, so presence stays known. Read in byte ranges, as read_keyed_json."""
    rows = keyed_entries(spark, path, range_bytes).where(~F.col("key").startswith("//"))
    return rows.select(F.col("key").alias("id"), F.from_json("value", "map<string,string>", {"mode": "FAILFAST"}).alias("patch"))


def read_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """An optional source in Parquet: no rows if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A source in JSON lines that must be there and well-formed."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_records(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Records, registries and reports in Parquet; the next run reads them back."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def emit(replays: DataFrame, path: str) -> None:
    """The contract in JSON lines; null keys are left out."""
    replays.select(F.to_json(F.struct(*replays.columns), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)
