"""Append-only tables that take every batch exactly once.

A batch is a new folder plus one manifest row. A replayed batch finds its row
and does nothing; of two writers of one batch the first row holds. Compaction
puts many small folders into one, again by a manifest row that names what it
replaces, so readers see the old folders or the new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtide.operators import profiles
from jobtide.sources.tables import append_manifest, attempt, read_manifest

_MANIFEST = "stream string, batch_id long, folder string, rows long, replaces array<string>, written_at timestamp_ntz"
COMPACTION = "compaction"


def _holding(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows that hold: the first one of each batch."""
    rows = read_manifest(spark, f"{path}/_manifest", _MANIFEST)
    first = rows.groupBy("stream", "batch_id").agg(F.min(F.struct("written_at", "folder")).alias("first"))
    return rows.join(first.select("stream", "batch_id", F.col("first.folder")), ["stream", "batch_id", "folder"], "left_semi")


def has_batch(spark: SparkSession, path: str, stream: str, batch_id: int) -> bool:
    return not _holding(spark, path).filter((F.col("stream") == stream) & (F.col("batch_id") == batch_id)).isEmpty()


def _publish(spark: SparkSession, path: str, frame: DataFrame, stream: str, batch_id: int, replaces: list[str]) -> bool:
    folder, now = attempt()
    target = f"{path}/data/{folder}"
    frame.write.parquet(target)
    rows = spark.read.schema(frame.schema).parquet(target).count()
    append_manifest(spark, f"{path}/_manifest", [(stream, batch_id, folder, rows, replaces, now)], _MANIFEST)
    return not _holding(spark, path).filter(F.col("folder") == folder).isEmpty()


def append(frame: DataFrame, path: str, stream: str, batch_id: int) -> bool:
    """Add a batch; False, and no rows, if it is there already."""
    if stream == COMPACTION:
        raise ValueError(f"{COMPACTION} is no name for a stream")
    spark = frame.sparkSession
    return not has_batch(spark, path, stream, batch_id) and _publish(spark, path, frame, stream, batch_id, [])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Folders that hold rows, one for each batch since the last compaction."""
    held = _holding(spark, path)
    replaced = held.select(F.explode("replaces").alias("folder"))
    return [r["folder"] for r in held.filter("rows > 0").join(replaced, "folder", "left_anti").select("folder").collect()]


def read_appended(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All rows of all batches."""
    folders = _folders(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def compact(spark: SparkSession, path: str, schema: str | StructType) -> bool:
    """Put all folders into one. The rows stay the same; a batch appended meanwhile stays on its own."""
    folders = _folders(spark, path)
    if len(folders) < 2:
        return False
    done = _holding(spark, path).filter(F.col("stream") == COMPACTION).count()
    frame = spark.read.schema(schema).parquet(*[f"{path}/data/{f}" for f in folders])
    # Two compactions of one number replace the same folders; the first one holds.
    return _publish(spark, path, frame.hint("rebalance"), COMPACTION, done, folders)


def append_profiles(validated: DataFrame, path: str, stream: str, batch_id: int) -> bool:
    """Add validated profiles: a few fields as columns next to the whole document."""
    return append(profiles.profiles_table(validated), path, stream, batch_id)


def append_search_configs(
    queries: DataFrame, filters: DataFrame, path: str, stream: str, batch_id: int, failed: DataFrame | None = None
) -> bool:
    """Add search configurations; earlier ones of a profile are never overwritten."""
    return append(profiles.search_configs_table(queries, filters, failed), path, stream, batch_id)
