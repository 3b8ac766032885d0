"""Helpers shared by the operators: tables, staging in the shared folder, sorted groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobtide.session import delete_path, shared_dir, ship_package


#: Rows and bytes that travel to a Python worker at a time: Spark's defaults, and what is set in their place.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "4000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str):
    """A text column as UTF-8 bytes; null reads as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def extended(schema: StructType, columns: str) -> StructType:
    """The schema with further columns, given as in a table definition."""
    return StructType([*schema.fields, *StructType.fromDDL(columns).fields])


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


#: Whether Spark deletes the shuffle files of a query when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staging_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors.

    What was shuffled for it is not needed once it is written, and goes from the disk with the write.
    """
    spark = df.sparkSession
    path = staging_path(spark, label)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_at = path
    return written


def discard(written: DataFrame) -> None:
    """Delete the folder of a staged frame that nothing reads any more."""
    delete_path(written.sparkSession, written.staged_at)


def prepare(spark: SparkSession) -> int:
    """Ship the code to the Python workers and keep Arrow batches small; the number of shuffle partitions.

    Batches are held by the JVM and by Python at once. A size that the session has set stays.
    """
    ship_package(spark)
    for setting, (default, smaller) in BATCH.items():
        if spark.conf.get(setting, default) == default:
            spark.conf.set(setting, smaller)
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts, in the column of that number, have about ``most`` bytes; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            upto = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)))
            yield batch.slice(begin, upto - begin)
            begin = upto


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole key groups out of batches that are sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        joined = pa.Table.from_batches(held).combine_chunks()
        cut = group_starts(joined, keys)[-1]
        if cut:
            yield joined.slice(0, cut)
        held = joined.slice(cut).combine_chunks().to_batches()
        size = joined.num_rows - cut
        rows = max(rows, 2 * size)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a key group begins."""
    change = np.zeros(rows.num_rows, bool)
    change[:1] = True
    for key in keys:
        values = rows[key].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bits differ. The counts are those of unsigned numbers: numpy counts the bits of a signed one's magnitude."""
    return np.bitwise_count((a ^ b).view(f"u{a.dtype.itemsize}"))


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Lower ``labels`` in place until both ends of every link (a, b) carry the same one."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return
        for ends in (labels[a], labels[b], a, b):
            np.minimum.at(labels, ends, low)
        jumped = labels[labels]
        while (jumped != labels).any():
            labels[:] = jumped
            jumped = labels[labels]


def cell_pairs(homes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 2_000_000):
    """(home row, member row) index pairs, every home against all rows of its group, at most ``most`` at a time.

    ``homes`` are row numbers in ascending order; ``starts`` and ``sizes`` describe the groups in row order.
    """
    group = np.searchsorted(starts, homes, side="right") - 1
    first, count = starts[group], sizes[group]
    ends = np.cumsum(count)
    done = 0
    while done < len(homes):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + most, side="right")))
        n = count[done:upto]
        offsets = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(homes[done:upto], n), np.repeat(first[done:upto], n) + offsets
        done = upto
