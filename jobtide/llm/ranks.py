"""Places of rows in an order, counted without gathering a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.common import staged


def ranked(df: DataFrame, group: str, order: list[str], label: str, keep: list[Column] | None = None) -> DataFrame:
    """``df`` with ``pos``, a row's place in its group from 0, and ``n``, the rows of the group.

    Rows are dealt out by ranges of (group, order), so a group of any size spreads over many tasks; each task
    numbers what it holds, and the counts of the tasks before it, one row for each task and group, give the
    offset. Nulls come first. Equal rows get places in any order. ``df`` may not hold columns named ``pos``,
    ``n``, ``_part``, ``_at``, ``_first`` or ``_before``. It is read twice, so it should be stored. ``keep``, if
    given, are the columns to go on with; the group must be one of them.
    """
    columns = df.columns if keep is None else df.select(*keep).columns
    placed = (
        df.repartitionByRange(group, *order)
        .sortWithinPartitions(group, *order)
        .select(*(keep or df.columns))
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()})
    )
    numbered = staged(placed, label)
    earlier = Window.partitionBy(group).orderBy("_part")
    spread = (
        numbered.groupBy(group, "_part")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
        .select(
            group, "_part", "_first",
            (F.sum("_rows").over(earlier) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
        )
    )
    pos = (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos")
    return numbered.join(spread, [group, "_part"]).select(*columns, pos, "n")
