"""Exact positions in a given order, without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postgrain.session import stage


def positions(rows: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """Add ``pos`` (from 0) of each row in its group by ``order``, and ``of``, the group's number of rows. Written to the shared folder.

    ``group`` must not be null. Rows are laid out by ranges of (group, order), so a group of any size spreads over tasks;
    a place is the place within its range plus the rows of the group in earlier ranges. Rows that agree in ``order``
    must be interchangeable: a row number from the read keeps even those from sharing one range.
    """
    # A task reads the same rows again when it is repeated, so the row number is stable within this job.
    by = [F.col(group), *(F.col(c) if isinstance(c, str) else c for c in order), F.col("__row")]
    numbered = rows.withColumn("__row", F.monotonically_increasing_id())
    laid = stage(numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("__row").withColumn("__at", F.monotonically_increasing_id()))
    block = F.shiftright("__at", 33)  # the task that wrote the row
    sizes = laid.groupBy(F.col(group).alias("__group"), block.alias("__block")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy("__group")
    before = inside.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each range and group in it.
    starts = sizes.select(
        "__group", "__block", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(inside).alias("of")
    )
    joined = laid.join(stage(starts), (F.col(group) == F.col("__group")) & (block == F.col("__block")))
    pos = F.col("__at") - F.col("__first") + F.col("__before")
    return stage(joined.select(*rows.columns, pos.alias("pos"), "of"))
