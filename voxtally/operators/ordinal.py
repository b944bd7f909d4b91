"""Consecutive numbers in a global order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.skew import lookup_join
from voxtally.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def number_rows(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """Add ``name``: 0, 1, 2 … in the given order.

    The rows are range-partitioned and sorted; a partition's first number is the size of all
    partitions before it.
    """
    placed = materialize(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_at", _ROW_BITS)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so the unpartitioned window is as short as the partition count.
    starts = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    row = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        lookup_join(placed.withColumn("_part", part), starts, ["_part"], by=["_at"])
        .withColumn(name, F.col("_start") + row)
        .drop("_part", "_start", "_at")
    )
