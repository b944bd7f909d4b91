"""Row numbers for tables that have no key: the place of each row in the table's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxtally.operators.ordinal import number_rows
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize


def file_offsets(rows: DataFrame, file: str) -> DataFrame:
    """``(file, offset)``: how many rows the files before each one have, in the order of their paths.

    Counting reads no column, only the sizes that the files' footers give.
    """
    sizes = rows.groupBy(file).agg(F.count("*").alias("_n"))
    # One row per file, so the window without partitions is as short as the list of files.
    before = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    return materialize(sizes.select(file, offset), "file-offsets")


def read_with_row_ids(
    spark: SparkSession, path: str, name: str = "review_id", schema: T.StructType | str | None = None
) -> DataFrame:
    """A parquet table with ``name`` in front: 0, 1, 2 … in the order of the files and of their rows.

    The number comes from what the reader knows of a row, its file and its place there, plus the
    rows of the files before. It does not depend on how files are split into tasks, on the number
    of executors or on retried tasks, and filters and column choices after it leave it alone. A
    rewritten table gets new numbers. A column of that name must not be there yet.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    table = reader.parquet(path)
    if name in table.columns:
        raise ValueError(f"the table has a column {name} already")
    placed = table.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")
    )
    offsets = file_offsets(table.select(F.col("_metadata.file_path").alias("_file")), "_file")
    numbered = lookup_join(placed, offsets, ["_file"], by=["_row"])
    return numbered.select((F.col("_offset") + F.col("_row")).alias(name), *table.columns)


def renumber(df: DataFrame, order: Column | str = "review_id", name: str = "review_id") -> DataFrame:
    """``df`` with ``name`` counting its rows from 0 without gaps, in the order of a unique column.

    What is left after a filter gets fresh numbers, as after dropping an index.
    """
    order = F.col(order) if isinstance(order, str) else order
    rows = df.withColumn("_order", order)
    numbered = number_rows(rows, [F.col("_order")], "_number").drop("_order")
    return numbered.select(F.col("_number").alias(name), *[c for c in df.columns if c != name])
