"""Joins that stay balanced when one key holds a large share of the rows.

A key is hot when it holds more than ``1 / HOT_SHARE`` of the rows. There can be fewer than
``HOT_SHARE`` such keys however large the data is, so the table of hot keys is safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 256
SALTS = 64
# A lookup table of at most this many rows and this many bytes may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = 100_000) -> DataFrame:
    """The keys above the hot share, with the row count ``_n``; fewer than ``HOT_SHARE`` rows."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total")).scalar()
    return counts.where((F.col("_n") > min_rows) & (F.col("_n") * HOT_SHARE > total))


def _salted(df: DataFrame, hot: DataFrame, keys: Sequence[str], salt: Column) -> DataFrame:
    flags = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    return df.join(flags, list(keys), "left").withColumn("_salt", salt).drop("_hot")


def spread(df: DataFrame, hot: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Add ``_salt``: rows of hot keys fall into ``SALTS`` parts by the hash of ``by``."""
    part = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")
    return _salted(df, hot, keys, F.when(F.col("_hot"), part).otherwise(F.lit(0)))


def replicate(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The counterpart of :func:`spread`: one copy per part for rows of hot keys."""
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(
        F.array(F.lit(0))
    )
    return _salted(df, hot, keys, F.explode(parts))


def skew_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    how: str = "inner",
    min_rows: int = 100_000,
) -> DataFrame:
    """Join ``left`` to ``right``, where ``right`` has few rows per key.

    Hot keys of ``left`` are split by the hash of ``by`` over ``SALTS`` parts.
    """
    hot = hot_keys(left, keys, min_rows)
    return (
        spread(left, hot, keys, by)
        .join(replicate(right, hot, keys), [*keys, "_salt"], how)
        .drop("_salt")
    )


def fits_broadcast(df: DataFrame, row_bytes: int = 256) -> bool:
    """Whether ``df`` (a written table, so that counting is cheap) is small enough to broadcast."""
    limit = min(BROADCAST_ROWS, BROADCAST_BYTES // row_bytes)
    return df.limit(limit + 1).count() <= limit


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    by: Sequence[str],
    how: str = "inner",
    row_bytes: int = 256,
    min_rows: int = 100_000,
) -> DataFrame:
    """Join to a lookup table: broadcast while its checked size allows, else :func:`skew_join`."""
    if fits_broadcast(right, row_bytes):
        return left.join(F.broadcast(right), list(keys), how)
    return skew_join(left, right, keys, by, how, min_rows)
