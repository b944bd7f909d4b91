"""Exact quantiles of a column in a few passes, without sorting the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDS = 255  # that cut the rows which may hold the quantile, in each pass


def exact_quantile(
    df: DataFrame, value: str, q: float, weight: str | None = None, bounds: int = BOUNDS
) -> float | None:
    """The lowest value that at least the share ``q`` of the weight does not exceed.

    Nulls, NaN and rows of no positive weight are left out; without any row there is no quantile.
    Without ``weight`` every row counts once, and ``q`` up to 0 gives the lowest value.

    Each pass cuts the range that holds the quantile at approximate quantiles of its rows, adds up
    the weight between the cuts, and goes on with the one piece in which the share is reached, until
    that holds a single value. A pass shrinks the rows in question by about the number of cuts, so
    passes grow with the logarithm of the rows; the driver sees one row per piece. ``df`` is read in
    every pass and should be a written table.
    """
    share = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(F.col(value).cast("double").alias("v"), share.alias("w")).where(
        F.col("v").isNotNull() & ~F.isnan("v") & (F.col("w") > 0)
    )
    whole = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("w")).first()
    if whole.w is None:
        return None
    low, high, below, wanted = whole.low, whole.high, 0.0, q * whole.w
    while low < high:
        held = rows.where(F.col("v").between(low, high))
        steps = [(i + 1) / (bounds + 1) for i in range(bounds)]
        cuts = held.agg(F.percentile_approx("v", steps, 10 * bounds).alias("cuts")).first().cuts
        # The lowest value is a piece of its own, and half the range is cut off if no cut does more.
        middle = low + (high - low) / 2
        cuts = sorted({c for c in (*cuts, low, middle) if c < high})
        piece = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("v")))
        pieces = (
            held.groupBy(piece.alias("piece"))
            .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("w").alias("w"))
            .orderBy("piece")
            .collect()
        )
        for part in pieces:
            low, high = part.low, part.high
            if below + part.w >= wanted:
                break
            below += part.w
    return high
