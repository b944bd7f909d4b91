"""From the review table to the rows of each scope: filters, capped sample, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.text import is_blank
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize

# Reviews kept per brand, the highest rating that counts as low, and the sample's seed.
SAMPLE_PER_BRAND = 100_000
LOW_RATING = 2
SAMPLE_SEED = 42


def _number(df: DataFrame, column: str) -> Column:
    """True where the column holds a number; NaN sorts above all numbers in Spark."""
    kind = dict(df.dtypes)[column]
    return ~F.isnan(column) if kind in ("double", "float") else F.col(column).isNotNull()


def rated(df: DataFrame, rating: str = "rating") -> DataFrame:
    """Rows with a rating above zero; null and NaN go."""
    return df.where((F.col(rating) > 0) & _number(df, rating))


def low_rated(df: DataFrame, rating: str = "rating", at_most: float = LOW_RATING) -> DataFrame:
    """Rated rows of at most ``at_most`` points."""
    return rated(df, rating).where(F.col(rating) <= at_most)


def with_text(df: DataFrame, text: str = "content_clean") -> DataFrame:
    """Rows whose text is not blank. The vector is a column, so it stays with its row."""
    return df.where(~is_blank(text))


def sample_per_group(
    df: DataFrame,
    group: str = "brand",
    key: str = "review_id",
    cap: int = SAMPLE_PER_BRAND,
    seed: int = SAMPLE_SEED,
    prefix: int = 4,
) -> DataFrame:
    """Exactly ``min(n, cap)`` rows of each group, drawn in the order of a seeded hash of ``key``.

    A group may be far larger than one task can sort, so the cut is found in two steps. The first
    counts rows per leading hash digits, which combines on the map side. Rows in the buckets below
    the cap are taken as they are; only the bucket that crosses it is ranked. No window holds more
    than one bucket. Rows without a group are dropped.
    """
    hashed = df.where(F.col(group).isNotNull()).withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    )
    bucket = F.substring("_hash", 1, prefix)
    counts = hashed.groupBy(group, bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    running = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(running), F.lit(0))
    cuts = materialize(
        counts.withColumn("_before", before)
        .where(F.col("_before") < cap)
        .groupBy(group)
        .agg(
            F.max("_bucket").alias("_last"),
            (F.lit(cap) - F.max("_before")).alias("_take"),
        ),
        "sample-cuts",
    )
    near = (
        lookup_join(hashed, cuts, [group], by=[key])
        .withColumn("_bucket", bucket)
        .where(F.col("_bucket") <= F.col("_last"))
    )
    order = Window.partitionBy(group, "_bucket").orderBy("_hash", key)
    return (
        near.withColumn("_rank", F.row_number().over(order))
        .where((F.col("_bucket") < F.col("_last")) | (F.col("_rank") <= F.col("_take")))
        .select(*df.columns)
    )


def group_counts(df: DataFrame, group: str = "brand") -> DataFrame:
    """Rows per group, largest first, without the rows that have no group."""
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), group)
    )


def groups_first_seen(df: DataFrame, group: str = "brand", key: str = "review_id") -> DataFrame:
    """Distinct groups in the order of their first row; null counts as a group."""
    return df.groupBy(group).agg(F.min(key).alias("first_id")).orderBy("first_id")


def dataset_summary(
    df: DataFrame,
    cap: int = SAMPLE_PER_BRAND,
    text: str = "content_clean",
    rating: str = "rating",
    group: str = "brand",
) -> DataFrame:
    """One row of sizes: all, rated, sampled, low-rated and low-rated with text. One shuffle."""
    is_rated = F.coalesce((F.col(rating) > 0) & _number(df, rating), F.lit(False))
    is_low = is_rated & (F.col(rating) <= LOW_RATING)
    per_group = df.groupBy(group).agg(
        F.count("*").alias("n"),
        F.count_if(is_rated).alias("rated"),
        F.count_if(is_low).alias("low"),
        F.count_if(is_low & ~is_blank(text)).alias("low_valid"),
    )
    sampled = F.when(F.col(group).isNotNull(), F.least("rated", F.lit(cap))).otherwise(F.lit(0))
    return per_group.agg(
        F.sum("n").alias("n_reviews"),
        F.sum("rated").alias("n_rated"),
        F.sum(sampled).cast("long").alias("n_sample"),
        F.sum("low").alias("n_low"),
        F.sum("low_valid").alias("n_low_valid"),
    )
