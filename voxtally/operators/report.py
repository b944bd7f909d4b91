"""What the analyst reads: topic sizes, brand mixes, top topics, example reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOP_TOPICS = 5


def round_half_even(column: Column, places: int = 1) -> Column:
    scale = float(10**places)
    return F.rint(column * scale) / scale


def outlier_ratio(docs: DataFrame) -> DataFrame:
    """One row: reviews, outliers, their share, and the number of real topics."""
    per_topic = docs.groupBy("topic").agg(F.count("*").alias("n"))
    outliers = F.coalesce(F.sum(F.when(F.col("topic") == -1, F.col("n"))), F.lit(0))
    return per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_reviews"),
        outliers.alias("n_outliers"),
        (outliers / F.sum("n")).alias("outlier_ratio"),
        F.count_if(F.col("topic") != -1).alias("n_topics"),
    )


def topic_info(docs: DataFrame, names: DataFrame, noise: str) -> DataFrame:
    """``(topic, n, topic_name)``, outliers first, then topics in order of their id."""
    sizes = docs.groupBy("topic").agg(F.count("*").alias("n"))
    name = F.when(F.col("topic") == -1, F.lit(noise)).otherwise(F.col("topic_name"))
    return (
        sizes.join(names, "topic", "left")
        .select("topic", "n", name.alias("topic_name"))
        .orderBy("topic")
    )


def topic_head(info: DataFrame, rows: int = 16) -> DataFrame:
    """The first rows of the topic table: the outliers and the largest topics."""
    return info.orderBy("topic").limit(rows)


def brand_topic_counts(
    docs: DataFrame, topic: str = "topic_name", brand: str = "brand", by: tuple[str, ...] = ()
) -> DataFrame:
    """``(brand, topic_name, count)`` without outliers and without null keys.

    Topics of the same name merge; pass ``topic='topic'`` to keep them apart.
    """
    return (
        docs.where(
            (F.col("topic") != -1) & F.col(brand).isNotNull() & F.col(topic).isNotNull()
        )
        .groupBy(*by, brand, topic)
        .agg(F.count("*").alias("count"))
    )


def brand_topic_share(
    counts: DataFrame, brand: str = "brand", by: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``ratio``: the percentage of the brand's non-outlier reviews, one decimal, half to even.

    The counts are already aggregated, so a brand has one row per topic here.
    """
    within = Window.partitionBy(*by, brand)
    share = F.col("count") / F.sum("count").over(within) * 100
    return counts.withColumn("ratio", round_half_even(share, 1))


def top_topics(
    shares: DataFrame,
    top_n: int = TOP_TOPICS,
    brand: str = "brand",
    topic: str = "topic_name",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """The ``top_n`` topics of every brand; equal ratios are ordered by name."""
    order = Window.partitionBy(*by, brand).orderBy(F.desc("ratio"), topic)
    return shares.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)


def topic_examples(
    docs: DataFrame,
    terms: DataFrame,
    top_k: int = 10,
    per_topic: int = 3,
    n_words: int = 10,
    width: int = 100,
    text: str = "content_clean",
    key: str = "review_id",
) -> DataFrame:
    """``(topic, rank, key, excerpt, keywords)``: the first reviews of the first ``top_k`` topics.

    Texts are cut before the shuffle, and each partition passes on ``per_topic`` rows per topic.
    """
    first = (
        docs.where(F.col("topic") != -1).select("topic").distinct().orderBy("topic").limit(top_k)
    )
    order = Window.partitionBy("topic").orderBy(key)
    chosen = (
        docs.where(F.col("topic") != -1)
        .select("topic", key, F.substring(text, 1, width).alias("excerpt"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_topic)
    )
    words = (
        terms.where(F.col("rank") <= n_words)
        .groupBy("topic")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("_ranked"))
        .select("topic", F.array_join(F.col("_ranked.term"), ", ").alias("keywords"))
    )
    return (
        chosen.join(first, "topic", "left_semi")
        .join(words, "topic", "left")
        .select("topic", "rank", key, "excerpt", "keywords")
    )


def show_shares(top: DataFrame) -> DataFrame:
    """The top-topic table as padded text with percent signs, for the console."""
    return top.select(
        "brand",
        "rank",
        F.rpad("topic_name", 35, " ").alias("topic_name"),
        F.format_string("%.1f%%", "ratio").alias("share"),
    )
