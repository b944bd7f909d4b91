"""A table of computed text vectors, keyed by what was computed: model and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.text import text_of
from voxtally.operators.skew import skew_join

BATCH_SIZE = 256

Encoder = Callable[[list[str]], "object"]


def text_key(text: str = "content_clean"):
    return F.sha2(text_of(text), 256)


def cache_misses(
    reviews: DataFrame, cache: DataFrame, model_id: str, text: str = "content_clean"
) -> DataFrame:
    """``(text_hash, text)`` of the texts the model has not seen, each once."""
    known = cache.where(F.col("model_id") == model_id).select("text_hash")
    return (
        reviews.select(text_key(text).alias("text_hash"), text_of(text).alias("text"))
        .groupBy("text_hash")
        .agg(F.first("text").alias("text"))
        .join(known, "text_hash", "left_anti")
    )


def encode(texts: DataFrame, encoder: Callable[[], Encoder], batch_size: int = BATCH_SIZE) -> DataFrame:
    """``(text_hash, embedding)`` by a model of the caller's.

    ``encoder()`` runs once per Arrow stream on the executor and returns a function from a list of
    texts to a list of vectors.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = encoder()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start : start + batch_size]
                vectors = [[float(x) for x in v] for v in model(part["text"].tolist())]
                yield pd.DataFrame({"text_hash": part["text_hash"].values, "embedding": vectors})

    return texts.select("text_hash", "text").mapInPandas(
        run, "text_hash string, embedding array<float>"
    )


def append_vectors(vectors: DataFrame, model_id: str, path: str) -> None:
    """Add newly computed vectors to the cache."""
    vectors.withColumn("model_id", F.lit(model_id)).write.mode("append").partitionBy(
        "model_id"
    ).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache, empty when nothing has been written yet."""
    schema = "text_hash string, embedding array<float>, model_id string"
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], schema)
        raise


def vectors_for(
    reviews: DataFrame,
    path: str,
    model_id: str,
    encoder: Callable[[], Encoder],
    text: str = "content_clean",
    key: str = "review_id",
) -> DataFrame:
    """Reviews with their vector: from the cache, after computing and storing what it lacks."""
    spark = reviews.sparkSession
    misses = cache_misses(reviews, read_cache(spark, path), model_id, text)
    append_vectors(encode(misses, encoder), model_id, path)
    # Two fills that overlap may both have stored a text; one vector of each is enough.
    cached = (
        read_cache(spark, path)
        .where(F.col("model_id") == model_id)
        .groupBy("text_hash")
        .agg(F.first("embedding").alias("embedding"))
    )
    hashed = reviews.withColumn("text_hash", text_key(text))
    return skew_join(
        hashed, cached.select("text_hash", "embedding"), ["text_hash"], by=[key]
    ).drop("text_hash")
