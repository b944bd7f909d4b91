"""Text vectors without a language model: hashed and weighted term counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.session import materialize

FEATURES = 512


def bucket_of(token: str, features: int = FEATURES):
    """The feature of a token: the first four hexadecimal digits of its md5."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % features


def _buckets(tokens: str, features: int) -> Column:
    return F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: bucket_of(t, features))


def fit_weights(docs: DataFrame, tokens: str = "tokens", features: int = FEATURES) -> list[float]:
    """The weight of each feature: the logarithm of the number of texts over that of those with it.

    One pass counts the texts of each feature, combined on the map side into ``features`` numbers.
    """
    return _weights(docs, _buckets(tokens, features), features)


def _weights(docs: DataFrame, buckets: Column, features: int) -> list[float]:
    # Feature -1 is in every text and so counts them.
    own = F.array_distinct(F.concat(F.array(F.lit(-1)), buckets))
    present = docs.select(F.explode(own).alias("_bucket")).groupBy("_bucket").agg(F.count("*"))
    texts = {r[0]: r[1] for r in present.collect()}
    total = texts.get(-1, 0)
    return [math.log((total + 1.0) / (texts.get(b, 0) + 1.0)) for b in range(features)]


def weigh(docs: DataFrame, weights: Sequence[float], tokens: str = "tokens", output: str = "embedding") -> DataFrame:
    """Add the vector of each text where it stands, without a shuffle."""
    return docs.withColumn(output, _vectors(weights, _buckets(tokens, len(weights))))


def _vectors(weights: Sequence[float], buckets: Column) -> Column:
    idf = np.array(weights)

    @F.pandas_udf("array<float>")
    def vectors(rows: pd.Series) -> pd.Series:
        n = len(idf)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        buckets = np.concatenate([np.empty(0, dtype=np.int64), *rows]).astype(np.int64)
        place = np.repeat(np.arange(len(rows)) * n, sizes) + buckets
        counts = np.bincount(place, minlength=len(rows) * n).reshape(-1, n) * idf
        found = [(own / (math.sqrt(own @ own) or 1.0)).astype("float32") for own in counts]
        return pd.Series(found, index=rows.index, dtype="object")

    return vectors(buckets)


def hash_embed(
    docs: DataFrame,
    tokens: str = "tokens",
    output: str = "embedding",
    features: int = FEATURES,
) -> DataFrame:
    """Add a vector of ``features`` hashed TF-IDF weights of unit length.

    A text without tokens, or with none that tells texts apart, has a vector of zeros.
    """
    return weigh(docs, fit_weights(docs, tokens, features), tokens, output)


def hash_embed_once(docs: DataFrame, key: str, tokens: Column, features: int = FEATURES) -> DataFrame:
    """``(key, embedding)`` as by :func:`hash_embed`, for tokens that are dear to make: they are made
    once and written as the numbers of their features."""
    buckets = F.col("buckets")
    rows = docs.select(key, tokens.alias("tokens"))
    coded = materialize(rows.select(key, _buckets("tokens", features).alias("buckets")), "buckets")
    return coded.select(key, _vectors(_weights(coded, buckets, features), buckets).alias("embedding"))
