"""Fewer dimensions before clustering, by direction only (cosine)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.functions.vectors import random_projection

COMPONENTS = 5
SEED = 42


def reduce_random(
    df: DataFrame,
    vector: str = "embedding",
    output: str = "reduced",
    components: int = COMPONENTS,
    seed: int = SEED,
) -> DataFrame:
    """Signed random projection: no fitting pass, the same result on every run."""
    return df.withColumn(output, random_projection(F.col(vector), components, seed))


def fit_pca(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> PipelineModel:
    """Principal components of the unit vectors. The driver holds one dims x dims matrix."""
    stages = [
        Normalizer(inputCol="_vector", outputCol="_unit"),
        PCA(k=components, inputCol="_unit", outputCol="_reduced"),
    ]
    return Pipeline(stages=stages).fit(df.select(array_to_vector(vector).alias("_vector")))


def reduce_pca(
    df: DataFrame,
    vector: str = "embedding",
    output: str = "reduced",
    components: int = COMPONENTS,
    model: PipelineModel | None = None,
) -> DataFrame:
    """The first principal components of each vector, rounded to six places."""
    model = model or fit_pca(df, vector, components)
    done = model.transform(df.withColumn("_vector", array_to_vector(vector)))
    rounded = F.transform(vector_to_array("_reduced"), lambda x: F.round(x, 6) + F.lit(0.0))
    return done.withColumn(output, rounded).drop("_vector", "_unit", "_reduced")
