"""Topics for reviews that come after the fit, by the fitted rows around them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.operators.block_index import (
    BlockIndex,
    build_index,
    indexed_entries,
    load_index,
    nearest_points,
    point_rows,
    save_index,
)
from voxtally.operators.quantile import exact_quantile
from voxtally.operators.skew import skew_join
from voxtally.session import materialize


@dataclass(frozen=True)
class FittedSpace:
    """What a density fit leaves behind for later rows.

    ``index``: the fitted vectors in blocks. ``facts``: ``(vid, core, topic)`` of each distinct one.
    ``settings``: one row ``(eps, min_samples, n_neighbors)``; ``eps`` is null if nothing was dense.
    """

    index: BlockIndex
    facts: DataFrame
    settings: DataFrame


def fitted_space(
    df: DataFrame,
    topics: DataFrame,
    key: str = "review_id",
    vector: str = "reduced",
    min_samples: int = 10,
    n_neighbors: int = 15,
    eps: float | None = None,
    eps_quantile: float = 0.9,
    **options,
) -> FittedSpace:
    """Index the rows that were fitted, with the settings of the fit and its ``(key, topic)``.

    Core distances and ``eps`` are those of :func:`voxtally.operators.clusters.density_topics`.
    """
    depth = max(min_samples, n_neighbors) + 1
    index = build_index(df, key, vector, depth)
    near = nearest_points(index.points.select("vid", "vec"), index, min_samples + 1, **options)
    # A point is the first of its own entries.
    core = F.get("entries", F.lit(min_samples))["distance"].alias("core")
    cores = point_rows(near, index, min_samples + 1).select("vid", core)
    facts = materialize(
        cores.join(index.points.select("vid", "copies"), "vid").join(
            topics.select(F.col(key).cast("long").alias("vid"), "topic"), "vid"
        ),
        "fitted-facts",
    )
    if eps is None:
        eps = exact_quantile(facts, "core", eps_quantile, "copies")
    settings = df.sparkSession.createDataFrame(
        [(eps, min_samples, n_neighbors)], "eps double, min_samples int, n_neighbors int"
    )
    return FittedSpace(index, facts.drop("copies"), settings)


def save_space(space: FittedSpace, path: str, mode: str = "errorifexists") -> None:
    """Write the tables of ``space`` below ``path``."""
    save_index(space.index, f"{path}/index", mode)
    space.facts.write.mode(mode).parquet(f"{path}/facts")
    space.settings.write.mode(mode).parquet(f"{path}/settings")


def load_space(spark: SparkSession, path: str) -> FittedSpace:
    return FittedSpace(
        load_index(spark, f"{path}/index"),
        spark.read.parquet(f"{path}/facts"),
        spark.read.parquet(f"{path}/settings"),
    )


def assign_topics(
    df: DataFrame, space: FittedSpace, key: str = "review_id", vector: str = "reduced", **options
) -> DataFrame:
    """``(key, topic, nearest_id, distance)`` for rows that were not fitted.

    A row is judged as the fit judges its own: it is dense if its ``min_samples``-th nearest fitted
    row lies within ``eps``, and then linked to those of its ``n_neighbors`` nearest fitted rows that
    are dense and within ``eps``. It gets the topic of the nearest linked row (of the lower id on a
    tie), ``nearest_id`` at ``distance``; a row without links is an outlier, -1. Fitted topics do not
    change, and rows do not see each other, so batches of any size give the same topics. Rows without
    a vector are left out. Equal vectors are looked up once.
    """
    settings = space.settings.first()
    eps, samples, links = settings.eps, settings.min_samples, settings.n_neighbors
    asking, has_copies, entries = indexed_entries(df, space.index, key, vector, max(samples, links), **options)
    dense = F.get("entries", F.lit(samples - 1))["distance"] <= F.lit(eps)
    near = entries.where(dense).select("vid", F.explode(F.slice("entries", 1, links)).alias("_e"))
    near = near.where(F.col("_e.distance") <= F.lit(eps)).select(
        "vid", "_e.distance", "_e.id", F.col("_e.near_vid").alias("near_vid")
    )
    facts = space.facts.where(F.col("core") <= F.lit(eps)).select(F.col("vid").alias("near_vid"), "topic")
    linked = skew_join(materialize(near, "links"), facts, ["near_vid"], by=["vid"])
    best = linked.groupBy("vid").agg(F.min(F.struct("distance", "id", "topic")).alias("best"))
    found = asking.select("vid", "vec").join(best, "vid", "left")
    if has_copies:
        rows = df.where(F.col(vector).isNotNull()).select(
            F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vec")
        )
        listed = skew_join(rows, materialize(found.drop("vid"), "assigned"), ["vec"], by=[key], how="left")
    else:
        listed = found.withColumnRenamed("vid", key)
    return listed.select(
        key,
        F.coalesce("best.topic", F.lit(-1)).alias("topic"),
        F.col("best.id").alias("nearest_id"),
        F.col("best.distance").alias("distance"),
    )
