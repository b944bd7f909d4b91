"""Topics as dense groups of vectors, with an outlier class (-1)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators.components import connected_components
from voxtally.operators.neighbors import for_every_row, neighborhood, point_entries
from voxtally.operators.ordinal import number_rows
from voxtally.operators.quantile import exact_quantile
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize

NEIGHBORS = 15
EPS_QUANTILE = 0.9


def relabel_by_size(docs: DataFrame, group: str, key: str, min_size: int) -> DataFrame:
    """Add ``topic``: 0 for the largest group, then by size and lowest key; -1 below ``min_size``
    and for null groups."""
    sizes = (
        docs.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(F.count("*").alias("_n"), F.min(key).alias("_first"))
        .where(F.col("_n") >= min_size)
    )
    ranked = number_rows(sizes, [F.desc("_n"), F.asc("_first")], "_topic")
    topics = materialize(ranked.select(group, F.col("_topic").cast("int").alias("topic")), "sizes")
    return lookup_join(docs, topics, [group], by=[key], how="left").withColumn(
        "topic", F.coalesce("topic", F.lit(-1))
    )


def density_topics(
    df: DataFrame,
    key: str = "review_id",
    vector: str = "reduced",
    min_cluster_size: int = 50,
    min_samples: int = 10,
    n_neighbors: int = NEIGHBORS,
    eps: float | None = None,
    eps_quantile: float = EPS_QUANTILE,
    **options,
) -> DataFrame:
    """``(key, topic)`` by density.

    A row's core distance is the distance to its ``min_samples``-th neighbour. Rows are linked to
    their ``n_neighbors`` nearest when both core distances and the distance itself are at most
    ``eps`` (by default the ``eps_quantile`` of the core distances). Linked groups of at least
    ``min_cluster_size`` rows are topics; all other rows are outliers. Each point has at most
    ``n_neighbors`` links and copies of a vector are one point, so the graph grows with the data and
    not with its square.
    """
    k = max(n_neighbors, min_samples)
    hood = neighborhood(df, key, vector, k, **options)
    core = F.get("entries", F.lit(min_samples))["distance"]
    facts = materialize(
        point_entries(hood, k)
        .select("vid", "entries", core.alias("core"))
        .join(hood.points.select("vid", "copies"), "vid"),
        "cores",
    )
    if eps is None:
        eps = exact_quantile(facts, "core", eps_quantile, "copies")
    dense = facts.where(F.col("core") <= F.lit(eps)).select(F.col("vid").alias("node"))
    links = (
        facts.where(F.col("core") <= F.lit(eps))
        .select(F.col("vid").alias("a"), F.explode(F.slice("entries", 1, n_neighbors + 1)).alias("_e"))
        .where(F.col("_e.distance") <= F.lit(eps))
        .select("a", F.col("_e.near_vid").alias("b"))
        .join(dense.select(F.col("node").alias("b")), "b", "left_semi")
    )
    parts = connected_components(dense, links).withColumnRenamed("node", "vid")
    rows = materialize(for_every_row(df, key, vector, hood, parts, how="left"), "grouped")
    return relabel_by_size(rows, "component", key, min_cluster_size).select(key, "topic")


def kmeans_topics(
    df: DataFrame,
    k: int,
    key: str = "review_id",
    vector: str = "reduced",
    outlier_quantile: float | None = 0.95,
    min_cluster_size: int = 1,
    seed: int = 42,
) -> DataFrame:
    """``(key, topic)`` by centroids: rows further from their centre than the quantile are outliers."""
    rows = df.select(key, array_to_vector(vector).alias("_vector"))
    model = KMeans(k=k, seed=seed, featuresCol="_vector", predictionCol="_group").fit(rows)
    # k centres, chosen by the caller; the model holds them on every executor anyway.
    centres = F.array(*[F.array(*map(F.lit, c.tolist())) for c in model.clusterCenters()])
    squares = F.zip_with(
        vector_to_array("_vector"), F.get(centres, F.col("_group")), lambda x, c: (x - c) * (x - c)
    )
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))
    placed = materialize(
        model.transform(rows).select(key, "_group", distance.alias("_distance")), "centred"
    )
    if outlier_quantile is not None:
        cut = exact_quantile(placed, "_distance", outlier_quantile)
        placed = placed.withColumn("_group", F.when(F.col("_distance") <= F.lit(cut), F.col("_group")))
    return relabel_by_size(placed, "_group", key, min_cluster_size).select(key, "topic")
