"""How much each review belongs to each topic, and outliers moved to their likeliest topic."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.vectors import matrix, unit_rows
from voxtally.operators.ordinal import number_rows
from voxtally.session import materialize

# Target vectors that travel to every task: at most this many bytes at a time.
TARGET_BYTES = 32 << 20
# Similarities that a task holds at once: rows times targets, whatever their numbers.
SIMS_HELD = 1 << 21


def group_means(df: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """``(group, vec)``: the mean vector of each group; combines on the map side."""
    return (
        df.groupBy(group)
        .agg(Summarizer.mean(array_to_vector(F.col(vector))).alias("_mean"))
        .select(group, vector_to_array("_mean").alias("vec"))
    )


def topic_centroids(docs: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(topic, vec)`` of the real topics."""
    return group_means(docs.where(F.col("topic") != -1), "topic", vector)


def _pieces(targets: DataFrame, target: str, limit: int) -> list[DataFrame]:
    """The target table in pieces of at most ``limit`` bytes; none if it is empty."""
    size = targets.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dims")).first()
    if not size.n:
        return []
    rows = max(1, limit // (8 * size.dims))
    if size.n <= rows:
        return [targets]
    numbered = materialize(number_rows(targets, [F.col(target)], "_row"), "targets")
    return [
        numbered.where((F.col("_row") >= start) & (F.col("_row") < start + rows))
        for start in range(0, size.n, rows)
    ]


def _held(piece: DataFrame, target: str) -> tuple[np.ndarray, np.ndarray]:
    rows = piece.select(target, "vec").orderBy(target).collect()
    return np.array([r[0] for r in rows], dtype="int64"), np.array([r.vec for r in rows], dtype="float64")


def _passes(pieces: list[DataFrame], target: str, scored: Callable[..., DataFrame], name: str) -> list[DataFrame]:
    """One table per piece. Of several, each is written before the next piece is fetched, so that
    the driver holds one piece at a time."""
    if len(pieces) == 1:
        return [scored(*_held(pieces[0], target))]
    return [materialize(scored(*_held(piece, target)), name) for piece in pieces]


def _similarities(rows: np.ndarray, targets: np.ndarray) -> np.ndarray:
    return np.maximum(unit_rows(rows) @ unit_rows(targets).T, 0.0)


def _parts(n_rows: int, n_targets: int) -> Iterator[slice]:
    """Slices of rows whose similarities to all targets a task may hold."""
    step = max(1, SIMS_HELD // max(1, n_targets))
    for start in range(0, n_rows, step):
        yield slice(start, start + step)


def _best(rows: pd.Series, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first target of the highest cosine for each row, and that cosine."""
    units, place, top = unit_rows(targets).T, np.zeros(len(rows), dtype="int64"), np.zeros(len(rows))
    for part in _parts(len(rows), len(targets)):
        sims = unit_rows(matrix(rows.iloc[part])) @ units
        place[part] = sims.argmax(axis=1)
        top[part] = sims.max(axis=1)
    return place, top


def membership(
    docs: DataFrame,
    centroids: DataFrame,
    key: str = "review_id",
    vector: str = "embedding",
    limit: int = TARGET_BYTES,
    best: int | None = None,
) -> DataFrame:
    """``(key, topic, prob)``: cosine to each topic's mean, negatives as zero, summing to one
    (to zero for a review that points toward no topic).

    ``centroids`` should be a written table. While it fits ``limit`` bytes this is one narrow pass;
    beyond that, one pass per piece and a sum over the pieces. ``best`` keeps only the highest
    shares of each review (of equal ones the lower topic).
    """
    schema = f"{key} bigint, topics array<int>, sims array<double>, total double"

    def scored(ids: np.ndarray, means: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for part in _parts(len(whole), len(ids)):
                    batch = whole.iloc[part]
                    sims = _similarities(matrix(batch[vector]), means)
                    total = sims.sum(axis=1)
                    topics = np.broadcast_to(ids, sims.shape)
                    if best is not None and best < len(ids):
                        top = np.argsort(-sims, axis=1, kind="stable")[:, :best]
                        topics, sims = ids[top], np.take_along_axis(sims, top, axis=1)
                    yield pd.DataFrame(
                        {key: batch[key].to_numpy(), "topics": list(topics), "sims": list(sims), "total": total}
                    )

        return docs.select(F.col(key).cast("long").alias(key), vector).mapInPandas(run, schema)

    parts = _passes(_pieces(centroids, "topic", limit), "topic", scored, "membership")
    if not parts:
        return docs.select(
            F.col(key).cast("long").alias(key), F.lit(0).alias("topic"), F.lit(0.0).alias("prob")
        ).limit(0)
    if len(parts) > 1:
        written = reduce(lambda a, b: a.unionByName(b), parts)
        totals = written.groupBy(key).agg(F.sum("total").alias("total"))
        scores = written.drop("total").join(totals, key)
    else:
        scores = parts[0]
    pair = F.arrays_zip("topics", "sims")
    prob = F.when(F.col("total") > 0, F.col("_p.sims") / F.col("total")).otherwise(F.lit(0.0))
    rows = scores.select(key, "total", F.explode(pair).alias("_p")).select(
        key, F.col("_p.topics").alias("topic"), prob.alias("prob")
    )
    if best is None or len(parts) == 1:
        return rows
    order = Window.partitionBy(key).orderBy(F.desc("prob"), "topic")
    return rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= best).drop("_k")


def best_target(
    docs: DataFrame,
    targets: DataFrame,
    target: str,
    key: str = "review_id",
    vector: str = "embedding",
    limit: int = TARGET_BYTES,
    positive: bool = True,
) -> DataFrame:
    """``(key, target, similarity)``: the target of the highest cosine, the lower id on a tie.

    With ``positive``, rows whose highest cosine is not above zero are left out.
    """
    schema = f"{key} bigint, {target} int, similarity double"

    def scored(ids: np.ndarray, vectors: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    best, top = _best(batch[vector], vectors)
                    found = pd.DataFrame(
                        {key: batch[key].to_numpy(), target: ids[best], "similarity": top}
                    )
                    yield found[top > 0] if positive else found

        return docs.select(F.col(key).cast("long").alias(key), vector).mapInPandas(run, schema)

    parts = _passes(_pieces(targets, target, limit), target, scored, "best")
    if not parts:
        return docs.select(
            F.col(key).cast("long").alias(key),
            F.lit(0).alias(target),
            F.lit(0.0).alias("similarity"),
        ).limit(0)
    if len(parts) == 1:
        return parts[0]
    written = reduce(lambda a, b: a.unionByName(b), parts)
    order = F.struct("similarity", -F.col(target))
    return written.groupBy(key).agg(
        F.max_by(target, order).alias(target), F.max("similarity").alias("similarity")
    )


def reassign_outliers(
    docs: DataFrame,
    threshold: float,
    centroids: DataFrame | None = None,
    key: str = "review_id",
    vector: str = "embedding",
    limit: int = TARGET_BYTES,
) -> DataFrame:
    """``docs`` with outliers moved to their likeliest topic, if the outlier share is above
    ``threshold``; ``old_topic`` keeps the former topic.

    The likeliest topic is the one of the highest cosine, as the shares of one review have a common
    divisor. Only the vectors of outliers are compared with topics, in place while the centroids fit
    ``limit`` bytes, so the reviews are not shuffled.
    """
    if centroids is None:
        centroids = materialize(topic_centroids(docs, vector), "centroids")
    share = docs.agg(F.avg((F.col("topic") == -1).cast("double")).alias("_share")).scalar()
    asking = (F.col("topic") == -1) & (share > threshold)
    bytes_needed = centroids.agg(F.sum(F.size("vec") * 8)).first()[0] or 0
    if bytes_needed <= limit:
        pieces = [_held(piece, "topic") for piece in _pieces(centroids, "topic", limit)]
        marked = docs.withColumn("_asking", F.when(asking, F.col(vector)))
        likeliest = _likeliest(*pieces[0])(F.col("_asking")) if pieces else F.lit(None).cast("int")
        marked = marked.withColumn("_new", likeliest)
    else:
        best = best_target(docs.where(asking), centroids, "topic", key, vector, limit)
        marked = docs.join(best.select(key, F.col("topic").alias("_new")), key, "left")
    return marked.select(
        *[c for c in docs.columns if c != "topic"],
        F.col("topic").alias("old_topic"),
        F.coalesce("_new", "topic").alias("topic"),
    )


def _likeliest(ids: np.ndarray, means: np.ndarray):
    @F.pandas_udf("int")
    def likeliest(vectors: pd.Series) -> pd.Series:
        given = vectors[vectors.notna()]
        if given.empty:
            return pd.Series([None] * len(vectors), dtype="Int32")
        place, top = _best(given, means)
        best = pd.Series(ids[place], index=given.index, dtype="Int32")
        return best.where(top > 0).reindex(vectors.index)

    return likeliest
