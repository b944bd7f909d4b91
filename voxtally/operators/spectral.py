"""Few dimensions that keep the neighbour graph: leading eigenvectors of its normalised matrix.

Block power iteration, where a product with the sparse matrix is a join of the edges with the block's
rows and a sum by node, and only matrices of a few numbers square come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.operators.neighbors import for_every_row, neighborhood, point_entries
from voxtally.session import materialize, scratch

COMPONENTS = 5
EXTRA = 3  # columns beyond those asked for, which make the others settle sooner


@dataclass(frozen=True)
class Spectrum:
    """``vectors``: ``(node, reduced)``. ``values``: the eigenvalues, largest first, and ``residuals``:
    the length of what the matrix makes of each vector beyond its multiple."""

    vectors: DataFrame
    values: list[float]
    residuals: list[float]


def neighbor_graph(lists: DataFrame, n_neighbors: int) -> DataFrame:
    """``(a, b, w)`` in both directions: 1 where each is among the other's nearest, else 1/2.

    ``lists`` has ``(vid, entries)`` with the point itself first.
    """
    found = (
        lists.select(F.col("vid").alias("a"), F.explode(F.slice("entries", 1, n_neighbors + 1)).alias("_e"))
        .select("a", F.col("_e.near_vid").alias("b"))
        .where("a <> b")
        .distinct()
    )
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy("a", "b").agg((F.count("*") / 2).alias("w"))


def _normalised(edges: DataFrame) -> DataFrame:
    """The weights over the roots of both nodes' totals."""
    totals = edges.groupBy("a").agg(F.sum("w").alias("t"))
    other = totals.select(F.col("a").alias("b"), F.col("t").alias("u"))
    met = edges.join(totals, "a").join(other, "b")
    return met.select("a", "b", (F.col("w") / F.sqrt(F.col("t") * F.col("u"))).alias("w"))


def _dot(row: list[str], column: np.ndarray) -> Column:
    out = F.lit(0.0)
    for name, x in zip(row, column.tolist()):
        out = out + F.col(name) * F.lit(x)
    return out


def _gram(block: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
    sums = [F.sum(F.col(x) * F.col(y)) for x in left for y in right]
    return np.array(block.agg(*sums).first(), dtype=float).reshape(len(left), len(right))


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What a block with these products is to be multiplied by, so that its columns are orthonormal."""
    values, vectors = np.linalg.eigh(gram)
    return vectors / np.sqrt(np.maximum(values, values.max() * 1e-14))


def spectrum(
    edges: DataFrame,
    components: int = COMPONENTS,
    rounds: int = 20,
    tolerance: float = 1e-2,
    steps: int = 4,
    seed: int = 42,
) -> Spectrum:
    """The leading eigenvectors of the normalised graph ``(a, b, w)``, which has both directions.

    Every connected part of the graph has one vector of eigenvalue 1 that is zero elsewhere, so parts
    lie apart; slowly changing vectors along the graph come next. The block starts from hashes of the
    nodes, is multiplied ``steps`` times between two orthonormalisations, and stops after ``rounds`` of
    these or once all residuals are within ``tolerance``. Half the identity is mixed in, which makes
    all eigenvalues positive and leaves the vectors as they are.
    """
    width = components + EXTRA
    x, y = ([f"{c}{i}" for i in range(width)] for c in "xy")
    start = [
        (F.pmod(F.xxhash64("a", F.lit(seed), F.lit(i)), F.lit(1 << 32)) / float(1 << 32) - 0.5).alias(c)
        for i, c in enumerate(x)
    ]

    with scratch(edges.sparkSession) as keep:
        matrix = materialize(_normalised(edges), "matrix")
        block = materialize(matrix.select("a").distinct().select("a", *start), "block")

        def times(rows: DataFrame) -> DataFrame:
            """``(a, x…, y…)``: the block and the matrix times the block."""
            sent = matrix.join(rows.withColumnRenamed("a", "b"), "b")
            product = sent.groupBy("a").agg(*(F.sum(F.col("w") * F.col(c)).alias(d) for c, d in zip(x, y)))
            return rows.join(product, "a")

        values = residuals = np.zeros(0)
        for _ in range(rounds):
            for _ in range(steps - 1):
                mixed = [((F.col(c) + F.col(d)) / 2).alias(c) for c, d in zip(x, y)]
                block = times(block).select("a", *mixed)
            block = materialize(block, "block")
            turn = _orthonormal(_gram(block, x, x))
            block = block.select("a", *(_dot(x, turn[:, i]).alias(c) for i, c in enumerate(x)))
            both = materialize(times(block), "product")
            # Within the block: its best vectors, their values, and how far the matrix leads out of it.
            inner = _gram(both, x, y)
            found, turn = np.linalg.eigh((inner + inner.T) / 2)
            order = np.argsort(-found)
            values, turn = found[order], turn[:, order]
            squares = np.diag(turn.T @ _gram(both, y, y) @ turn) - values**2
            residuals = np.sqrt(np.maximum(squares, 0.0))
            turned = [_dot(x, turn[:, i]).alias(c) for i, c in enumerate(x)]
            ahead = [_dot(y, turn[:, i]).alias(d) for i, d in enumerate(y)]
            block = materialize(both.select("a", *turned, *ahead), "block")
            if len(block.take(1)) == 0 or (residuals[:components] <= tolerance).all():
                break
            block = block.select("a", *(((F.col(c) + F.col(d)) / 2).alias(c) for c, d in zip(x, y)))
        reduced = F.array(*x[:components]).alias("reduced")
        vectors = keep(materialize(block.select(F.col("a").alias("node"), reduced), "spectrum"))
    return Spectrum(vectors, values[:components].tolist(), residuals[:components].tolist())


def reduce_spectral(
    df: DataFrame,
    key: str = "review_id",
    vector: str = "embedding",
    output: str = "reduced",
    components: int = COMPONENTS,
    n_neighbors: int = 15,
    **options,
) -> DataFrame:
    """``(key, reduced)``: rows of one neighbourhood lie close together, parts of the graph apart.

    Coordinates are scaled so that their mean square is 1. Equal vectors get equal coordinates; rows
    without a vector, or without any neighbour, are left out.
    """
    hood = neighborhood(df, key, vector, n_neighbors)
    edges = materialize(neighbor_graph(point_entries(hood, n_neighbors), n_neighbors), "graph")
    if edges.isEmpty():
        return df.select(F.col(key).cast("long").alias(key), F.array().cast("array<double>").alias(output)).limit(0)
    found = spectrum(edges, components, **options).vectors
    scale = F.sqrt(F.lit(float(found.count())))
    scaled = found.select(F.col("node").alias("vid"), F.transform("reduced", lambda c: c * scale).alias(output))
    return for_every_row(df, key, vector, hood, scaled)
