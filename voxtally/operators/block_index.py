"""A written index of vectors, and the exact nearest of them for the rows of another table.

The index holds distinct vectors in blocks along a bit-interleaved curve, with a box around each
block, as tables that are written once. Rows that come later look first into the block their place
on the curve falls in, which bounds the distance, and then only into blocks whose box lies within
that bound. Neither table is sorted or blocked again, and no pair of vectors is ever a row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.functions.vectors import matrix
from voxtally.operators.neighbors import (
    BLOCK_ROWS,
    ROUTE_BYTES,
    _boxes,
    _curve,
    _merge,
    _near_column,
    _scan,
    _visits,
    distinct_points,
)
from voxtally.operators.skew import hot_keys, replicate, skew_join, spread
from voxtally.session import materialize

INDEX_TABLES = ("points", "boxes", "space")
# Starts of blocks that every task may receive. Of more blocks evenly spread ones are taken: the
# first block a row looks into only gives a bound, so the result stays the same.
STARTS = 1 << 19
_FOUND = "vid bigint, distances array<double>, ids array<bigint>"


@dataclass(frozen=True)
class BlockIndex:
    """``points``: ``(block, vid, vec, copies, members)``, one row per distinct vector, with its lowest
    id, the number of its rows and their ``depth`` lowest ids. ``boxes``: ``(block, lo, hi, first)``, ``first`` being the block's
    start on the curve. ``space``: one row ``(n, dims, depth, lo, hi)``, without rows if there are no
    vectors."""

    points: DataFrame
    boxes: DataFrame
    space: DataFrame


def build_index(
    df: DataFrame, key: str, vector: str, depth: int, block_rows: int = BLOCK_ROWS
) -> BlockIndex:
    """Index the rows of ``df``, for up to ``depth`` nearest rows; rows without a vector are left out.

    Equal vectors are one point, so a vector that fills a third of the table is one row.
    """
    points, _ = distinct_points(df, key, vector, depth - 1)
    space = points.groupBy(F.lit(0).alias("_all")).agg(  # no row, and no box, of an empty table
        F.count("*").alias("n"),
        vector_to_array(Summarizer.min(array_to_vector("vec"))).alias("lo"),
        vector_to_array(Summarizer.max(array_to_vector("vec"))).alias("hi"),
    )
    space = materialize(
        space.select(
            "n", F.size("lo").alias("dims"), F.lit(depth).alias("depth"), "lo", "hi"
        ),
        "index-space",
    )
    facts = space.first()
    if facts is None:
        blocks = points.select(F.lit(0).cast("bigint").alias("block"), "vid", "vec", "copies", "members")
        empty = "block bigint, lo array<double>, hi array<double>, first bigint"
        return BlockIndex(blocks, df.sparkSession.createDataFrame([], empty), space)
    place = _curve(np.array(facts.lo), np.array(facts.hi))
    parts = max(1, facts.n // (32 * block_rows))
    placed = materialize(
        points.select("vid", "vec", "copies", "members", place("vec").alias("_place"))
        .repartitionByRange(parts, "_place", "vid")
        .sortWithinPartitions("_place", "vid")
        # Runs of block_rows neighbours on the curve; the partition number is in the high bits.
        .withColumn("block", F.expr(f"monotonically_increasing_id() div {block_rows}")),
        "index-points",
    )
    firsts = placed.groupBy("block").agg(F.min("_place").alias("first"))
    boxes = materialize(_boxes(placed, "block", "vec", "vec").join(firsts, "block"), "index-boxes")
    return BlockIndex(placed.drop("_place"), boxes, space)


def save_index(index: BlockIndex, path: str, mode: str = "errorifexists") -> None:
    """Write the index's tables below ``path``."""
    for name in INDEX_TABLES:
        getattr(index, name).write.mode(mode).parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> BlockIndex:
    return BlockIndex(*[spark.read.parquet(f"{path}/{name}") for name in INDEX_TABLES])


def _home(index: BlockIndex, lo: np.ndarray, hi: np.ndarray, limit: int) -> Column:
    """The block that a vector's place on the curve falls in; vectors outside count as on the rim."""
    n = index.boxes.count()
    chosen = index.boxes.select("first", "block")
    if n > limit:
        thinned = chosen.where(F.pmod(F.xxhash64("block"), F.lit(-(-n // limit) * 2)) == 0)
        chosen = chosen.orderBy("first", "block").limit(1).union(thinned)
    rows = chosen.orderBy("first", "block").limit(limit).collect()
    starts, blocks = (np.array([r[i] for r in rows], dtype="int64") for i in (0, 1))
    place = _curve(lo, hi).func

    @F.pandas_udf("bigint")
    def home(vectors: pd.Series) -> pd.Series:
        inside = np.clip(matrix(vectors), lo, hi)
        at = np.searchsorted(starts, place(pd.Series(list(inside))).to_numpy(), side="right") - 1
        return pd.Series(blocks[np.maximum(at, 0)])

    return home(F.col("vec"))


def _look(points: DataFrame, visits: DataFrame, k: int, min_hot_rows: int) -> DataFrame:
    """The ``k`` nearest points in each visited block. Only visited blocks are shuffled, and a block
    with very many visitors is held by several tasks."""
    hot = hot_keys(visits, ["block"], min_hot_rows)
    asked = points.join(visits.select("block").distinct(), "block", "left_semi")
    held = replicate(asked, hot, ["block"]).select(
        "block", "_salt", F.lit(False).alias("visitor"), "vid", "vec", F.lit(0.0).alias("reach")
    )
    visiting = spread(visits, hot, ["block"], by=["vid"]).select(
        "block", "_salt", F.lit(True).alias("visitor"), "vid", "vec", "reach"
    )
    both = held.unionByName(visiting).repartition("block", "_salt")
    return both.sortWithinPartitions("block", "_salt", "visitor").mapInPandas(_scan(k), _FOUND)


def nearest_points(
    rows: DataFrame,
    index: BlockIndex,
    k: int,
    route_bytes: int = ROUTE_BYTES,
    min_hot_rows: int = 100_000,
    starts: int = STARTS,
) -> DataFrame:
    """``(vid, near)``: the ``k`` nearest points of the index, as ``(distance, vid)``, for every row
    of ``(vid, vec)``; equal distances go by ``vid``. Rows and points number their own ``vid``."""
    facts = index.space.first()
    if facts is None:
        return rows.select("vid", F.array().cast("array<struct<distance:double,vid:bigint>>").alias("near"))
    home = _home(index, np.array(facts.lo), np.array(facts.hi), starts)
    first = materialize(
        rows.select("vid", "vec", home.alias("block"), F.lit(float("inf")).alias("reach")), "first-visits"
    )
    found = materialize(_look(index.points, first, k, min_hot_rows), "first-lists")
    lists = found.select("vid", _near_column())
    n_blocks = index.boxes.count()
    if n_blocks > 1:
        local = first.drop("reach").join(found, "vid")
        boxes = index.boxes.select("block", "lo", "hi")
        visits = _visits(local, boxes, n_blocks, facts.dims, k - 1, route_bytes, min_hot_rows)
        more = _look(index.points, visits, k, min_hot_rows).select("vid", _near_column())
        lists = _merge(lists.unionByName(more), k - 1)
    return materialize(lists, "near")


def point_rows(near: DataFrame, index: BlockIndex, k: int) -> DataFrame:
    """``(vid, entries)``: the ``k`` nearest indexed rows out of lists of points, copies included, as
    ``(distance, id, near_vid)``. A point has at most ``k`` pairs and a pair ``depth`` members."""
    pairs = near.select("vid", F.explode("near").alias("_e")).select(
        "vid", "_e.distance", F.col("_e.vid").alias("near_vid")
    )
    members = index.points.select(F.col("vid").alias("near_vid"), "members")
    entry = F.struct("distance", "id", "near_vid")
    return (
        skew_join(pairs, members, ["near_vid"], by=["vid"])
        .select("vid", "near_vid", "distance", F.explode("members").alias("id"))
        .groupBy("vid")
        .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("entries"))
    )


def indexed_entries(
    df: DataFrame, index: BlockIndex, key: str, vector: str, k: int, **options
) -> tuple[DataFrame, bool, DataFrame]:
    """The distinct vectors of ``df``, whether any has copies, and their :func:`point_rows`."""
    facts = index.space.first()
    if facts is not None and k > facts.depth:
        raise ValueError(f"the index holds {facts.depth} ids of a vector; {k} neighbours need as many")
    asking, has_copies = distinct_points(df, key, vector, 0)
    near = nearest_points(asking.select("vid", "vec"), index, k, **options)
    return asking, has_copies, materialize(point_rows(near, index, k), "entries")


def knn_join(
    df: DataFrame, index: BlockIndex, key: str, vector: str, k: int, **options
) -> DataFrame:
    """``(key, rank, neighbor_id, distance)``: the ``k`` nearest indexed rows of every row of ``df``.

    Euclidean and exact, equal distances by id. ``k`` is at most the ``depth`` of the index. Equal
    vectors of ``df`` are looked up once; rows without a vector, and all rows if the index is empty,
    have no neighbours.
    """
    asking, has_copies, entries = indexed_entries(df, index, key, vector, k, **options)
    if has_copies:
        rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vec"))
        by_vector = asking.select("vid", "vec").join(entries, "vid").drop("vid")
        listed = skew_join(rows, by_vector, ["vec"], by=[key]).drop("vec")
    else:
        listed = entries.withColumnRenamed("vid", key)
    return listed.select(key, F.posexplode("entries").alias("_pos", "_e")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_e.id").alias("neighbor_id"),
        F.col("_e.distance").alias("distance"),
    )
