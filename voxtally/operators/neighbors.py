"""Exact nearest neighbours as a range-partitioned block join.

Equal vectors are collapsed first, so a vector that fills a third of the table is one point. The
points are range-partitioned along a bit-interleaved curve and cut into blocks of bounded size, each
with its bounding box. A point's own block gives an upper bound for its k-th distance; it then visits
only blocks whose box lies within that bound. No pair of points is ever a row: a task holds one
block and streams the visiting points past it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtally.functions.vectors import matrix
from voxtally.operators.ordinal import number_rows
from voxtally.operators.skew import hot_keys, replicate, skew_join, spread
from voxtally.session import materialize

BLOCK_ROWS = 2_048
# Boxes that every task receives: at most this many bytes, whatever the number of points.
ROUTE_BYTES = 16 << 20
_CELLS = 1 << 18  # distances held at once by a task
_FOUND = "distances array<double>, ids array<bigint>"


@dataclass(frozen=True)
class Neighborhood:
    """Distinct points and their nearest distinct points.

    ``points``: ``(vid, vec, copies, members)``; ``vid`` is the lowest id with that vector and
    ``members`` its ``k + 1`` lowest ids. ``lists``: ``(vid, near)`` with the ``k + 1`` nearest
    distinct points, the point itself first.
    """

    points: DataFrame
    lists: DataFrame
    has_copies: bool


def distinct_points(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, bool]:
    """One row per distinct vector, and whether any vector has copies; rows without one are left out.

    Only the ``k + 1`` lowest ids of a vector are kept: no result list can reach further into a
    group of copies. Both the counts and the lowest ids combine before the shuffle.
    """
    rows = df.select(
        F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vec")
    ).where("vec IS NOT NULL")
    counts = rows.groupBy("vec").agg(F.min("id").alias("vid"), F.count("*").alias("copies"))
    counts = materialize(counts.select("vid", "vec", "copies"), "distinct")
    if counts.where("copies > 1").isEmpty():
        return counts.withColumn("members", F.array("vid")), False
    order = Window.partitionBy("vec").orderBy("id")
    lowest = (
        rows.withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k + 1)
        .groupBy("vec")
        .agg(F.array_sort(F.collect_list("id")).alias("members"))
        .select(F.col("members")[0].alias("vid"), "members")
    )
    return materialize(counts.join(lowest, "vid"), "points"), True


def _curve(lo: np.ndarray, hi: np.ndarray):
    """A column function from a vector to its place on a bit-interleaved curve."""
    dims = min(len(lo), 8)
    bits = 60 // dims
    span = np.where(hi > lo, hi - lo, 1.0)[:dims]

    @F.pandas_udf("bigint")
    def place(vectors: pd.Series) -> pd.Series:
        rows = matrix(vectors)[:, :dims]
        cells = ((rows - lo[:dims]) / span * (2**bits - 1)).astype("int64")
        code = np.zeros(len(rows), dtype="int64")
        for bit in range(bits - 1, -1, -1):
            for dim in range(dims):
                code = (code << 1) | ((cells[:, dim] >> bit) & 1)
        return pd.Series(code)

    return place


def _boxes(df: DataFrame, by: str, lo: str, hi: str) -> DataFrame:
    return (
        df.groupBy(by)
        .agg(
            Summarizer.min(array_to_vector(lo)).alias("_lo"),
            Summarizer.max(array_to_vector(hi)).alias("_hi"),
        )
        .select(by, vector_to_array("_lo").alias("lo"), vector_to_array("_hi").alias("hi"))
    )


def _nearest(
    queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, limits: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(query row, id, distance)`` of the ``k`` nearest points within each query's limit,
    ordered by distance and then id."""
    found = []
    step = max(1, _CELLS // len(points))
    for start in range(0, len(queries), step):
        part = queries[start : start + step]
        squares = np.zeros((len(part), len(points)))
        for dim in range(points.shape[1]):
            squares += (part[:, dim, None] - points[None, :, dim]) ** 2
        take = min(k, len(points))
        bound = np.partition(squares, take - 1, axis=1)[:, take - 1]
        # A little slack: squares that differ may have equal roots, and then the id decides.
        bound = np.minimum(bound, limits[start : start + step] ** 2) * (1 + 1e-12)
        row, col = np.nonzero(squares <= bound[:, None])
        distance = np.sqrt(squares[row, col])
        order = np.lexsort((ids[col], distance, row))
        row, col, distance = row[order], col[order], distance[order]
        rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(part)))[row]
        kept = rank < take
        found.append((row[kept] + start, ids[col[kept]], distance[kept]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _per_query(rows: np.ndarray, ids: np.ndarray, distances: np.ndarray, count: int) -> dict:
    """The found rows, already in order of their query, as one array per query."""
    cuts = np.searchsorted(rows, np.arange(1, count))
    return {"distances": np.split(distances, cuts), "ids": np.split(ids, cuts)}


def _near_column():
    pair = F.zip_with(
        "distances", "ids", lambda d, i: F.struct(d.alias("distance"), i.alias("vid"))
    )
    return pair.alias("near")


def _within_block(k: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        points, ids = matrix(block["vec"]), block["vid"].to_numpy()
        found = _nearest(points, points, ids, k, np.full(len(ids), np.inf))
        return block.assign(**_per_query(*found, len(ids)))

    return run


def _route(lo: np.ndarray, hi: np.ndarray, targets: np.ndarray, skip_own: bool):
    """For each point, the boxes that its current k-th distance reaches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, _CELLS // len(targets))
        for batch in batches:
            for start in range(0, len(batch), step):
                part = batch.iloc[start : start + step]
                points = matrix(part["vec"])
                squares = np.zeros((len(part), len(targets)))
                for dim in range(points.shape[1]):
                    x = points[:, dim, None]
                    squares += np.maximum(np.maximum(lo[:, dim] - x, x - hi[:, dim]), 0.0) ** 2
                reached = squares <= (part["reach"].to_numpy() ** 2 * (1 + 1e-12))[:, None]
                if skip_own:
                    reached &= part["block"].to_numpy()[:, None] != targets[None, :]
                row, col = np.nonzero(reached)
                yield part.iloc[row].assign(target=targets[col])

    return run


def _scan(k: int):
    """Blocks and their visitors, sorted so that a block's points come before its visitors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, points, ids = None, [], None, None
        for batch in batches:
            for place, rows in batch.groupby(["block", "_salt", "visitor"], sort=True):
                if place[:2] != current:
                    current, held, points = place[:2], [], None
                if not place[2]:
                    held.append(rows)
                    continue
                if points is None:
                    points = np.concatenate([matrix(h["vec"]) for h in held])
                    ids = np.concatenate([h["vid"].to_numpy() for h in held])
                found = _nearest(matrix(rows["vec"]), points, ids, k, rows["reach"].to_numpy())
                lists = _per_query(*found, len(rows))
                result = pd.DataFrame({"vid": rows["vid"].to_numpy(), **lists})
                yield result[result["ids"].map(len) > 0]

    return run


def neighborhood(
    df: DataFrame,
    key: str,
    vector: str,
    k: int,
    block_rows: int = BLOCK_ROWS,
    route_bytes: int = ROUTE_BYTES,
    min_hot_rows: int = 100_000,
) -> Neighborhood:
    """The ``k + 1`` nearest distinct points of every distinct point, itself included."""
    points, has_copies = distinct_points(df, key, vector, k)
    size = points.groupBy(F.lit(0).alias("_all")).agg(  # no row for an empty table, which has no box
        F.count("*").alias("n"),
        vector_to_array(Summarizer.min(array_to_vector("vec"))).alias("lo"),
        vector_to_array(Summarizer.max(array_to_vector("vec"))).alias("hi"),
    ).first()
    if size is None:
        pairs = "array<struct<distance:double,vid:bigint>>"
        return Neighborhood(points, points.select("vid", F.array().cast(pairs).alias("near")), False)

    place = _curve(np.array(size.lo), np.array(size.hi))
    parts = max(1, size.n // (32 * block_rows))
    leaves = materialize(
        points.select("vid", "vec", place("vec").alias("_place"))
        .repartitionByRange(parts, "_place", "vid")
        .sortWithinPartitions("_place", "vid")
        # Runs of block_rows neighbours on the curve; the partition number is in the high bits.
        .withColumn("block", F.expr(f"monotonically_increasing_id() div {block_rows}"))
        .drop("_place"),
        "blocks",
    )
    local = materialize(
        leaves.groupBy("block").applyInPandas(
            _within_block(k + 1), f"vid bigint, vec array<double>, block bigint, {_FOUND}"
        ),
        "own-block",
    )
    lists = local.select("vid", _near_column())
    if size.n > block_rows:
        boxes = materialize(_boxes(leaves, "block", "vec", "vec"), "boxes")
        n_blocks = boxes.count()
        visits = _visits(local, boxes, n_blocks, len(size.lo), k, route_bytes, min_hot_rows)
        hot = hot_keys(visits, ["block"], min_hot_rows)
        held = replicate(leaves, hot, ["block"]).select(
            "block", "_salt", F.lit(False).alias("visitor"), "vid", "vec", F.lit(0.0).alias("reach")
        )
        visiting = spread(visits, hot, ["block"], by=["vid"]).select(
            "block", "_salt", F.lit(True).alias("visitor"), "vid", "vec", "reach"
        )
        found = (
            held.unionByName(visiting)
            .repartition("block", "_salt")
            .sortWithinPartitions("block", "_salt", "visitor")
            .mapInPandas(_scan(k + 1), f"vid bigint, {_FOUND}")
            .select("vid", _near_column())
        )
        lists = _merge(lists.unionByName(found), k)
        lists = materialize(lists, "neighbor-lists")
    return Neighborhood(points, lists, has_copies)


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """One list per point out of those from each block it visited. A remote point may visit very
    many blocks, so its candidates are cut to ``k + 1`` per partition before they meet."""
    order = Window.partitionBy("vid").orderBy("distance", "near_vid")
    pair = F.struct("distance", F.col("near_vid").alias("vid"))
    return (
        lists.select("vid", F.explode("near").alias("_e"))
        .select("vid", "_e.distance", F.col("_e.vid").alias("near_vid"))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= k + 1)
        .groupBy("vid")
        .agg(F.array_sort(F.collect_list(pair)).alias("near"))
    )


def _visits(
    local: DataFrame,
    boxes: DataFrame,
    n_blocks: int,
    dims: int,
    k: int,
    route_bytes: int,
    min_hot_rows: int,
) -> DataFrame:
    """``(vid, vec, reach, block)``: which other blocks each point has to look into."""
    reach = F.coalesce(F.get("distances", F.lit(k)), F.lit(float("inf")))
    asking = local.select("vid", "vec", "block", reach.alias("reach"))
    schema = "vid bigint, vec array<double>, block bigint, reach double, target bigint"
    most = max(2, route_bytes // (16 * dims))
    fan = -(-n_blocks // most)
    if fan > 1:
        boxes = number_rows(boxes, [F.col("block")]).withColumn(
            "parent", F.expr(f"ordinal div {fan}")
        )
        top = _boxes(boxes, "parent", "lo", "hi").withColumnRenamed("parent", "block")
    else:
        top = boxes
    rows = top.select("block", "lo", "hi").collect()  # at most ``most`` rows
    route = _route(
        np.array([r.lo for r in rows]),
        np.array([r.hi for r in rows]),
        np.array([r.block for r in rows]),
        skip_own=fan == 1,
    )
    routed = asking.mapInPandas(route, schema)
    if fan > 1:
        children = boxes.select(
            F.col("parent").alias("target"), F.col("block").alias("child"), "lo", "hi"
        )
        outside = F.zip_with(
            F.zip_with("vec", "lo", lambda x, lo: lo - x),
            F.zip_with("vec", "hi", lambda x, hi: x - hi),
            lambda below, above: F.pow(F.greatest(below, above, F.lit(0.0)), 2),
        )
        square = F.aggregate(outside, F.lit(0.0), lambda a, b: a + b)
        routed = (
            skew_join(
                materialize(routed, "routes"), children, ["target"], ["vid"], min_rows=min_hot_rows
            )
            .where(
                (F.col("child") != F.col("block"))
                & (square <= F.pow("reach", 2) * (1 + 1e-12))
            )
            .withColumn("target", F.col("child"))
        )
    return materialize(
        routed.select("vid", "vec", "reach", F.col("target").alias("block")), "visits"
    )


def point_entries(hood: Neighborhood, k: int) -> DataFrame:
    """``(vid, entries)``: the ``k + 1`` nearest rows of each distinct point, copies included, as
    ``(distance, id, vid)``."""
    if not hood.has_copies:
        return hood.lists.select(
            "vid",
            F.transform(
                "near",
                lambda e: F.struct(e["distance"].alias("distance"), e["vid"].alias("id"),
                                   e["vid"].alias("near_vid")),
            ).alias("entries"),
        )
    near = hood.lists.select("vid", F.explode("near").alias("_e")).select(
        "vid", "_e.distance", F.col("_e.vid").alias("near_vid")
    )
    members = hood.points.select(F.col("vid").alias("near_vid"), "members")
    entry = F.struct("distance", "id", "near_vid")
    return (
        near.join(members, "near_vid")
        .select("vid", "near_vid", "distance", F.explode("members").alias("id"))
        .groupBy("vid")
        .agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("entries"))
    )


def for_every_row(
    df: DataFrame, key: str, vector: str, hood: Neighborhood, facts: DataFrame, how: str = "inner"
) -> DataFrame:
    """``facts`` about distinct points (keyed by ``vid``) for every row of ``df``: ``key`` and the
    columns of ``facts``. A vector with very many copies is split over many tasks."""
    if not hood.has_copies:
        return (
            df.select(F.col(key).cast("long").alias(key))
            .join(facts, F.col(key) == F.col("vid"), how)
            .drop("vid")
        )
    rows = df.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vec"))
    by_vector = hood.points.select("vid", "vec").join(facts, "vid", how).drop("vid")
    return skew_join(rows, by_vector, ["vec"], by=[key], how=how).drop("vec")


def knn(df: DataFrame, key: str, vector: str, k: int, **options) -> DataFrame:
    """``(key, rank, neighbor_id, distance)``: the ``k`` nearest other rows of every row.

    Euclidean distance, exact; equal distances are ordered by id.
    """
    hood = neighborhood(df, key, vector, k, **options)
    listed = for_every_row(df, key, vector, hood, point_entries(hood, k))
    others = F.slice(F.filter("entries", lambda e: e["id"] != F.col(key)), 1, k)
    return listed.select(key, F.posexplode(others).alias("_pos", "_e")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_e.id").alias("neighbor_id"),
        F.col("_e.distance").alias("distance"),
    )


def core_distance(
    df: DataFrame, key: str, vector: str, min_samples: int, **options
) -> DataFrame:
    """``(key, core_distance)``: how far the ``min_samples``-th nearest other row is.

    Rows with fewer other rows than that have none.
    """
    hood = neighborhood(df, key, vector, min_samples, **options)
    core = point_entries(hood, min_samples).select(
        "vid", F.get("entries", F.lit(min_samples))["distance"].alias("core_distance")
    )
    return for_every_row(df, key, vector, hood, core)
