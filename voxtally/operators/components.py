"""Connected components by contracting the graph, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtally.session import materialize


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: the lowest node each node is connected to.

    ``nodes`` has the column ``node``, ``edges`` the columns ``a`` and ``b`` in either direction;
    nulls and loops in ``edges`` are ignored, and nodes may be of any type that has an order.

    In each round nodes get fresh random ranks, every node moves to the lowest rank within two
    steps, and the moved nodes become the next, smaller graph. The order of the nodes has no
    influence, so a path with ordered ids shrinks by a constant factor per round like any other
    graph. The moves of a round are a written table; they are composed from the last round back to
    the first, and their sizes fall geometrically. Keys with many rows (hubs, large components) are
    combined on the map side in the aggregates and split by adaptive skew joins.
    """
    found, _ = contract(edges)
    return (
        nodes.join(found, "node", "left")
        .select("node", F.coalesce("component", "node").alias("component"))
    )


def contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """``(node, component)`` of the nodes that have an edge, and the number of rounds."""
    graph = materialize(_both_ways(edges.select("a", "b")), "edges")
    moves: list[DataFrame] = []
    while not graph.isEmpty():
        move = materialize(_moves(graph, len(moves)), "moves")
        moves.append(move)
        graph = materialize(
            _both_ways(
                graph.join(move.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a")
                .join(move.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
                .select(F.col("_a").alias("a"), F.col("_b").alias("b"))
            ),
            "edges",
        )
    if not moves:
        node = graph.select(F.col("a").alias("node"))
        return node.withColumn("component", F.col("node")), 0
    roots = moves[-1]
    for move in reversed(moves[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        roots = materialize(
            move.join(later, "root", "left").select(
                "node", F.coalesce("_next", "root").alias("root")
            ),
            "roots",
        )
    lowest = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(lowest, "root").select("node", "component"), len(moves)


def _both_ways(edges: DataFrame) -> DataFrame:
    edges = edges.where("a <> b")
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _moves(graph: DataFrame, turn: int) -> DataFrame:
    """Where each node goes: the lowest rank within two steps of it."""

    def ranked(node: str) -> Column:
        return F.struct(F.xxhash64(node, F.lit(turn)).alias("rank"), F.col(node).alias("node"))

    near = graph.groupBy("a").agg(F.min(ranked("b")).alias("_near"))
    near = near.select("a", F.least("_near", ranked("a")).alias("_near"))
    beyond = (
        graph.join(near.withColumnRenamed("a", "b"), "b")
        .groupBy("a")
        .agg(F.min("_near").alias("_far"))
    )
    return near.join(beyond, "a").select(
        F.col("a").alias("node"), F.least("_near", "_far")["node"].alias("root")
    )
