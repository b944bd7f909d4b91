"""Topics of unequal density: the tree of all density levels, cut where clusters hold together longest.

A spanning forest of the neighbour graph is found in rounds of least edges. Its edges, in order of
weight, say how groups of rows merge as the density falls. That sequence is not played in one place:
edges are split at the middle of their order, the light half falls into components, each of which is
a problem of its own and one vertex of the heavy half, and so on until every problem is small. Small
problems are then solved by tasks, from the light ones to the heavy ones, and pass on only a summary.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtally.operators.clusters import NEIGHBORS, relabel_by_size
from voxtally.operators.components import contract
from voxtally.operators.neighbors import for_every_row, neighborhood, point_entries
from voxtally.operators.ordinal import number_rows
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize

GROUP_EDGES = 200_000  # edges that one task plays through

_STATE = "vertex bigint, size bigint, cluster bigint, held double, below double"
_SOLVED = f"kind string, {_STATE}, up bigint, birth double, stability double"


@dataclass(frozen=True)
class Hierarchy:
    """``topics``: ``(key, topic)``. ``clusters``: the condensed tree, one row per cluster with its
    ``parent`` (null at the top), rows ``n``, ``birth`` as a density (one over the distance),
    ``stability``, the best total ``below`` it, and whether it is ``selected``."""

    topics: DataFrame
    clusters: DataFrame


def reachability_edges(facts: DataFrame, n_neighbors: int) -> DataFrame:
    """``(a, b, w)``: neighbours and their mutual reachability, the largest of both core distances and
    the distance itself; each pair once. ``facts`` has ``(vid, entries, core)``."""
    pairs = (
        facts.where("core IS NOT NULL")
        .select(F.col("vid").alias("a"), F.col("core").alias("_a"), F.explode(F.slice("entries", 1, n_neighbors + 1)).alias("_e"))
        .select("a", "_a", F.col("_e.near_vid").alias("b"), F.col("_e.distance").alias("d"))
        .where("a <> b")
    )
    other = facts.where("core IS NOT NULL").select(F.col("vid").alias("b"), F.col("core").alias("_b"))
    met = pairs.join(other, "b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("_a", "_b", "d").alias("w")
    )
    return met.groupBy("a", "b").agg(F.min("w").alias("w"))


def spanning_forest(edges: DataFrame) -> DataFrame:
    """The edges ``(a, b, w)`` of a lightest spanning forest; equal weights go by ``a`` and ``b``.

    In each round every component picks its least edge, and components joined by a pick become one,
    so there are at most half as many in the next. Edges inside a component go, and of those between
    the same two only the least stays.
    """
    order = F.struct("w", "x", "y")
    left = materialize(edges.select("a", "b", "w", F.col("a").alias("x"), F.col("b").alias("y")), "graph")
    picked = []
    while not left.isEmpty():
        ways = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "x", "y"))
        least = ways.groupBy("a").agg(F.min_by("b", order).alias("b"), F.min(order).alias("e"))
        picks = materialize(least.select("a", "b", "e.*"), "picks")
        picked.append(picks.select("x", "y", "w").distinct())
        joined = materialize(contract(picks)[0], "joined")
        for end in ("a", "b"):
            named = joined.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))
            left = left.join(named, end)
        pair = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
        left = left.where("_a <> _b").groupBy(*pair).agg(F.min(order).alias("e")).select("a", "b", "e.*")
        left = materialize(left, "graph")
    forest = edges.limit(0)
    for picks in picked:
        forest = forest.unionByName(picks.select(F.col("x").alias("a"), F.col("y").alias("b"), "w"))
    return materialize(forest, "forest")


def split_problems(edges: DataFrame, group_edges: int) -> list[DataFrame]:
    """The numbered edges ``(a, b, o, w)`` of a forest as problems ``(g, a, b, o, w)``, in the order in
    which they are to be solved: one table per turn, of problems that do not depend on each other. A
    problem's vertices are points, or the last edge ``o`` of problems of earlier turns. A light half
    has its turn before the heavy half it was split from."""
    joined = contract(edges)[0]
    tree = edges.join(joined.select(F.col("node").alias("a"), "component"), "a")
    tops = tree.groupBy("component").agg(F.max("o").alias("g"))
    left = materialize(tree.join(tops, "component").select("g", "a", "b", "o", "w", F.lit("").alias("turn")), "problems")
    done = []
    while True:
        sizes = left.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("o", 0.5).alias("middle"))
        large = materialize(sizes.where(F.col("n") > group_edges), "large")
        small = lookup_join(left, large.select("g", "n"), ["g"], by=["o"], how="left").where("n IS NULL").drop("n")
        done.append(materialize(small, "small"))
        if large.isEmpty():
            break
        halves = lookup_join(left, large.select("g", "middle"), ["g"], by=["o"])
        light = materialize(halves.where("o <= middle").drop("middle"), "light")
        named = materialize(contract(light)[0], "light-parts")
        tops = (
            light.join(named.select(F.col("node").alias("a"), "component"), "a")
            .groupBy("component")
            .agg(F.max("o").alias("top"))
        )
        # Vertices are in one problem only, so a vertex has one light component at most.
        names = materialize(named.join(tops, "component").select("node", "top"), "names")
        inner = light.join(names.select(F.col("node").alias("a"), "top"), "a").select(
            F.col("top").alias("g"), "a", "b", "o", "w", F.concat("turn", F.lit("0")).alias("turn")
        )
        outer = halves.where("o > middle").drop("middle")
        for end in ("a", "b"):
            outer = outer.join(names.select(F.col("node").alias(end), F.col("top").alias(f"_{end}")), end, "left")
        outer = outer.select(
            "g", F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "o", "w",
            F.concat("turn", F.lit("1")).alias("turn"),
        )
        left = materialize(inner.unionByName(outer), "problems")
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    # No more turns than there are edges for so many tasks.
    turns = sorted(r.turn for r in every.select("turn").distinct().collect())
    return [every.where(F.col("turn") == t) for t in turns]


def _play(min_size: int, floor: float):
    """Play the merges of some problems, lightest first."""

    def density(w: float) -> float:
        return 1.0 / max(w, floor)

    def run(key, edges: pd.DataFrame, vertices: pd.DataFrame) -> pd.DataFrame:
        edges = edges.sort_values("o")
        # Of each component by its root: size, cluster (None while too small), the densities at which
        # the cluster's rows leave it summed up, the best total below, and vertices without a cluster.
        root, state, out = {}, {}, []
        for vertex, size, cluster, held, below in vertices[["vertex", "size", "cluster", "held", "below"]].itertuples(index=False):
            root[vertex] = vertex
            own = None if pd.isna(cluster) else int(cluster)
            state[vertex] = [int(size), own, held, below, [] if own is not None else [vertex], vertex]

        def find(v):
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        def close(cluster, parent, size, held, below, at):
            stability = held - size * at
            out.append(("cluster", cluster, size, cluster, held, below, parent, at, stability))
            return max(stability, below)

        for a, b, o, w in edges[["a", "b", "o", "w"]].itertuples(index=False):
            x, y = find(a), find(b)
            if len(state[x][4]) < len(state[y][4]):
                x, y = y, x
            root[y] = x
            at = density(w)
            (n, c, s, t, loose, _), (m, d, u, v, other, _) = state[x], state.pop(y)
            size, own, held, below = n + m, None, 0.0, 0.0
            if c is not None and d is not None:
                below = sum(sorted((close(c, o, n, s, t, at), close(d, o, m, u, v, at))))
                own, held = o, size * at
            elif c is not None or d is not None:
                own, held, below = (c, s + m * at, t) if c is not None else (d, u + n * at, v)
            elif size >= min_size:
                own, held = o, size * at
            loose += other
            if own is not None:
                out.extend(("vertex", i, 0, own, 0.0, 0.0, None, 0.0, 0.0) for i in loose)
                loose = []
            state[x] = [size, own, held, below, loose, o]
        for size, own, held, below, loose, top in state.values():
            out.append(("state", top, size, own, held, below, None, 0.0, 0.0))
            out.extend(("vertex", i, 0, None, 0.0, 0.0, top, 0.0, 0.0) for i in loose)
        names = [part.split()[0] for part in _SOLVED.split(", ")]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({"cluster": "Int64", "up": "Int64"})

    return run


def _solve(problems: list[DataFrame], points: DataFrame, min_size: int, floor: float, group_edges: int) -> DataFrame:
    """All that :func:`_play` gives, turn by turn."""
    states, solved = points, []
    for edges in problems:
        edges = materialize(edges, "edges")
        n = edges.count()
        if not n:
            continue
        # Several small problems go together; their vertices have names of their own.
        bins = -(-n // group_edges)
        edges = edges.withColumn("bin", F.pmod(F.xxhash64("g"), F.lit(bins)))
        ends = edges.select(F.col("bin").alias("own"), F.col("a").alias("vertex")).union(edges.select("bin", "b"))
        held = ends.distinct().join(states, "vertex").select("own", *states.columns)
        played = edges.groupBy("bin").cogroup(held.groupBy("own")).applyInPandas(
            _play(min_size, floor), _SOLVED
        )
        solved.append(materialize(played, "solved"))
        states = materialize(states.unionByName(solved[-1].where("kind = 'state'").select(*states.columns)), "states")
    every = points.sparkSession.createDataFrame([], _SOLVED)
    for part in solved:
        every = every.unionByName(part)
    return every


def _chains(clusters: DataFrame) -> DataFrame:
    """``(cluster, chosen)``: the topmost cluster from each one upwards that outweighs all below it.

    Links to parents double in length in every round.
    """
    step = clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("pick"), F.col("cluster")).alias("chosen"))
    step = materialize(step, "chains")
    while not step.where("up IS NOT NULL").isEmpty():
        above = step.select(F.col("cluster").alias("up"), F.col("up").alias("next"), F.col("chosen").alias("higher"))
        step = step.join(above, "up", "left").select(
            "cluster", F.col("next").alias("up"), F.coalesce("higher", "chosen").alias("chosen")
        )
        step = materialize(step, "chains")
    return step.drop("up")


def density_hierarchy(
    df: DataFrame,
    key: str = "review_id",
    vector: str = "reduced",
    min_cluster_size: int = 50,
    min_samples: int = 10,
    n_neighbors: int = NEIGHBORS,
    allow_single: bool = False,
    group_edges: int = GROUP_EDGES,
    **options,
) -> Hierarchy:
    """Topics by excess of mass over all densities, for rows whose groups differ in density.

    Rows and their ``n_neighbors`` nearest are linked at their mutual reachability (the largest of the
    distance and both distances to the ``min_samples``-th neighbour). Going from small to large
    distances, groups merge; one of at least ``min_cluster_size`` rows is a cluster, which takes up
    smaller groups and ends where it meets another cluster, both being children of what they form.
    A cluster's stability adds up over its rows the densities at which they leave it, less that at
    which it parts from its parent. Selected are the clusters whose stability is at least the best
    total below them and that are not within a selected one; their rows are the topics, numbered by
    size, and all other rows are outliers.

    Parts of the neighbour graph that are not linked meet at density zero. If all rows meet in one
    cluster, that one can be selected only with ``allow_single``. Distances of zero count as the least
    other one, equal weights go by the ids, and rows without a vector are left out. Copies of a vector
    are one point of that many rows. A task holds at most ``group_edges`` links of one problem and
    about as many of small ones.
    """
    k = max(n_neighbors, min_samples)
    hood = neighborhood(df, key, vector, k, **options)
    facts = materialize(
        point_entries(hood, k).select("vid", "entries", F.get("entries", F.lit(min_samples))["distance"].alias("core")),
        "cores",
    )
    edges = materialize(reachability_edges(facts, n_neighbors), "reachability")
    floor = edges.where("w > 0").agg(F.min("w")).first()[0] or 1.0
    forest = spanning_forest(edges)
    # Points count down from -1 in the order of their ids, merges up from 0 in the order of weights.
    numbered = number_rows(hood.points.select("vid", "copies"), [F.col("vid")], "_n")
    points = materialize(numbered.select("vid", "copies", (-1 - F.col("_n")).alias("vertex")), "vertices")
    for end in ("a", "b"):
        forest = forest.join(points.select(F.col("vid").alias(end), F.col("vertex").alias(f"v{end}")), end)
    order = [F.col("w"), F.col("a"), F.col("b")]
    forest = number_rows(forest, order, "o").select(F.col("va").alias("a"), F.col("vb").alias("b"), "o", "w")
    forest = materialize(forest, "merges")

    # Enough copies of one vector are a cluster of their own, which its rows leave last of all.
    own = F.col("copies") >= min_cluster_size
    start = materialize(
        points.select(
            "vertex",
            F.col("copies").alias("size"),
            F.when(own, F.col("vertex")).alias("cluster"),
            F.when(own, F.col("copies") / F.lit(floor)).otherwise(F.lit(0.0)).alias("held"),
            F.lit(0.0).alias("below"),
        ),
        "points",
    )
    problems = split_problems(forest, group_edges) if not forest.isEmpty() else []
    solved = materialize(_solve(problems, start, min_cluster_size, floor, group_edges), "played")

    # What has no merge above it stands at the top.
    used = solved.where("kind = 'cluster'").select("cluster")
    tops = (
        start.unionByName(solved.where("kind = 'state'").select(*start.columns))
        .where("cluster IS NOT NULL")
        .join(used, "cluster", "left_anti")
        .groupBy("cluster")
        .agg(F.max_by(F.struct("size", "held", "below"), "size").alias("last"))
        .select("cluster", "last.*")
    )
    tops = materialize(tops, "tops")
    alone = not allow_single and tops.count() == 1
    top_rows = tops.select(
        "cluster",
        F.lit(None).cast("bigint").alias("parent"),
        F.col("size").alias("n"),
        F.lit(0.0).alias("birth"),
        F.col("held").alias("stability"),
        "below",
    )
    inner = solved.where("kind = 'cluster'").select(
        "cluster", F.col("up").alias("parent"), F.col("size").alias("n"), "birth", "stability", "below"
    )
    pick = (F.col("stability") >= F.col("below")) & (F.col("parent").isNotNull() | F.lit(not alone))
    clusters = materialize(inner.unionByName(top_rows).withColumn("pick", pick), "clusters")
    chosen = _chains(clusters)

    # From each point up through components without a cluster to its first cluster.
    place = start.select("vertex", F.col("vertex").alias("at"), "cluster")
    moves = materialize(
        solved.where("kind = 'vertex'").select(F.col("vertex").alias("at"), F.col("cluster").alias("found"), F.col("up")),
        "moves",
    )
    place, more = materialize(place, "places"), bool(problems)
    while more:
        place = place.join(moves, "at", "left").select(
            "vertex", F.col("up").alias("at"), F.coalesce("cluster", "found").alias("cluster")
        )
        place = materialize(place, "places")
        more = not place.where("at IS NOT NULL AND cluster IS NULL").isEmpty()
    groups = (
        place.join(chosen, "cluster", "left")
        .join(points.select("vertex", "vid"), "vertex")
        .select("vid", F.col("chosen").alias("group"))
    )
    rows = materialize(for_every_row(df, key, vector, hood, groups, how="left"), "grouped")
    topics = relabel_by_size(rows, "group", key, 1).select(key, "topic")
    selected = clusters.join(chosen.select("cluster", "chosen"), "cluster").select(
        "cluster", "parent", "n", "birth", "stability", "below",
        F.coalesce(F.col("chosen") == F.col("cluster"), F.lit(False)).alias("selected"),
    )
    return Hierarchy(topics, selected)
