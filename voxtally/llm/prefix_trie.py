"""The prefix trie of conversations, with totals of whole subtrees rolled up in bands of depth."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.tables import table
from voxtally.session import materialize, scratch

BAND = 16  # depths that one step rolls up
HEADS = 5  # conversations of so many neighbouring ids share the head of the first
SPLITS = 9  # heads have fewer turns than this
HEAD = 32  # characters that say how turns of one number are ordered
CHUNK = 512  # ids that are joined before they are hashed

KEY = ("k1", "k2")
_LIMBS = ("s0", "s1", "s2", "s3")
_LOW = 0xFFFFFFFF
_SUPER = 256  # bands whose sums are added up together


def place_turns(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv_id, at, x1, x2, bytes)``: each conversation's turns from 1, as hash and size.

    Order is by turn number (null first), then by the first ``HEAD`` characters of role and text, then
    by hash. One range partitioning by all of that, without the texts, sees to it that neither a long
    conversation nor a turn that is repeated very often ends in one task; a run that goes on from an
    earlier partition starts at the sum of what was before.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).cast("bigint").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.left(role, F.lit(HEAD)).alias("role"),
        F.left(text, F.lit(HEAD)).alias("text"),
        F.xxhash64(role, text).alias("x1"),
        F.xxhash64(F.lit(1), role, text).alias("x2"),
        F.octet_length(text).cast("bigint").alias("bytes"),
        F.monotonically_increasing_id().alias("copy"),  # so that equal rows can be dealt out
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), *map(F.col, ("role", "text", "x1", "x2", "copy"))]
    placed = materialize(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select(
            "conv_id",
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("row"),
            "x1",
            "x2",
            "bytes",
        ),
        "turns",
    )
    # One row per conversation and partition it reaches into, so windows are as short as partitions are few.
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("conv_id", "part")
        .agg(F.count("*").alias("n"), F.min("row").alias("first"))
        .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1)
    )
    return placed.join(starts.select("conv_id", "part", "start"), ["conv_id", "part"]).select(
        "conv_id", (F.col("row") + F.col("start")).alias("at"), "x1", "x2", "bytes"
    )


def share_heads(placed: DataFrame) -> DataFrame:
    """``(conv_id, size, at, x1, x2, bytes)``: conversations rebuilt on the head of a neighbour, each
    with an empty turn 0, which is the root.

    The first ``h`` turns of conversation ``c`` become those of ``c - c % 5`` (all if it has fewer,
    none if it is absent; the remainder has the sign of ``c``), where ``h`` is the CRC-32 of ``c`` in
    decimal, modulo 9.
    """
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % HEADS).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % SPLITS).alias("h"),
    )
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn(
        "head", F.least("h", F.coalesce("n_base", F.lit(0)))
    )
    size = (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")
    convs = materialize(convs.select("conv_id", "base", "h", "head", size), "conversations")
    own = (
        placed.join(convs, "conv_id")
        .where("at > h")
        .select("conv_id", "size", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "x1", "x2", "bytes")
    )
    # At most 8 turns of a base meet at most 9 conversations.
    first = placed.where(F.col("at") < SPLITS).withColumnRenamed("conv_id", "base")
    head = first.join(convs, "base").where("at <= head").select("conv_id", "size", "at", "x1", "x2", "bytes")
    zero = F.lit(0).cast("bigint")
    root = convs.select("conv_id", "size", *(zero.alias(c) for c in ("at", "x1", "x2", "bytes")))
    return own.unionByName(head).unionByName(root)


def _key(at, sums):
    text = F.concat_ws(",", at, *(s.cast("string") for s in sums))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def segments(turns: DataFrame, band: int = BAND) -> DataFrame:
    """``(conv_id, size, band, above, items)``: the nodes on a conversation's path, a band in a row.

    ``items`` has ``(depth, k1, k2, bytes)`` in order and ``above`` the key of the parent of the
    first. A node's key hashes the sum of its turns' hashes, each taken with its place: the sum
    within the band plus the sums of the bands before it.
    """
    placed = [F.xxhash64(F.lit(seed), "at", "x1", "x2") for seed in (1, 2)]
    limbs = [p for h in placed for p in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]
    inside = Window.partitionBy("conv_id", "band").orderBy("at")
    rows = (
        turns.withColumn("band", F.expr(f"at div {band}"))
        .withColumns(dict(zip(_LIMBS, limbs)))
        .withColumns({s: F.sum(s).over(inside) for s in _LIMBS})
    )
    item = F.struct(F.col("at").alias("depth"), *_LIMBS, "bytes")
    bands = materialize(
        rows.groupBy("conv_id", "band")
        .agg(F.any_value("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items")),
        "bands",
    )
    # Only conversations of several bands have anything before a band; those are added up in two steps.
    last = F.element_at("items", -1)
    sums = bands.where(F.col("size") >= band).select(
        "conv_id", "band", F.expr(f"band div {_SUPER}").alias("super"), *(last[s].alias(s) for s in _LIMBS)
    )

    def before(*by: str, order: str) -> dict:
        window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return {f"{s}_{order}": F.coalesce(F.sum(s).over(window), F.lit(0)) for s in _LIMBS}

    supers = sums.groupBy("conv_id", "super").agg(*(F.sum(s).alias(s) for s in _LIMBS))
    supers = supers.withColumns(before("conv_id", order="super")).drop(*_LIMBS)
    totals = (
        sums.withColumns(before("conv_id", "super", order="band"))
        .join(supers, ["conv_id", "super"])
        .select("conv_id", "band", *((F.col(f"{s}_band") + F.col(f"{s}_super")).alias(s) for s in _LIMBS))
    )
    joined = bands.join(totals, ["conv_id", "band"], "left").withColumns(
        {s: F.coalesce(s, F.lit(0)) for s in _LIMBS}
    )
    keyed = F.transform(
        "items",
        lambda x: F.struct(x["depth"].alias("depth"), *_key(x["depth"], [x[s] + F.col(s) for s in _LIMBS]), x["bytes"].alias("bytes")),
    )
    above = F.struct(*_key(F.col("band") * band - 1, [F.col(s) for s in _LIMBS]))
    return materialize(
        joined.select("conv_id", "size", "band", above.alias("above"), keyed.alias("items")), "segments"
    )


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(paths: DataFrame, nodes: DataFrame, band: int, name: str = "totals") -> DataFrame:
    """``(k1, k2, leaves, saved)``: the sums over each node's subtree, the node itself included.

    ``nodes`` has ``(conv_id, depth, k1, k2, leaves, saved)`` with the lowest conversation of each
    node, ``paths`` ``(conv_id, band, items)`` with the ``(depth, k1, k2)`` of each conversation.

    A node gives to its ancestors in its band only, and nodes of one conversation in one band give
    together, so a band makes at most as many rows as it has depths. The roots of the bands are a
    tree of their own, of a ``band``-th of the depth, whose totals come by the same step; a
    completed root then gives to the band above it. Rounds grow with the logarithm of the depth.
    """
    own = nodes.groupBy("conv_id", F.expr(f"depth div {band}").alias("band")).agg(
        F.collect_list(F.struct("depth", "leaves", "saved")).alias("own")
    )

    def upto(depth, value: str):
        below = F.filter("own", lambda o: o["depth"] >= depth)
        return F.aggregate(below, F.lit(0).cast("bigint"), lambda a, o: a + o[value]).alias(value)

    given = F.transform(
        "items",
        lambda x: F.struct(x["k1"].alias("k1"), x["k2"].alias("k2"), upto(x["depth"], "leaves"), upto(x["depth"], "saved")),
    )
    within = _sums(own.join(paths, ["conv_id", "band"]).select(F.explode(given).alias("g")).select("g.*"))
    within = materialize(within, name)
    if nodes.where(F.col("depth") >= band).isEmpty():
        return within
    roots = nodes.where(F.col("depth") % band == 0).select(
        "conv_id", F.expr(f"depth div {band}").alias("depth"), *KEY
    )
    roots = materialize(roots.join(within, list(KEY)), f"{name}-roots")
    first = F.col("items")[0]
    steps = paths.select("conv_id", F.struct(F.col("band").alias("depth"), first["k1"].alias("k1"), first["k2"].alias("k2")).alias("item"))
    upper = materialize(
        steps.groupBy("conv_id", F.expr(f"item.depth div {band}").alias("band")).agg(
            F.array_sort(F.collect_list("item")).alias("items")
        ),
        f"{name}-paths",
    )
    whole = subtree_totals(upper, roots, band, f"{name}-up")
    complete = roots.where("depth > 0").drop("leaves", "saved").join(whole, list(KEY))
    passed = (
        complete.select("conv_id", (F.col("depth") - 1).alias("band"), "leaves", "saved")
        .join(paths, ["conv_id", "band"])
        .select(F.explode("items").alias("x"), "leaves", "saved")
        .select("x.k1", "x.k2", "leaves", "saved")
    )
    return materialize(_sums(within.unionByName(passed)), f"{name}-all")


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ends in runs of at most ``CHUNK`` ids of one node, each as one text."""
    for batch in batches:
        k1, k2, conv = (batch[c].to_numpy() for c in (*KEY, "conv_id"))
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))))
        sizes = np.diff(np.append(starts, len(conv)))
        pieces = -(-sizes // CHUNK)
        cuts = np.repeat(starts, pieces) + CHUNK * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        ids = pa.ListArray.from_arrays(
            pa.array(np.append(cuts, len(conv)), pa.int32()), batch["conv_id"].cast(pa.string())
        )
        columns = [pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(conv[cuts]), pc.binary_join(ids, ",")]
        yield pa.RecordBatch.from_arrays(columns, names=[*KEY, "first", "ids"])


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and the hash of their ids, from texts sorted by node and first id."""
    current, running, out = None, None, []
    for batch in batches:
        for k1, k2, ids in zip(*(batch[c].to_pylist() for c in (*KEY, "ids"))):
            if (k1, k2) != current:
                if current:
                    out.append((*current, running.hexdigest()))
                current, running = (k1, k2), hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if len(out) >= 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])
            out = []
    if current:
        out.append((*current, running.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*KEY, "ends_sha256"])


def hash_ends(paths: DataFrame, band: int) -> DataFrame:
    """``(k1, k2, ends_sha256)`` of the nodes at which conversations end.

    The ids of a node are sorted and joined by many tasks; a hash of one long text can only be taken
    in order, so that step streams the joined pieces, and holds one of them at a time.
    """
    at_end = F.element_at("items", -1)
    ends = materialize(
        paths.where(F.col("band") == F.expr(f"size div {band}")).select(
            at_end["k1"].alias("k1"), at_end["k2"].alias("k2"), "conv_id"
        ),
        "ends",
    )
    by = [*KEY, "conv_id"]
    joined = ends.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _join_ids, "k1 bigint, k2 bigint, first bigint, ids string"
    )
    return (
        joined.repartition(*KEY)
        .sortWithinPartitions(*KEY, "first")
        .mapInArrow(_hash_ids, "k1 bigint, k2 bigint, ends_sha256 string")
    )


def prefix_trie(
    turns: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    band: int = BAND,
    share: bool = False,
) -> DataFrame:
    """One row per node of the trie of all conversations: a node is a distinct sequence of first turns.

    Columns, all long but the last: ``conv_id`` the lowest conversation that begins with the
    sequence, ``depth`` its turns, ``parent_conv_id`` that of the node one turn shorter (null at the
    root), ``n_convs`` how many begin with it, ``n_children``, ``n_leaves`` of its subtree (a leaf has
    one), ``saved_tokens`` the UTF-8 bytes that sharing saves in its subtree (every node's last text,
    once for each conversation but one), ``ends_sha256`` the hash of the ids that end there.
    ``(conv_id, depth)`` is unique. ``share`` first rebuilds the conversations (:func:`share_heads`).

    Null roles and texts are empty, turns of one number are ordered as :func:`place_turns` says and
    repeated rows are turns of their own; rows without a conversation are left out; no conversations give no rows, a
    conversation without turns (after rebuilding) ends at the root. Identity of turns and sequences
    rests on 128-bit hashes. Long conversations are paths of bands, see :func:`subtree_totals`.
    """
    with scratch(turns.sparkSession) as keep:
        placed = materialize(place_turns(turns, conversation, turn, role, text), "placed")
        if share:
            rebuilt = share_heads(placed)
        else:
            sizes = placed.groupBy("conv_id").agg(F.count("*").alias("size"))
            zero = F.lit(0).cast("bigint")
            root = sizes.select("conv_id", "size", *(zero.alias(c) for c in ("at", "x1", "x2", "bytes")))
            rebuilt = placed.join(sizes, "conv_id").unionByName(root)
        paths = segments(rebuilt, band)
        seen = paths.select("conv_id", "size", F.explode("items").alias("x")).select(
            "conv_id", "size", "x.*"
        )
        nodes = seen.groupBy("depth", *KEY).agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.max("bytes").alias("bytes"),
            F.max("size").alias("deepest"),
        )
        leaf = (F.col("deepest") == F.col("depth")).cast("bigint").alias("leaves")
        saved = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")
        nodes = materialize(nodes.select("conv_id", "depth", *KEY, "n_convs", leaf, saved), "nodes")
        totals = subtree_totals(
            paths.select("conv_id", "band", "items"), nodes.drop("n_convs"), band
        )
        # A conversation is the lowest of all nodes of its path from some depth on; the parent of the
        # first of them belongs to a lower conversation, the other parents to the same one.
        links = materialize(_parents(paths, nodes, band), "parents")
        lowest = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
        entered = links.where("entry").join(lowest, ["p1", "p2"]).select(*KEY, "parent")
        children = links.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
            F.count("*").alias("n_children")
        )
        ends = hash_ends(paths, band)
        nothing = hashlib.sha256(b"").hexdigest()
        found = (
            nodes.select("conv_id", "depth", *KEY, "n_convs")
            .join(totals, list(KEY))
            .join(children, list(KEY), "left")
            .join(entered, list(KEY), "left")
            .join(ends, list(KEY), "left")
        )
        parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
        return keep(
            materialize(
                found.select(
                    "conv_id",
                    "depth",
                    parent.alias("parent_conv_id"),
                    "n_convs",
                    F.coalesce("n_children", F.lit(0).cast("bigint")).alias("n_children"),
                    F.col("leaves").alias("n_leaves"),
                    F.col("saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
                ),
                "trie",
            )
        )


def _parents(paths: DataFrame, nodes: DataFrame, band: int) -> DataFrame:
    """``(k1, k2, p1, p2, entry)``: every node but the root with its parent, and whether it is the
    first node of its lowest conversation."""
    first = nodes.groupBy("conv_id").agg(F.min("depth").alias("from"))
    steps = F.transform(
        "items",
        lambda x, i: F.struct(
            x["depth"].alias("depth"),
            x["k1"].alias("k1"),
            x["k2"].alias("k2"),
            F.when(i == 0, F.col("above")["k1"]).otherwise(F.get("items", i - 1)["k1"]).alias("p1"),
            F.when(i == 0, F.col("above")["k2"]).otherwise(F.get("items", i - 1)["k2"]).alias("p2"),
        ),
    )
    return (
        paths.join(first, "conv_id")
        .where(F.col("band") >= F.expr(f"`from` div {band}"))
        .select("from", F.explode(F.filter(steps, lambda s: (s["depth"] >= F.col("from")) & (s["depth"] > 0))).alias("s"))
        .select("s.k1", "s.k2", "s.p1", "s.p2", (F.col("s.depth") == F.col("from")).alias("entry"))
    )


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"), share=True)


OP11_SQL = r"""
WITH placed AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
talks AS (
    SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS turns,
           conv_id - conv_id % 5 AS base,
           xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d : ascii(d)::BIGINT)),
               lambda a, x : list_reduce(
                   list_concat([xor(a, x)], range(8)),
                   lambda c, i : xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END))),
               4294967295::BIGINT) % 9 AS h
    FROM placed GROUP BY conv_id
),
rebuilt AS (
    SELECT t.conv_id, list_concat(coalesce(b.turns, [])[1:t.h], t.turns[t.h + 1:]) AS turns
    FROM talks t LEFT JOIN talks b ON b.conv_id = t.base
),
seen AS (
    SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends
    FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)
),
nodes AS (
    SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256,
           bool_and(ends) AS leaf,
           (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE strlen(path[depth].text) END AS saved
    FROM seen GROUP BY depth, path
),
below AS (
    SELECT a.depth, a.path, count(*) FILTER (WHERE b.leaf) AS n_leaves, sum(b.saved)::BIGINT AS saved_tokens,
           count(*) FILTER (WHERE b.depth = a.depth + 1) AS n_children
    FROM nodes a JOIN nodes b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path
    GROUP BY a.depth, a.path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (depth, path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""
