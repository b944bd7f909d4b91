"""Links between similar items that share keys, without writing out all pairs of a key's items."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.components import contract
from voxtally.operators.skew import fits_broadcast
from voxtally.session import materialize

Fits = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def shared_keys(postings: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The rows of ``(key, id, …)`` whose key another id has too, with ``l``: the key's first row.

    Ids are hashes, so the first of a key is a random one.
    """
    ordered = Window.partitionBy("key").orderBy("id")
    rows = postings.select(
        "key",
        "id",
        *carry,
        F.lag("id").over(ordered).alias("_before"),
        F.lead("id").over(ordered).alias("_after"),
        F.first(F.struct("id", *carry)).over(ordered).alias("l"),
    )
    return materialize(
        rows.where("_before <> id OR _after <> id").drop("_before", "_after"), "shared"
    )


def link_items(
    shared: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    carry: Sequence[str] = (),
    fits: Fits | None = None,
    *,
    last: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """``(node, component)`` of the ids that have a link.

    ``shared`` comes from :func:`shared_keys`; ``verify`` takes pairs ``(a, b)`` and returns those
    that are links; ``fits`` says of two rows of a key whether the pair may be a link at all.

    A pair within one component says nothing new, so groups of similar items are joined by few
    pairs. Every id first meets the leader that it shares most keys with: the first id of a key, and
    then, for keys whose ids still lie in several components, the id that meets most others by them.
    What is left after that are pairs of a key from different components; these are tried without
    exception by ``last``, which takes rows ``(key, id, component, …)`` and returns links. Groups of
    copies thus cost about as many pairs as they have members.
    """
    links = tried = components = None
    rows = shared
    for step in range(3):
        if components is not None:
            rows = _still_apart(shared, components)
        if step < 2:
            pairs = _pairs_with_leaders(_led_by_degree(rows, carry) if step else rows, fits)
        else:
            found = materialize(last(rows.withColumn("component", _component(rows)).drop("l")), "links")
            if not found.isEmpty():
                links = found if links is None else links.union(found)
                components = materialize(contract(links)[0], "components")
            break
        if tried is not None:
            both = tried.union(tried.select("b", "a"))
            pairs = pairs.join(both, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = materialize(verify(pairs), "links")
        links = found if links is None else links.union(found)
        tried = pairs if tried is None else tried.union(pairs)
        components = materialize(contract(links)[0], "components")
    if components is None:
        nothing = shared.select(F.col("id").alias("node"), F.col("id").alias("component")).limit(0)
        return materialize(nothing, "components")
    return components


def _component(rows: DataFrame) -> Column:
    return F.col("component") if "component" in rows.columns else F.col("id")


def small(df: DataFrame) -> DataFrame:
    """A written table of narrow rows, to be broadcast while its checked size allows."""
    return F.broadcast(df) if fits_broadcast(df, row_bytes=64) else df


def _still_apart(shared: DataFrame, components: DataFrame) -> DataFrame:
    """The rows of keys whose ids lie in several components."""
    named = small(components.withColumnRenamed("node", "id"))
    rows = shared.join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))
    apart = (
        rows.groupBy("key")
        .agg(F.min("component").alias("_low"), F.max("component").alias("_high"))
        .where("_low < _high")
        .select("key")
    )
    return materialize(rows.join(small(materialize(apart, "keys")), "key", "left_semi"), "apart")


def _led_by_degree(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The rows with another leader: of each key's ids the one that meets most others."""
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    degrees = rows.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("degree"))
    rows = rows.drop("l").withColumn("component", _component(rows)).join(degrees, "id")
    leader = F.struct("id", *carry, _component(rows).alias("component"))
    leaders = rows.groupBy("key").agg(F.max_by(leader, F.struct("degree", "id")).alias("l"))
    return rows.join(leaders, "key").where(F.col("component") != F.col("l.component"))


def _pairs_with_leaders(rows: DataFrame, fits: Fits | None) -> DataFrame:
    """``(a, b)``: each id with the leader ``b`` that it shares most keys with."""
    met = rows.where(F.col("id") != F.col("l.id"))
    if fits:
        met = met.where(fits(lambda c: F.col(c), lambda c: F.col(f"l.{c}")))
    counted = met.groupBy(F.col("id").alias("a"), F.col("l.id").alias("b")).agg(F.count("*").alias("n"))
    return counted.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))


ROWS = 256  # ids of a key in one block


def blocked_links(
    rows: DataFrame,
    items: DataFrame,
    grams: Callable[[bytes], np.ndarray],
    percent: int,
    block: int = ROWS,
) -> DataFrame:
    """Links between ids of a key from different components, without pairs as rows.

    The ids of a key are dealt into blocks; each two blocks meet in one task, as an incidence matrix
    of their items and grams, whose product with itself counts all overlaps. Of the links found only
    as many are given on as join components.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = (
        rows.join(sizes, "key")
        .withColumn("own", own)
        .select("key", "id", "component", "own", F.explode(others).alias("other"))
        .select("key", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )

    def multiply(group: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        sets = [grams(expand(blob)) for blob in group["blob"].to_pylist()]
        sizes = np.array([len(x) for x in sets])
        kinds, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        overlap = np.zeros((len(sets), len(sets)), dtype=np.float32)
        for start in range(0, len(kinds), COLUMNS):
            here = (column >= start) & (column < start + COLUMNS)
            part = np.zeros((len(sets), min(COLUMNS, len(kinds) - start)), dtype=np.float32)
            part[row[here], column[here] - start] = 1
            overlap += part @ part.T
        overlap = overlap.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - overlap
        label = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
        a, b = np.nonzero(np.triu((overlap * 100 >= percent * union) & (overlap > 0), 1))
        root = list(range(int(label.max()) + 1))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        kept = []
        for x, y in zip(a.tolist(), b.tolist()):
            p, q = find(int(label[x])), find(int(label[y]))
            if p != q:
                root[p] = q
                kept.append((x, y))
        ids = group["id"].to_numpy()
        at = np.array(kept, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(ids[at[:, 0]]), "b": pa.array(ids[at[:, 1]])})

    return (
        dealt.join(items, "id")
        .groupBy("key", "i", "j")
        .applyInArrow(multiply, "a bigint, b bigint")
        .distinct()
    )


COMPARE_BYTES = 4 << 20  # bytes of pairs that are compared together
COLUMNS = 4_096  # grams that a block of the incidence matrix has at once


def squeeze(texts: list[bytes]) -> list[bytes]:
    """Compressed texts: what is compared travels with every pair it is in."""
    compress = zstandard.ZstdCompressor(level=1).compress
    return [compress(t) for t in texts]


def ids_of(pairs: DataFrame) -> DataFrame:
    """The distinct ids of pairs, as a written table."""
    return materialize(
        pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids"
    )


def verify_pairs(pairs: DataFrame, items: DataFrame, similar: Callable[[list[bytes], list[bytes]], Sequence[bool]]) -> DataFrame:
    """The pairs ``(a, b)`` whose items ``(id, blob)`` are similar, which ``similar`` says of many at once.

    ``b`` repeats more often than ``a``: the items of ``a`` go to where the item of ``b`` is, once
    per pair, and those of ``b`` once each.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            left, right, held, kept = [], [], 0, []
            for x, y in zip(batch["left"], batch["right"]):
                left.append(expand(x.as_py()))
                right.append(expand(y.as_py()))
                held += len(left[-1]) + len(right[-1])
                if held >= COMPARE_BYTES:
                    kept.extend(similar(left, right))
                    left, right, held = [], [], 0
            kept = pa.array([*kept, *similar(left, right)], pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch["a"].filter(kept), batch["b"].filter(kept)], names=["a", "b"]
            )

    seconds = materialize(pairs.select("b").distinct(), "seconds")
    left = items.select(F.col("id").alias("a"), F.col("blob").alias("left")).join(small(pairs), "a")
    right = items.select(F.col("id").alias("b"), F.col("blob").alias("right"))
    right = right.join(small(seconds), "b", "left_semi")
    return left.join(right, "b").mapInArrow(check, "a bigint, b bigint").distinct()
