"""Exact removal of long strings that occur more than once, by sampled and merged suffixes.

Writing out every suffix, as the difference-cover construction over residues does, takes two thirds
of all positions as rows at its first level alone. Here the cover is chosen by content: a position
is sampled if its hash is the least of some window, so wherever a string of ``LENGTH`` bytes occurs,
the same places in it are sampled. Sampled suffixes are named by the bytes around them that all
strings they stand for have in common; names that occur once end the matter for all suffixes behind
them. The suffixes between samples are merged in only behind names that occur in several contexts:
there each is named by its first ``LENGTH`` bytes next to its sample's name, and equal neighbours
are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.batches import RollingHash, binary, mix, slices
from voxtally.llm.linking import small
from voxtally.llm.tables import table
from voxtally.session import materialize

LENGTH = 400
UNIT = 8  # bytes that are hashed to choose samples
BROADCAST_BYTES = 32 << 20  # most that a table of lists may measure to be broadcast
BLOCK = 1 << 20  # bytes of a text that are worked on at once


def window_of(length: int) -> int:
    """The widest window for which every string of ``length`` bytes has a sample that depends on
    the string alone, and a name of at least a quarter of it."""
    return max(2, (length - UNIT) // 4)


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or greatest) of every ``width`` neighbours."""
    pick, pad = (np.minimum, np.iinfo(np.uint64).max) if least else (np.maximum, 0)
    rows = np.full(-(-len(values) // width) * width, pad, dtype=np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = pick.accumulate(rows, axis=1).ravel()
    back = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def samples(rolling: RollingHash, size: int, window: int) -> np.ndarray:
    """Positions whose hash is the least of a window of ``window`` positions; ties all count."""
    at = np.arange(size - UNIT + 1)
    hashes = rolling.of(at, at + UNIT)
    lowest = _sliding(hashes, window, least=True)
    edge = np.zeros(window - 1, dtype=np.uint64)
    return np.flatnonzero(_sliding(np.concatenate((edge, lowest, edge)), window, least=False) == hashes)


def sampled_suffixes(text: bytes, length: int) -> np.ndarray:
    """Columns name, context, low and high: the suffixes ``low`` to ``high`` of a text stand behind
    one sample.

    A suffix stands behind the first sample that is at least ``window - 1`` bytes ahead. ``name`` is
    the hash of the bytes that strings of all suffixes that could stand there have in common, and
    ``context`` that of everything from ``low`` to the end of the string at ``high``. Long texts are
    worked on in blocks with margins.
    """
    window, found = window_of(length), []
    reach = window - 1
    margin = 2 * length + 2 * window
    for start in range(0, len(text), BLOCK):
        begin, end = max(0, start - margin), min(len(text), start + BLOCK + margin)
        part = np.frombuffer(text, dtype=np.uint8, count=end - begin, offset=begin)
        if len(part) < length:
            continue
        rolling = RollingHash(part)
        at = samples(rolling, len(part), window)
        low = np.maximum(np.concatenate(([0], at[:-1] - reach + 1)), 0)
        high = np.minimum(at - reach, len(part) - length)
        mine = (high >= low) & (at + begin >= start) & (at + begin < start + BLOCK)
        at, low, high = at[mine], low[mine], high[mine]
        name = rolling.of(at - reach, at - 2 * reach + length)
        shape = ((at - low) << 32 | (at - high)).astype(np.uint64)
        context = mix(rolling.of(low, high + length) + mix(shape))
        found.append(np.stack([name.view(np.int64), context.view(np.int64), low + begin, high + begin]))
    return np.concatenate(found, axis=1) if found else np.empty((4, 0), dtype=np.int64)


_SUFFIXES = "text_id bigint, name bigint, context bigint, low bigint, high bigint"
SEEN_TEXTS = 500_000


def _sample(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal texts of a task are sampled once
        for whole in batches:
            for batch in slices(whole, "text"):
                owners, columns = [], []
                for own, text in zip(batch["text_id"].to_pylist(), binary(batch["text"])):
                    if own in seen:
                        continue
                    if len(seen) >= SEEN_TEXTS:
                        seen.clear()
                    seen.add(own)
                    part = sampled_suffixes(text, length)
                    owners.append(np.full(part.shape[1], own, dtype=np.int64))
                    columns.append(part)
                if owners:
                    arrays = [np.concatenate(owners), *np.concatenate(columns, axis=1)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(a)) for a in arrays],
                        names=["text_id", "name", "context", "low", "high"],
                    )

    return run


def _merge(length: int):
    """The suffixes behind the wanted samples, each with the hash of its string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                parts = []
                for own, text, rows in zip(
                    batch["text_id"].to_pylist(), binary(batch["text"]), batch["rows"].to_pylist()
                ):
                    data = np.frombuffer(text, dtype=np.uint8)
                    for row in rows:
                        low, high = row["low"], row["high"]
                        rolling = RollingHash(data[low : high + length])
                        at = np.arange(high - low + 1)
                        string = rolling.of(at, at + length).view(np.int64)
                        part = np.empty((4, len(at)), dtype=np.int64)
                        part[0], part[1], part[2], part[3] = own, row["name"], string, at + low
                        parts.append(part)
                    if sum(p.shape[1] for p in parts) > 100_000:
                        yield _batch(parts)
                        parts = []
                if parts:
                    yield _batch(parts)

    return run


def _batch(parts: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(np.ascontiguousarray(c)) for c in np.concatenate(parts, axis=1)]
    return pa.RecordBatch.from_arrays(columns, names=["text_id", "name", "string", "start"])


def _cut_out(length: int):
    """Texts without the bytes in their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text, copies, spans in zip(
                    binary(batch["text"]), batch["copies"].to_pylist(), batch["spans"].to_pylist()
                ):
                    if copies and copies > 1 and len(text) >= length:
                        spans = [{"start": 0, "end": len(text)}]
                    kept, removed, at = [], [], 0
                    for span in sorted(spans or [], key=lambda s: (s["start"], s["end"])):
                        if removed and span["start"] <= removed[-1]["end"]:
                            removed[-1]["end"] = max(removed[-1]["end"], span["end"])
                        else:
                            removed.append(dict(span))
                    for span in removed:
                        kept.append(text[at : span["start"]])
                        at = span["end"]
                    kept.append(text[at:])
                    left = b"".join(kept)
                    rows.append(
                        (len(text), len(text) - len(left), len(removed), hashlib.sha256(left).hexdigest(), left, removed)
                    )
                columns = list(zip(*rows)) if rows else [[]] * 6
                kinds = [*[pa.int64()] * 3, pa.string(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"],
                )

    return run


_RESULT = (
    "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary, "
    "spans array<struct<start: bigint, end: bigint>>"
)


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row without the bytes of strings of ``length`` bytes that start anywhere else too.

    ``kept`` are the remaining UTF-8 bytes, which may end inside a character; ``spans`` are the
    maximal removed runs of the input. Strings do not cross documents and are judged on the input.

    All rows with one text count as copies: from ``length`` bytes on they go whole, and the text is
    sampled once. Names that occur once are found by an aggregate with map-side combining, so no
    group is ever gathered. A null text is empty, as is the result for texts below ``length``;
    repeated rows are copies of each other; null ids are allowed.

    Strings, names and texts are compared by 64-bit hashes, and a decision rests on two of them (name
    and string, name and context, or text and its length).
    """
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    ).select("doc_id", "text", F.xxhash64("text", F.octet_length("text")).alias("text_id"))
    long = source.where(F.octet_length("text") >= length)
    # Sampled and merged suffixes are worked out twice rather than written: they would take more
    # room than the texts, and working them out again takes less time than reading the texts.
    suffixes = long.select("text_id", "text").mapInArrow(_sample(length), _SUFFIXES)

    # An occurrence is a text and a place in it; copies of a text that several tasks saw are one.
    place = F.xxhash64("text_id", "low")
    named = suffixes.groupBy("name").agg(F.min(place).alias("a"), F.max(place).alias("b"))
    repeated = named.where("a <> b").select("name")
    again = materialize(suffixes.join(repeated, "name", "left_semi"), "again")

    contexts = materialize(
        again.groupBy("name", "context").agg(
            F.min(place).alias("a"),
            F.max(place).alias("b"),
            F.min("text_id").alias("text_id"),
            F.min("low").alias("low"),
            F.min("high").alias("high"),
        ),
        "contexts",
    )
    # A context that occurs twice repeats as a whole: all its suffixes do.
    whole = contexts.where("a <> b").select("name", "context")
    spans = again.join(whole, ["name", "context"], "left_semi").select(
        "text_id", F.col("low").alias("start"), (F.col("high") + length).alias("end")
    )
    # Names in several contexts: one occurrence of each context is merged in, suffix by suffix.
    several = contexts.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name")
    first = (
        again.join(several, "name", "left_semi")
        .groupBy("name", "context")
        .agg(F.min_by(F.struct("text_id", "low", "high"), place).alias("row"))
    )
    wanted = materialize(
        first.groupBy("row.text_id")
        .agg(F.collect_list(F.struct("name", "row.low", "row.high")).alias("rows")),
        "wanted",
    )
    texts = _with(long, wanted, "rows", "inner")
    merged = texts.select("text_id", "text", "rows").mapInArrow(
        _merge(length), "text_id bigint, name bigint, string bigint, start bigint"
    )
    place = F.xxhash64("text_id", "start")
    equal = (
        merged.groupBy("name", "string").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b")
    )
    spans = spans.union(
        merged.join(equal.select("name", "string"), ["name", "string"], "left_semi").select(
            "text_id", "start", (F.col("start") + length).alias("end")
        )
    )
    copies = source.groupBy("text_id").agg(F.count("*").alias("copies")).where("copies > 1")
    by_text = materialize(copies.join(_merged_spans(spans), "text_id", "full"), "by-text")
    return (
        _with(source, by_text, "spans", "left")
        .select("doc_id", "text", "copies", "spans")
        .mapInArrow(_cut_out(length), _RESULT)
    )


def _merged_spans(spans: DataFrame) -> DataFrame:
    """``(text_id, spans)``: overlapping and touching spans of a text made one."""
    ordered = Window.partitionBy("text_id").orderBy("start", "end")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.when(F.col("start") <= F.max("end").over(before), 0).otherwise(1)
    island = F.sum("fresh").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        spans.withColumn("fresh", fresh)
        .withColumn("island", island)
        .groupBy("text_id", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("text_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )


def _with(rows: DataFrame, by_text: DataFrame, lists: str, how: str) -> DataFrame:
    """Join a written table with a column of lists by ``text_id``.

    It is broadcast while its measured size allows. Beyond that, rows that it has nothing for go
    past the join, by the narrow table of its ids where that is small, and only the others move.
    """
    size = by_text.agg(F.count("*").alias("n"), F.sum(F.size(lists)).alias("items")).first()
    if size["n"] * 64 + max(size["items"] or 0, 0) * 48 <= BROADCAST_BYTES:
        return rows.join(F.broadcast(by_text), "text_id", how)
    ids = small(by_text.select("text_id"))
    moved = rows.join(ids, "text_id", "left_semi").join(by_text, "text_id", "inner")
    if how == "inner":
        return moved
    return moved.unionByName(rows.join(ids, "text_id", "left_anti"), allowMissingColumns=True)


def op3_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents")).drop("kept", "spans")
