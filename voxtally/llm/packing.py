"""Documents packed into training sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, slices
from voxtally.llm.byte_bpe import encoder
from voxtally.llm.packing_plan import Places, pack_counts
from voxtally.llm.tables import table
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize

CAPACITY = 1024
END = 2  # the id after every document

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, row bigint"
_PACKED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def cut(size: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of a document's pieces; only the first may be shorter."""
    first = size % capacity or min(size, capacity)
    return [(0, first), *((s, capacity) for s in range(first, size, capacity))]


def _tokenize(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, END.to_bytes(4, "little")
        part, rows = TaskContext.get().partitionId(), defaultdict(int)
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc_id, text in zip(batch["doc_id"].to_pylist(), binary(batch["text"])):
                    ids = encode(text) + end
                    for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        row = (doc_id, piece, start, length, zlib.crc32(own), part, rows[length])
                        out.append((*row, own) if keep_ids else row)
                        rows[length] += 1
                names = _names(_PIECES) + ["ids"] * keep_ids
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _place(places: Places, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch[c].to_numpy() for c in ("length", "number"))
            sequence, offset = places.find(length, number)
            found = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays(
                [found[c] if c in found else batch[c] for c in names], names=names
            )

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its sequence and its place in it.

    Columns as in ``_PACKED``, and with ``keep_ids`` the ids themselves as little-endian unsigned
    32-bit numbers. ``tokenizer`` is the path of a byte-level BPE file. Each document's ids end with
    ``END``; a null text is empty, repeated rows are packed one by one, and no rows give no rows.

    Tasks tokenize whole texts and number the pieces of each length they make. The numbers of pieces
    per length, at most ``capacity`` of them, are all that planning needs: lengths above an eighth of
    the capacity are rounded up within groups of equal cardinality, a linear programme over
    configurations of the few rounded sizes says which sizes share sequences, actual pieces take the
    places of rounded ones, and what remains, with all short pieces, goes by best fit. Pieces are
    then placed by their number within their length, without meeting each other.
    """
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = _PIECES + ", ids binary" * keep_ids
    pieces = materialize(rows.mapInArrow(_tokenize(tokenizer, capacity, keep_ids), schema), "pieces")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(
        pieces.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))),
        "bases",
    )
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Places.of(pack_counts(counts, capacity))
    numbered = lookup_join(
        pieces, bases.select("length", "part", "base"), ["length", "part"], by=["doc_id", "row"]
    ).withColumn("number", F.col("base") + F.col("row"))
    packed = _PACKED + ", ids binary" * keep_ids
    wanted = [c for c in _names(packed) if c not in ("sequence_id", "offset")]
    return numbered.select(*wanted, "number").mapInArrow(_place(places, _names(packed)), packed)


def render_sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` out of pieces packed with ``keep_ids``: the ids of whole sequences.

    A sequence has at most ``capacity`` pieces, so its group is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(
        F.unhex(F.array_join(F.transform(parts, lambda p: p["ids"]), "")).alias("ids")
    )


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
