"""Token ids in files of compressed byte or bit planes, with an index of chunks.

A token folder holds two tables that Spark writes and reads, so it may lie in any store Spark knows:

``chunks``
    One row per chunk of ``chunk_ids`` ids (the last of a shard has fewer), in the order of the
    shard. ``planes`` has the ids as little-endian unsigned 32-bit numbers, transposed: 4 byte planes
    or 32 bit planes, each one zstandard frame. ``crc32`` is that of the ids. ``docs`` names the
    documents that the chunk holds ids of: ``doc_id``, ``start`` (ids of the shard before it, less
    than the chunk's own if it began earlier) and ``n_tokens``.
``index``
    One row per chunk: ``shard``, ``chunk``, ``first`` (ids of all shards and chunks before it),
    ``n_ids`` and the ``plane_bytes`` of each plane.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.batches import binary, slices
from voxtally.llm.byte_bpe import encoder
from voxtally.llm.tables import table
from voxtally.operators.skew import lookup_join
from voxtally.session import materialize, new_folder

CHUNK_IDS = 1 << 16
LEVEL = 3  # of zstandard
HEAD = 32  # characters of a text that say where it stands among those of its id
END = 0  # the id after every document

_DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
_CHUNKS = (
    "shard int, chunk int, n_ids int, planes array<binary>, crc32 bigint, "
    "docs array<struct<doc_id:bigint,start:bigint,n_tokens:bigint>>"
)
_CHUNK_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.int64(), pa.list_(_DOC)]
_PIECES = "chunk int, doc_id bigint, start bigint, n_tokens bigint, whole boolean, ids_crc32 bigint, ids binary"
_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]


def _batch(rows: list[tuple], schema: str, kinds: list[pa.DataType]) -> pa.RecordBatch:
    names = [part.split()[0] for part in re.split(r", (?![^<]*>)", schema)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The ids' bytes, or bits, of each place of their 32-bit numbers, lowest place first."""
    places = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        places = np.unpackbits(places, axis=1, bitorder="little")
        return [np.packbits(places[:, p], bitorder="little").tobytes() for p in range(32)]
    return [places[:, p].tobytes() for p in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The reverse of :func:`to_planes`; the number of planes tells bytes from bits."""
    columns = [np.frombuffer(p, dtype=np.uint8) for p in planes]
    if len(planes) == 32:
        columns = [np.unpackbits(c, count=n, bitorder="little") for c in columns]
        places = np.packbits(np.stack(columns, axis=1), axis=1, bitorder="little")
    else:
        places = np.stack(columns, axis=1)
    return np.ascontiguousarray(places).view("<u4").ravel()


@lru_cache(maxsize=2)
def _added(path: str) -> dict[bytes, bytes]:
    """The tokenizer's added tokens, which it finds in texts before anything else, and their ids."""
    with open(path, encoding="utf-8") as file:
        tokens = json.load(file).get("added_tokens", [])
    return {t["content"].encode(): t["id"].to_bytes(4, "little") for t in tokens}


def encode(path: str, text: bytes) -> bytes:
    """Little-endian unsigned 32-bit ids of a text, without special tokens of the tokenizer's own."""
    added = _added(path)
    parts = re.split(b"(" + b"|".join(map(re.escape, added)) + b")", text) if added else [text]
    return b"".join(added.get(p) or encoder(path).encode(p) for p in parts if p)


class _Shard:
    """Documents in, chunks out; holds the ids of the chunk that is being filled."""

    def __init__(self, number: int, chunk_ids: int, bits: bool):
        self._number, self._size, self._bits = number, chunk_ids, bits
        self._held, self._n, self._chunk, self._docs = [], 0, 0, []
        self._zip = zstandard.ZstdCompressor(level=LEVEL).compress

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        doc = {"doc_id": doc_id, "start": self._chunk * self._size + self._n, "n_tokens": len(ids)}
        while len(ids):
            part = ids[: self._size - self._n]
            self._docs.append(doc)
            self._held.append(part)
            self._n += len(part)
            ids = ids[len(part) :]
            if self._n == self._size:
                yield self._take()

    def rest(self) -> Iterator[tuple]:
        if self._n:
            yield self._take()

    def _take(self) -> tuple:
        ids = np.concatenate(self._held)
        planes = [self._zip(p) for p in to_planes(ids, self._bits)]
        row = (self._number, self._chunk, self._n, planes, zlib.crc32(ids.tobytes()), self._docs)
        self._held, self._n, self._docs = [], 0, []
        self._chunk += 1
        return row


def _fill(tokenizer: str, end: int, chunk_ids: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(TaskContext.get().partitionId(), chunk_ids, bits), end.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "text"):
                for doc_id, text in zip(batch["doc_id"].to_pylist(), binary(batch["text"])):
                    ids = np.frombuffer(encode(tokenizer, text) + last, dtype="<u4")
                    for row in shard.add(doc_id, ids):
                        yield _batch([row], _CHUNKS, _CHUNK_TYPES)
        for row in shard.rest():
            yield _batch([row], _CHUNKS, _CHUNK_TYPES)

    return run


def write_tokens(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    doc_id: str = "doc_id",
    text: str = "text",
    end: int = END,
    chunk_ids: int = CHUNK_IDS,
    bits: bool = False,
    mode: str = "errorifexists",
) -> None:
    """Write the ids of all texts to the token folder ``path``, in ascending order of ``doc_id``.

    ``tokenizer`` is the path of a byte-level BPE file; ``end`` is the id after each document. A null
    text is empty. A null id comes first, and rows that share an id go by the first ``HEAD`` characters
    of their texts (null first) and then by hash, repeated rows one by one. No rows give an empty
    folder of both tables.

    The texts are range-partitioned once, by id and then by head, hash and row, so that an id with
    very many rows is dealt out; the sample that the ranges come from holds heads and no texts. A task tokenizes its range as it comes and holds the ids of one chunk;
    shards know only their own ids, and the index adds up what lies before each.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        F.left(text, F.lit(HEAD)).alias("head"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("copy"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("head").asc_nulls_first(), F.col("hash"), F.col("copy")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    chunks = ordered.mapInArrow(_fill(tokenizer, end, chunk_ids, bits), _CHUNKS)
    chunks.write.mode(mode).parquet(f"{path}/chunks")
    written = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    sizes = written.select(
        "shard", "chunk", "n_ids", F.transform("planes", lambda p: F.octet_length(p)).alias("plane_bytes")
    )
    # One row per shard, so the window without partitions is as short as they are few.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        sizes.groupBy("shard")
        .agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    index = lookup_join(sizes, materialize(bases, "shards"), ["shard"], by=["chunk"])
    first = (F.col("base") + F.col("chunk").cast("bigint") * chunk_ids).alias("first")
    index.select("shard", "chunk", first, "n_ids", "plane_bytes").write.mode(mode).parquet(f"{path}/index")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "shard int, chunk int, first bigint, n_ids int, plane_bytes array<int>"
    ).parquet(f"{path}/index")


def _cut(keep_ids: bool):
    """Chunks into the parts of their documents, whose starts then count all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in range(batch.num_rows):
                chunk, base, size, n, planes, crc, docs = (
                    batch[c][row].as_py() for c in ("chunk", "base", "size", "n_ids", "planes", "crc32", "docs")
                )
                data = from_planes([unzip(p) for p in planes], n).tobytes()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"chunk {chunk} of the shard that starts at {base} is damaged")
                out, first = [], chunk * size
                for doc in docs:
                    start, total = doc["start"], doc["n_tokens"]
                    low, high = max(start, first) - first, min(start + total - first, n)
                    own, whole = data[4 * low : 4 * high], high - low == total
                    kept = own if keep_ids or not whole else None
                    out.append((chunk, doc["doc_id"], base + start, total, whole, zlib.crc32(own), kept))
                yield _batch(out, _PIECES, _PIECE_TYPES)

    return run


def _documents(spark: SparkSession, path: str, wanted: DataFrame | None, keep_ids: bool) -> DataFrame:
    chunks = spark.read.schema(_CHUNKS).parquet(f"{path}/chunks")
    # All chunks of a shard but the last have the same size.
    shards = read_index(spark, path).groupBy("shard").agg(
        F.min("first").alias("base"), F.max("n_ids").alias("size")
    )
    chunks = lookup_join(chunks, materialize(shards, "shards"), ["shard"], by=["chunk"])
    if wanted is not None:
        asked = wanted.select("doc_id").distinct()
        chunks = chunks.withColumn("place", F.struct("shard", "chunk"))
        holds = chunks.select("place", F.explode("docs.doc_id").alias("doc_id"))
        holds = holds.join(asked, "doc_id", "left_semi").select("place").distinct()
        chunks = chunks.join(holds, "place", "left_semi")
    pieces = chunks.select("chunk", "base", "size", "n_ids", "planes", "crc32", "docs").mapInArrow(
        _cut(keep_ids), _PIECES
    )
    if wanted is not None:
        pieces = pieces.join(asked, "doc_id", "left_semi")
    pieces = materialize(pieces, "pieces")
    # Only documents cut by the end of a chunk, at most two of each chunk, are put together.
    parts = F.array_sort(F.collect_list(F.struct("chunk", "ids")))
    cut = (
        pieces.where("NOT whole")
        .groupBy("start")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), parts.alias("parts"))
        .withColumn("ids", F.expr("aggregate(parts, X'', (a, p) -> concat(a, p.ids))"))
        .withColumn("ids_crc32", F.crc32("ids"))
    )
    columns = ["doc_id", "start", "n_tokens", "ids" if keep_ids else "ids_crc32"]
    return pieces.where("whole").select(*columns).unionByName(cut.select(*columns))


def read_tokens(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of the documents in a token folder.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian unsigned 32-bit
    numbers. ``wanted``, with the column ``doc_id``, restricts that to some documents: only chunks
    that hold one of them are decoded. A damaged chunk raises.
    """
    return _documents(spark, path, wanted, keep_ids=True)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of all documents, worked out from the stored ids."""
    return _documents(spark, path, None, keep_ids=False)


def op12_token_planes(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "token-planes")
    write_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_checksums(spark, path)
