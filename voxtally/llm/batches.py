"""Texts of Arrow batches as bytes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20


def documents(docs: DataFrame, doc_id: str, text: str, carry: Sequence[str] = ()) -> tuple[DataFrame, str]:
    """``docs`` as ``doc_id``, ``text`` and, if there is anything to carry along, ``rest``: the other
    wanted columns in one struct. The second value is what a schema says of ``rest``."""
    rows = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.col(text).alias("text"),
        *([F.struct(*carry).alias("rest")] if carry else []),
    )
    return rows, f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else ""


def binary(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows whose texts have at most ``limit`` bytes, or of one longer text."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.nan_to_num(
        np.asarray(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=float)
    ).astype(np.int64)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if batch.num_rows > start:
        yield batch.slice(start)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _byte_codes() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


BYTE_CODES = _byte_codes()
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the hash base and of its inverse, modulo 2 to the 64."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, _INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    up, down = _powers[size]
    return up[:n], down[:n]


class RollingHash:
    """64-bit hashes of any substrings of one buffer, after one pass over it."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE_CODES[data] * up[: len(data)], out=self._sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true."""
    steps = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def joined(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer with ``gap`` after each, and where each starts and ends."""
    data = np.frombuffer(gap.join([*texts, b""]), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    starts = np.concatenate(([0], np.cumsum(sizes + len(gap))[:-1])) if len(texts) else sizes
    return data, starts, starts + sizes
