"""Vectors as array columns. Arithmetic runs on Arrow batches with one matrix product per batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(vectors: pd.Series) -> np.ndarray:
    """The rows of a vector column as one float64 matrix."""
    return np.stack([np.asarray(v, dtype="float64") for v in vectors])


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows stay zero."""
    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(lengths > 0, lengths, 1.0)


def vector_map(function: Callable[[np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A column function from vectors to vectors out of a function from matrix to matrix."""

    @F.pandas_udf("array<double>")
    def mapped(vectors: pd.Series) -> pd.Series:
        given = vectors[vectors.notna()]
        if given.empty:
            return pd.Series([None] * len(vectors), dtype="object")
        return pd.Series(list(function(matrix(given))), index=given.index).reindex(vectors.index)

    return mapped


def unit(column: Column) -> Column:
    """The vector at length one."""
    return vector_map(unit_rows)(column)


@lru_cache(maxsize=32)
def projection_signs(dims: int, components: int, seed: int) -> np.ndarray:
    """``dims x components`` of +1 and -1, from the first hex digit of ``md5(seed:component:dim)``."""
    return np.array(
        [
            [1.0 if md5(f"{seed}:{c}:{d}".encode()).hexdigest()[0] < "8" else -1.0
             for c in range(components)]
            for d in range(dims)
        ]
    )


def random_projection(
    column: Column, components: int = 5, seed: int = 42, decimals: int = 6
) -> Column:
    """Unit vectors projected on ``components`` random sign directions, rounded."""

    def project(rows: np.ndarray) -> np.ndarray:
        signs = projection_signs(rows.shape[1], components, seed)
        return np.round(unit_rows(rows) @ signs / np.sqrt(components), decimals) + 0.0

    return vector_map(project)(column)
