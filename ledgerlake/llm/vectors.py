"""Embedding columns: which rows take part, rows as matrices, exact cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def common_length(rows: DataFrame, vector: str = "v") -> int:
    """The length that most vectors have (ties: the longer); 0 without vectors."""
    found = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return found["n"] if found else 0


def finite(vector: Column, length: int) -> Column:
    """True for vectors of ``length`` components, none null, NaN or infinite."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) == length) & fine, F.lit(False))


def nonzero(vector: Column) -> Column:
    return F.exists(vector, lambda v: v != 0)


def matrix(column: pd.Series) -> np.ndarray:
    """Rows of lists, or of bytes of doubles, as a matrix of doubles."""
    return np.stack([np.frombuffer(v, np.float64) if isinstance(v, (bytes, bytearray)) else np.asarray(v, np.float64) for v in column])


def unit(x: np.ndarray) -> np.ndarray:
    # by the largest component first, so squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each pair by the same steps wherever it stands."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
