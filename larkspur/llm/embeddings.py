"""What both embedding operators share: which vectors count, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str = "embedding") -> Column:
    """False for vectors that are null, empty, zero, or hold a null or non-finite component."""
    c = F.col(col)
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return c.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(c, lambda x: x != 0)


def padded(rows: list, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled up with zeros, which changes no product and no norm."""
    width = max([width, *(len(x) for x in rows)])
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def sample(vectors: DataFrame, rows: int, col: str = "embedding", by: tuple[str, ...] = ("vec_id",), width: int = 0) -> np.ndarray:
    """At most ``rows`` vectors, those with the smallest hashes of ``by``; a bounded read whatever the table's size."""
    got = vectors.select(F.xxhash64(*by).alias("o"), col).orderBy("o").limit(rows).collect()
    return padded([r[1] for r in got], width)


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a list column in double precision, filled up to the longest and to ``width``."""
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths) and (lengths == lengths[0]).all() and lengths[0] >= width:
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return padded(column.to_pylist(), width)
