"""Vector columns as matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def width(df: DataFrame, col: str) -> int:
    """The most frequent length of the vectors (ties: the shorter), 0 if there is none. Vectors of another length take no part."""
    found = df.where(F.size(col) > 0).groupBy(F.size(col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found.n if found else 0


def matrix(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of that length whose entries are all finite, and these vectors in double precision."""
    offs = col.offsets.to_numpy()
    flat = col.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    fits = (np.diff(offs) == dim) & col.is_valid().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    found = flat[offs[at][:, None] + np.arange(dim)]
    finite = np.isfinite(found).all(axis=1)
    return at[finite], found[finite]
