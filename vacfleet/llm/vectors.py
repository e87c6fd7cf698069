"""What the two vector operators share: which vectors take part, and in what shape."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension(vectors: DataFrame, column: str = "embedding") -> int:
    """The most common length of a non-null vector (ties: the larger; none: 0)."""
    sizes = (vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n"))
             .orderBy(F.desc("n"), F.desc("d")).limit(1).collect())
    return sizes[0]["d"] if sizes else 0


def usable(column: str, dim: int) -> Column:
    """True for a vector of ``dim`` finite components that are not all zero."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) == dim) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def sample(vectors: DataFrame, most: int, dim: int, key: str = "vec_id") -> np.ndarray:
    """At most ``most`` vectors, those with the smallest key hash (for fitting an index)."""
    rows = vectors.select("embedding", key).orderBy(F.xxhash64(key), key).limit(most).toArrow()
    return np.array(rows["embedding"].to_pylist(), np.float64).reshape(-1, dim)


def stacked(column: pd.Series, dim: int, dtype=np.float64) -> np.ndarray:
    return np.stack(column.to_list()).astype(dtype) if len(column) else np.empty((0, dim), dtype)
