"""Operator 3: nearest neighbours with randomly rotated one-bit codes.

A vector's offset from a common centre is rotated by a random orthogonal matrix; its code is
one sign bit a dimension, packed, with two correction scalars: the offset's length and the
inner product of the rotated unit offset with its own sign vector. A query's inner product
with a code, divided by that scalar, estimates the inner product with the vector, and its
error bound turns the estimate into a lower and an upper bound of the distance. Vectors
whose lower bound does not exceed the k-th smallest upper bound are reranked by the exact
distance in double precision on the original vectors.

All vectors are indexed and every query scans all codes, in blocks of ``BLOCK`` vectors and
``QUERY_BLOCK`` queries that Spark deals out; a block returns its k best per query. Blocks
are dealt by hash, so copies and clusters make no large block. The centre comes from a
bounded sample (``CENTRE_ROWS``); it only affects how tight the bounds are.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; neither do rows with a null id. Repeated rows take part each. A
query never finds rows of its own id. With fewer than k candidates all are returned; ties
go to the smaller id. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StructField, StructType

from vacfleet.llm.common import enrich, matrix
from vacfleet.llm.vectors import dimension, sample, stacked, usable
from vacfleet.session import store

BLOCK, QUERY_BLOCK = 8192, 2048
CENTRE_ROWS = 4096
#: Width of the error bound in standard deviations of the estimate.
BOUND = 3.5

_FOUND = "query_id long, vec_id long, score double"


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products with the own sign vector."""
    y = (x - centre) @ turn
    length = np.linalg.norm(y, axis=1)
    own = np.abs(y).sum(axis=1) / (np.where(length > 0, length, 1) * np.sqrt(x.shape[1]))
    return np.packbits(y > 0, axis=1), length, np.where(length > 0, own, 1.0)


def distance_bounds(packed: np.ndarray, length: np.ndarray, own: np.ndarray, queries: np.ndarray,
                    centre: np.ndarray, turn: np.ndarray, bound: float = BOUND) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances (a row per query) from codes alone."""
    dim = queries.shape[1]
    q = (queries - centre) @ turn
    q_length = np.linalg.norm(q, axis=1)
    unit = q / np.where(q_length > 0, q_length, 1)[:, None]
    signs = np.unpackbits(packed, axis=1, count=dim).astype(np.float32) * 2 - 1
    estimate = (unit.astype(np.float32) @ signs.T).astype(np.float64) / (np.sqrt(dim) * own)
    error = bound * np.sqrt(np.maximum(1 - own * own, 0) / max(dim - 1, 1)) / own + 1e-6
    middle = length ** 2 + q_length[:, None] ** 2 - 2 * q_length[:, None] * length * estimate
    slack = 2 * q_length[:, None] * length * error
    return middle - slack, middle + slack


def index(vectors: DataFrame, centre: np.ndarray, turn: np.ndarray) -> DataFrame:
    """Add ``code``, ``length`` and ``own`` to each vector."""
    dim = len(centre)

    def start():
        def make(column):
            packed, length, own = codes(matrix(column, dim).astype(np.float64), centre, turn)
            return [[p.tobytes() for p in packed], length, own]
        return make

    added = StructType([StructField("code", BinaryType()), StructField("length", DoubleType()), StructField("own", DoubleType())])
    return enrich(vectors, "embedding", added, start, slice_rows=4096)


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of each row with ``is_query``."""
    dim = dimension(vectors)
    base = vectors.where(F.col("vec_id").isNotNull() & usable("embedding", dim)).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), is_query.alias("asks"))
    some = sample(base, CENTRE_ROWS, max(dim, 1))
    centre, turn = some.mean(axis=0) if len(some) else np.zeros(max(dim, 1)), rotation(max(dim, 1))
    rows = store(index(base, centre, turn), "codes")
    n, m = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-m // QUERY_BLOCK))
    dealt = F.xxhash64("vec_id", "embedding")
    data = rows.select("vec_id", "embedding", "code", "length", "own", F.pmod(dealt, F.lit(blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("part"))
    # a repeated row asks once; all its copies can be found
    asks = rows.where("asks").select("vec_id", "embedding").distinct()
    asks = asks.select(F.col("vec_id").alias("query_id"), "embedding",
                                     F.pmod(dealt, F.lit(query_blocks)).cast("int").alias("part"),
                                     F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

    def best(key, near: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, x = near["vec_id"].to_numpy(), stacked(near["embedding"], dim)
        packed = np.frombuffer(b"".join(near["code"]), np.uint8).reshape(len(ids), -1)
        q_ids, q = queries["query_id"].to_numpy(), stacked(queries["embedding"], dim)
        out = []
        for a in range(0, len(q), 256):
            low, high = distance_bounds(packed, near["length"].to_numpy(), near["own"].to_numpy(), q[a:a + 256], centre, turn)
            for i in range(len(low)):
                other = ids != q_ids[a + i]
                upper = high[i][other]
                limit = np.partition(upper, k - 1)[k - 1] if len(upper) > k else np.inf
                at = np.flatnonzero(other & (low[i] <= limit))
                exact = np.sqrt(((x[at] - q[a + i]) ** 2).sum(axis=1))
                first = np.lexsort((ids[at], exact))[:k]
                out.append((np.full(len(first), q_ids[a + i]), ids[at][first], exact[first]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    found = data.groupBy("block", "part").cogroup(asks.groupBy("block", "part")).applyInPandas(best, _FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
