"""Operator 4: embedding near-duplicates by product quantisation.

Vectors of the same direction and bits are one class, represented by its smallest id. The
unit vectors of the representatives go to inverted lists by their nearest coarse centre, and
the residual is cut into subspaces, each replaced by its nearest codeword. A vector probes
every list that can hold a partner: one at least as similar as ``cosine`` lies within
``r = sqrt(2 - 2 cosine)``, so its list's centre must be reachable across the bisector of
the two centres within ``r``. Of two lists only the vectors of the one with the smaller number
probe the other, and a link counts for both its ends. In a list the asymmetric distance to each code comes from a
table of inner products with the codewords; since the distance of a vector from its own code
is stored, codes farther than ``r`` plus that cannot be partners. What is left is confirmed
by the exact cosine in double precision on the original vectors. So no link is lost.

Centres and codewords are fitted on a bounded sample (``FIT_ROWS`` vectors, by key hash);
every vector is indexed. Lists are dealt to tasks in pieces of at most about ``PIECE``
members and ``PIECE`` probes, however many one list has. A piece returns link counts and a
spanning forest of its links, never the links of a group.

Vectors that are null, zero, of another length than most, or hold null or non-finite
components link with nothing. Rows with a null id are left out. Repeated rows link like
copies. Extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, DoubleType, IntegerType, StructField,
                               StructType)

from vacfleet.llm.common import enrich, join_by_key, matrix
from vacfleet.llm.components import components
from vacfleet.llm.vectors import dimension, sample, stacked, usable
from vacfleet.session import store

#: Vectors that centres and codewords are fitted on, at most.
FIT_ROWS = 16384
LISTS, SUBSPACES, CODEWORDS = 128, 8, 256
PIECE = 2048
#: Candidate pairs that are confirmed at once.
PASS_PAIRS = 1 << 16


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Lloyd's centres (at most ``k``; an empty centre stays where it was)."""
    distinct = np.unique(x, axis=0)
    k = max(1, min(k, len(distinct)))
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)[:-1]])[n > 0]
        centres[n > 0] = np.add.reduceat(x[order], at, axis=0) / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * (x @ centres.T), axis=1)


class Quantiser:
    """Coarse centres and the codewords of each subspace of the residuals."""

    def __init__(self, unit: np.ndarray, lists: int = LISTS):
        self.dim = unit.shape[1]
        self.centres = kmeans(unit, min(lists, max(1, len(unit) // 32)))
        self.cuts = np.linspace(0, self.dim, min(SUBSPACES, self.dim) + 1).astype(int)
        rest = unit - self.centres[nearest(unit, self.centres)]
        self.words = [kmeans(rest[:, a:b], CODEWORDS) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def encode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, distance from the own code, and the part of the distance that the
        code alone decides."""
        own = nearest(unit, self.centres)
        rest = unit - self.centres[own]
        code = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(zip(self.cuts[:-1], self.cuts[1:]), self.words)], axis=1)
        stands = np.concatenate([w[code[:, i]] for i, w in enumerate(self.words)], axis=1)
        return (own, code.astype(np.uint8), np.linalg.norm(rest - stands, axis=1),
                ((self.centres[own] + stands) ** 2).sum(axis=1))

    def probes(self, unit: np.ndarray, r: float) -> list[np.ndarray]:
        """Every list from the own one on that can hold a vector within ``r`` of each unit vector."""
        away = (self.centres ** 2).sum(axis=1) - 2 * (unit @ self.centres.T)
        own = np.argmin(away, axis=1)
        apart = np.sqrt(np.maximum(((self.centres[:, None] - self.centres[None]) ** 2).sum(axis=2), 1e-30))
        gap = (away - away[np.arange(len(unit)), own][:, None]) / (2 * apart[own])
        return [k + np.flatnonzero(g[k:] <= r + 1e-9) for k, g in zip(own, gap)]

    def tables(self, unit: np.ndarray) -> list[np.ndarray]:
        """Inner products of each vector's subspaces with all codewords."""
        return [unit[:, a:b] @ w.T for (a, b), w in zip(zip(self.cuts[:-1], self.cuts[1:]), self.words)]


def unit_rows(x: np.ndarray) -> np.ndarray:
    big = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return big / np.linalg.norm(big, axis=1, keepdims=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the links ``a, b``."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept`` (links: cosine >= ``cosine``)."""
    vectors = vectors.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    dim = dimension(vectors)
    good = usable("embedding", dim)
    alone = vectors.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not dim:
        return alone.withColumn("kept", F.lit(True))

    def name_rows():
        return lambda column: [[xxhash.xxh3_128_digest(r.tobytes()) for r in matrix(column, dim).astype(np.float64) + 0.0]]

    rows = store(enrich(vectors.where(good), "embedding", StructType([StructField("bits", BinaryType())]), name_rows), "pq_rows")
    total = rows.count()
    classes = store(rows.groupBy("bits").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "pq_classes")
    heads = (rows.join(classes.select("bits", "n", F.col("rep").alias("vec_id")), ["bits", "vec_id"])
             .dropDuplicates(["bits"]).select(F.col("vec_id").alias("rep"), "embedding", "n"))
    r = float(np.sqrt(2 - 2 * cosine))
    fitted = sample(heads, FIT_ROWS, dim, "rep")
    if not len(fitted):
        return alone.withColumn("kept", F.lit(True))
    shared = vectors.sparkSession.sparkContext.broadcast(Quantiser(unit_rows(fitted)))

    def start():
        quantiser = shared.value

        def make(column: pa.Array) -> list:
            unit = unit_rows(matrix(column, dim).astype(np.float64))
            own, code, error, norm = quantiser.encode(unit)
            return [own, [c.tobytes() for c in code], error, norm, quantiser.probes(unit, r)]
        return make

    added = StructType([StructField("list", IntegerType()), StructField("code", BinaryType()), StructField("error", DoubleType()),
                        StructField("norm", DoubleType()), StructField("probes", ArrayType(IntegerType()))])
    coded = store(enrich(heads, "embedding", added, start), "pq_codes")
    asks = coded.select(F.col("rep").alias("ask"), F.col("embedding").alias("asking"), F.col("n").alias("ask_n"),
                        F.col("list").alias("own_list"),
                        F.explode("probes").alias("ask_list"))
    # one row for each list: at most LISTS
    pieces = F.broadcast(coded.groupBy("list").agg(F.ceil(F.count("*") / PIECE).cast("int").alias("member_pieces"))
                         .join(asks.groupBy(F.col("ask_list").alias("list")).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("ask_pieces")), "list"))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = (coded.select("rep", "embedding", "n", "list", "code", "error", "norm").join(pieces, "list")
               .withColumn("m", F.pmod(F.xxhash64("rep"), F.col("member_pieces")).cast("int"))
               .withColumn("p", spread("ask_pieces")).drop("member_pieces", "ask_pieces"))
    asks = (asks.withColumnRenamed("ask_list", "list").join(pieces, "list").withColumn("p", F.pmod(F.xxhash64("ask"), F.col("ask_pieces")).cast("int"))
            .withColumn("m", spread("member_pieces"))
            .select(F.col("list").alias("a_list"), F.col("m").alias("a_m"), F.col("p").alias("a_p"), "ask", "asking", "ask_n", "own_list"))

    def link(key, near: pd.DataFrame, probing: pd.DataFrame) -> pd.DataFrame:
        if not len(near) or not len(probing):
            return pd.DataFrame({"rep": [], "links": [], "other": []})
        quantiser = shared.value
        x, y = stacked(probing["asking"], dim), stacked(near["embedding"], dim)
        ux, uy = unit_rows(x), unit_rows(y)
        x_id, y_id, n = probing["ask"].to_numpy(), near["rep"].to_numpy(), near["n"].to_numpy()
        code = np.frombuffer(b"".join(near["code"]), np.uint8).reshape(len(y), -1)
        centre = quantiser.centres[int(near["list"].iloc[0])]
        reach = (r + near["error"].to_numpy() + 1e-9) ** 2
        pairs = []
        for a in range(0, len(x), 128):
            part = ux[a:a + 128]
            inner = (part @ centre)[:, None]
            for i, t in enumerate(quantiser.tables(part)):
                inner = inner + t[:, code[:, i]]
            left, right = np.nonzero(1 + near["norm"].to_numpy() - 2 * inner <= reach)
            left += a
            keep = x_id[left] != y_id[right]
            left, right = left[keep], right[keep]
            for b in range(0, len(left), PASS_PAIRS):
                l, m = left[b:b + PASS_PAIRS], right[b:b + PASS_PAIRS]
                ok = (ux[l] * uy[m]).sum(axis=1) >= cosine
                pairs.append((l[ok], m[ok]))
        left, right = (np.concatenate(p) for p in zip(*pairs)) if pairs else (np.empty(0, int), np.empty(0, int))
        links = np.bincount(left, n[right], len(x)).astype(np.int64)
        other = probing["own_list"].to_numpy()[left] != int(near["list"].iloc[0])  # from another list: for both ends
        back = np.bincount(right[other], probing["ask_n"].to_numpy()[left[other]], len(y)).astype(np.int64)
        ids = np.unique(np.concatenate([x_id, y_id]))
        root = forest(len(ids), np.searchsorted(ids, x_id[left]), np.searchsorted(ids, y_id[right]))
        own, held = np.flatnonzero(links), np.flatnonzero(back)
        tree = np.flatnonzero(root != np.arange(len(ids)))
        return pd.DataFrame({"rep": np.concatenate([x_id[own], y_id[held], ids[tree]]),
                             "links": np.concatenate([links[own], back[held], np.zeros(len(tree), np.int64)]),
                             "other": np.concatenate([x_id[own], y_id[held], ids[root[tree]]])})

    found = store(members.groupBy("list", "m", "p").cogroup(asks.groupBy("a_list", "a_m", "a_p"))
                  .applyInPandas(link, "rep long, links long, other long"), "pq_links")
    joined = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")), "pq").withColumnRenamed("node", "rep")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = (classes.join(counted, "rep", "left").join(joined, "rep", "left")
               .select("bits", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                       F.coalesce("component", "rep").alias("component_id")))
    out = join_by_key(rows, classes, "bits", "n", total).select("vec_id", "n_links", "component_id")
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
