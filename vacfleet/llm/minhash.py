"""Operator 6: near-duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct word shingles. Its signature has 20 symbols of 16 bits,
each of one MinHash; the distance of two signatures is the number of symbols that differ.
The signature is split into 5 chunks of 4 symbols. By the pigeonhole principle two
signatures at distance 9 or less have a chunk with at most one differing symbol; a chunk's
allowed errors are enumerated by leaving out each of its symbols in turn, so such a pair
shares at least one of 20 keys. Documents of similarity 0.8 differ in 4 symbols on average
and miss all keys about twice in ten thousand.

Documents with the same set are one class, represented by its smallest id. Candidates come
in three rounds, each over the keys whose members are not yet in one component: first a
key's members against its smallest id; then against the few members nearest to the key's
majority signature (the likely originals of a group of copies); last, all pairs across the
components that are left. So a large group of near copies costs a few rows each, not all its
pairs, and no pair that could join two components is left out. A pair is confirmed on the
full sets, hashed once a document. Before that, pairs are dropped only by bounds: sketches of 3 bits
of each symbol, which are never farther apart than the signatures; and parities, one bit for each of
1536 parts of the hash range that says whether the set has an odd number of shingles there. Every
shingle that only one of two sets has turns one bit, so the sets differ in at least as many shingles
as their parities differ in bits.
So every pair within the signature distance whose sets are similar enough is linked, if its members
are not linked by others.

Null and empty texts, or texts without words, have an empty set and link with nothing; a
text with fewer words than a shingle has one shingle, all its words. Rows with a null
doc_id are left out. Repeated rows are copies; where rows of one id have different sets, the one whose set has
the smallest digest stands for the id, and the others are in its component. Extra columns are left out. Texts of any
length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BinaryType, LongType, StructField, StructType)

from vacfleet.llm.common import enrich, join_by_key, mix64, utf8, word_hashes
from vacfleet.llm.components import components
from vacfleet.session import store

SYMBOLS, CHUNKS = 20, 5
WIDTH = SYMBOLS // CHUNKS
#: Symbols in which the sketches of a compared pair differ, at most. Documents of
#: similarity 0.8 differ in more with a probability below 1 in 10,000.
MOST_DIFFERENT = 12
#: Bits of a parity.
PARITY_BITS = 1536
#: Members of a key that are compared with all others in the second round.
HUBS = 3
#: Shingles that are hashed to all symbols at once.
PASS_SHINGLES = 256

_SEEDS = mix64(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:SYMBOLS, None] | np.uint64(1), _SEEDS[SYMBOLS:, None]


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; all words as one if there are fewer."""
    if not len(words):
        return words
    size = min(size, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - size + 1, np.uint64)
        for j in range(size):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[j:len(words) - size + 1 + j] + np.uint64(1))
    return np.unique(h)


def signature(items: np.ndarray) -> np.ndarray:
    """The low 16 bits of each hashed minimum."""
    least = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    with np.errstate(over="ignore"):
        for i in range(0, len(items), PASS_SHINGLES):
            least = np.minimum(least, (items[None, i:i + PASS_SHINGLES] * _TIMES + _PLUS).min(axis=1))
    return mix64(least) & np.uint64(0xFFFF)


def parity(items: np.ndarray) -> np.ndarray:
    """Whether the number of items in each part of the hash range is odd, as 24 numbers."""
    part = (items >> np.uint64(32)) * np.uint64(PARITY_BITS) >> np.uint64(32)
    return np.packbits(np.bincount(part.astype(np.int64), minlength=PARITY_BITS).astype(np.uint8) & 1).view(np.int64)


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each chunk and each of its symbols left out (rows of signatures in, keys out)."""
    out = []
    with np.errstate(over="ignore"):
        for c in range(CHUNKS):
            for gone in range(WIDTH):
                h = np.full(len(sig), c * WIDTH + gone + 1, np.uint64)
                for j in range(WIDTH):
                    if j != gone:
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, c * WIDTH + j])
                out.append(h)
    return np.stack(out, axis=1).view(np.int64)


def sketch(sig: np.ndarray) -> np.ndarray:
    """Three bits of each symbol in one number."""
    place = np.arange(SYMBOLS, dtype=np.uint64) * np.uint64(3)
    return ((sig & np.uint64(7)) << place).sum(axis=1, dtype=np.uint64).view(np.int64)


def different(a: Column, b: Column) -> Column:
    """In how many symbols two sketches differ."""
    x = a.bitwiseXOR(b)
    any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2))
    return F.bit_count(any_bit.bitwiseAND(F.lit(sum(1 << 3 * i for i in range(SYMBOLS)))))


def least_difference(a: Column, b: Column) -> Column:
    """At least so many shingles are in only one of the sets with these parities."""
    out = F.lit(0)
    for i in range(PARITY_BITS // 64):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def document_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    counts, words = word_hashes(*utf8(column))
    return [shingles(w, size) for w in np.split(words, np.cumsum(counts)[:-1])] if len(counts) else []


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def signed(docs: DataFrame, size: int) -> DataFrame:
    """Add ``n_shingles``, ``set_key`` (names the whole set), ``keys``, ``sketch`` and ``parity``."""
    added = StructType([StructField("n_shingles", LongType()), StructField("set_key", BinaryType()),
                        StructField("keys", ArrayType(LongType(), False)), StructField("sketch", LongType()),
                        StructField("parity", ArrayType(LongType(), False))])

    def start():
        def make(column: pa.Array) -> list:
            sets = document_sets(column, size)
            sig = np.stack([signature(s) for s in sets]) if sets else np.empty((0, SYMBOLS), np.uint64)
            keys = chunk_keys(sig)
            return [pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * keys.shape[1]),
                                             pa.array(keys.ravel())),
                    pa.array(sketch(sig)),
                    pa.array([parity(s) for s in sets], pa.list_(pa.int64()))]
        return make

    return enrich(docs.select("doc_id", "text"), "text", added, start)


def hashed_sets(docs: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """The sets (``id, items``: sorted 64-bit hashes) of the documents of ``heads`` (id, set_key)."""
    added = StructType([StructField("items", BinaryType()), StructField("set_key", BinaryType())])

    def start():
        def make(column: pa.Array) -> list:
            sets = document_sets(column, size)
            return [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([set_key(s) for s in sets], pa.binary())]
        return make

    asked = docs.select(F.col("doc_id").alias("id"), "text").join(heads.select("id"), "id", "left_semi")
    # an id may have rows with other texts: the set must be the one that stands for it
    return (enrich(asked, "text", added, start).drop("text").join(heads, ["id", "set_key"], "left_semi")
            .dropDuplicates(["id"]).select("id", "items"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose sets have ``100 * intersection >= percent * union``."""
    both = (pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("b_items")), "b")
            .join(sets.select(F.col("id").alias("a"), F.col("items").alias("a_items")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(batch.column(i) for i in (2, 3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([x, y]))
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Documents link when their sets of ``size``-word shingles have a Jaccard similarity of
    ``percent`` or more; ``component_id`` is the smallest id reachable by links.
    """
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = store(signed(docs, size).drop("text"), "near_signed")
    full = rows.where("n_shingles > 0")
    odd = store(full.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most"))
                .where("least <> most").select("doc_id", "least"), "near_odd")
    others = None
    if not odd.isEmpty():
        marked = store(full.join(odd, "doc_id", "left"), "near_full")
        full = marked.where("least is null or set_key = least").drop("least")
        others = marked.where("set_key <> least").select("doc_id", "n_shingles")
    classes = store(full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "near_classes")
    heads = full.join(classes.select("set_key", F.col("rep").alias("doc_id")), ["set_key", "doc_id"]).dropDuplicates(["set_key"])
    keyed = store(heads.select(F.col("doc_id").alias("rep"), "sketch", F.explode("keys").alias("key")), "near_keys")

    pivots = store(keyed.groupBy("key").agg(F.min("rep").alias("pivot"), F.min_by("sketch", "rep").alias("pivot_sketch"),
                                            F.count("*").alias("n")).where("n > 1"), "near_pivots")
    total = keyed.count()
    shared = store(join_by_key(keyed, pivots, "key", "n", total), "near_shared")
    ids = shared.select("rep").distinct()
    named = store(heads.select(F.col("doc_id").alias("rep"), "set_key").join(ids, "rep").withColumnRenamed("rep", "id"), "near_heads")
    sets = store(hashed_sets(docs, named, size), "near_sets")

    def link(pairs: DataFrame, name: str) -> DataFrame:
        return store(confirmed(store(pairs, f"{name}_pairs"), sets, percent), f"{name}_links")

    def open_keys(rows: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
        """The components, and the rows of keys whose members are in several, with these and their number."""
        found = components(links, name)
        now = store(rows.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), f"{name}_rows")
        open_ = (now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
                 .where("lo <> hi").select("key"))
        left = store(now.join(open_, "key", "left_semi"), f"{name}_open")
        return found, left, left.count()

    def pair(a: str, b: str) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    near = different(F.col("sketch"), F.col("other_sketch")) <= MOST_DIFFERENT
    links = link(shared.withColumnRenamed("pivot_sketch", "other_sketch").where((F.col("rep") != F.col("pivot")) & near)
                 .select(pair("rep", "pivot")).distinct(), "near_first")
    # a round is left out once no key has members in several components
    found, left, n_left = open_keys(shared.select("key", "rep", "sketch"), links, "near_first")

    if n_left:
        hubs = store(_hubs(left, n_left), "near_hubs")
        links = links.unionByName(link(
            join_by_key(left, hubs, "key", "n", n_left)
            .select("rep", "sketch", "component", F.explode("hubs").alias("hub"))
            .select("rep", "sketch", "component", F.col("hub.rep").alias("other"), F.col("hub.sketch").alias("other_sketch"),
                    F.col("hub.component").alias("other_component"))
            .where((F.col("component") != F.col("other_component")) & near)
            .select(pair("rep", "other")).distinct(), "near_second"))
        found, left, n_left = open_keys(left.select("key", "rep", "sketch"), links, "near_second")

    if n_left:
        left = store(left.join(heads.select(F.col("doc_id").alias("rep"), "n_shingles", "parity", "keys"), "rep")
                     .withColumn("at", F.array_position("keys", F.col("key")) - 1), "near_left")
        right = left.select("key", *(F.col(c).alias(f"other_{c}") for c in ("rep", "sketch", "component", "n_shingles", "parity", "keys")))
        met = F.lit(True)  # a pair is made at the first key that its two members share
        for i in range(CHUNKS * WIDTH):
            met = met & ((left["at"] <= i) | (left["keys"][i] != right["other_keys"][i]))
        both = left["n_shingles"] + right["other_n_shingles"]
        apart = least_difference(left["parity"], right["other_parity"])
        links = links.unionByName(link(
            left.join(right, (left["key"] == right["key"]) & (left["rep"] < right["other_rep"])
                      & (left["component"] != right["other_component"])
                      & (different(left["sketch"], right["other_sketch"]) <= MOST_DIFFERENT) & met
                      & ((100 + percent) * apart <= (100 - percent) * both))  # the similarity is at most (both - apart) / (both + apart)
            .select(pair("rep", "other_rep")).distinct(), "near_third"))
        found = components(links, "near_all")

    classes = (classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
               .select("set_key", "n", F.coalesce("component", "rep").alias("component_id")))
    linked = join_by_key(full, classes, "set_key", "n", full.count()).select("doc_id", "n_shingles", "component_id")
    if others is not None:
        linked = linked.unionByName(others.join(linked.select("doc_id", "component_id").distinct(), "doc_id"))
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _hubs(rows: DataFrame, total: int) -> DataFrame:
    """For each key the ``HUBS`` members nearest to the majority of its members' sketches."""
    bits = [F.sum(F.shiftrightunsigned("sketch", i).bitwiseAND(F.lit(1))).alias(f"b{i}") for i in range(3 * SYMBOLS)]
    most = F.lit(0).cast("long")
    for i in range(3 * SYMBOLS):
        most = most + F.when(2 * F.col(f"b{i}") > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0))
    middle = store(rows.groupBy("key").agg(F.count("*").alias("n"), *bits).select("key", "n", most.alias("middle")), "near_middle")
    away = join_by_key(rows, middle, "key", "n", total).withColumn("away", different(F.col("sketch"), F.col("middle")))
    order = Window.partitionBy("key").orderBy("away", "rep")
    return (away.withColumn("at", F.row_number().over(order)).where(F.col("at") <= HUBS)
            .groupBy("key").agg(F.first("n").alias("n"), F.collect_list(F.struct("rep", "sketch", "component")).alias("hubs")))
