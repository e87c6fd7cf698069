"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch that a Python task works on at once.
SLICE_ROWS = 512


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts`` (null key: null)."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def in_fold(key: Column, parts: int, part: int) -> Column:
    """True where the key's fold is ``part``; a null key is in no fold."""
    return F.coalesce(fold(key, parts) == part, F.lit(False))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that clash with ``names`` (case does not count)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def enrich(df: DataFrame, column: str, added: StructType,
           start: Callable[[], Callable[[pa.Array], list]],
           slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Add the columns ``added``, computed from ``column`` in Arrow batches.

    ``start()`` runs once a task and returns a function from an Arrow array to one Arrow
    array per added column. Input columns that clash with an added one are replaced; all
    others pass through. No shuffle.
    """
    base = without(df, added.fieldNames())
    at = base.columns.index(column)
    out = StructType(base.schema.fields + added.fields)
    types = to_arrow_schema(added).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for i in range(0, batch.num_rows, slice_rows):
                part = batch.slice(i, slice_rows)
                new = [pa.array(x, t) if not isinstance(x, pa.Array) else x
                       for x, t in zip(make(part.column(at)), types)]
                yield pa.RecordBatch.from_arrays(part.columns + new, names=out.fieldNames())

    return base.mapInArrow(run, out)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row offsets and bytes of a string array; a null row is empty."""
    col = column.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return off - off[0], data[off[0]:off[-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalising hash of each uint64."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list array whose rows all have ``dim`` items."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one numpy pass works on.
PASS_BYTES = 2 << 20


def word_hashes(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of words of each row, and a 64-bit hash of every word in order.

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased. A hash is the
    sum of the word's bytes, each times a pseudo-random number for its place in the word.
    """
    counts, hashes, row = np.zeros(len(off) - 1, np.int64), [], 0
    while row < len(off) - 1:
        last = max(row + 1, int(np.searchsorted(off, off[row] + PASS_BYTES, "right")) - 1)
        part = _LOWER[data[off[row]:off[last]]]
        word = ~_SPACE[part]
        first = word.copy()
        first[1:] &= ~word[:-1]
        cut = off[row:last] - off[row]  # a row's first byte starts a word whatever stands before
        cut = cut[cut < len(part)]
        first[cut] |= word[cut]
        at = np.flatnonzero(first)
        if len(at):
            span = part[at[0]:]
            place = np.arange(len(span)) - np.repeat(at - at[0], np.diff(np.append(at, len(part))))
            weight = mix64(np.arange(1, int(place.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            with np.errstate(over="ignore"):
                terms = (span.astype(np.uint64) + np.uint64(1)) * weight[place] * word[at[0]:]
                hashes.append(mix64(np.add.reduceat(terms, at - at[0])))
            counts[row:last] = np.diff(np.searchsorted(at, off[row:last + 1] - off[row]))
        row = last
    return counts, np.concatenate(hashes) if hashes else np.empty(0, np.uint64)


#: A key with at least one in so many of the rows is hot.
HOT_SHARE = 200


#: So many rows are no load for one task.
FEW_ROWS = 100_000


def join_by_key(rows: DataFrame, keys: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Join ``rows`` with ``keys`` (one row a key, ``n`` its number of ``rows``) on ``key``.

    A key with ``total / HOT_SHARE`` rows or more is hot; at most ``HOT_SHARE`` keys can be,
    so these are broadcast and their rows stay where they are. The others are shuffled.
    ``rows`` is read twice: pass a stored table. Few rows are joined at once, as no key can be too
    large for a task: each exchange costs the driver a thread.
    """
    if total <= FEW_ROWS:
        return rows.join(keys, key)
    hot = F.broadcast(keys.where(F.col(n) * HOT_SHARE >= total))
    cold = keys.where(F.col(n) * HOT_SHARE < total)
    return (rows.join(hot, key)
            .unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key)))
