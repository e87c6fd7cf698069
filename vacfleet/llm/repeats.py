"""Operator 12: suffix arrays find text that stood earlier; the first occurrence stays.

Texts are UTF-8 bytes. A string of ``length`` bytes that also starts at an earlier position (smaller
document id, or the same document) is a repeat; every byte that a repeat covers is removed.

One suffix array of a corpus fits no task, so the suffixes are dealt to buckets such that suffixes
that agree in their first ``length`` bytes meet:

1. ``frequent``: every task counts the hashes of its ``GRAM``-byte strings, and those frequent in the
   corpus (at most ``1 / FREQUENT_SHARE`` of them by that share) are known before the deal.
2. ``segments``: the key of a window of ``length`` bytes is the least hash of the ``GRAM``-byte strings
   in it, frequent ones last. So a window that is not wholly inside a frequent passage has a key of
   what stands around it, and a passage that most documents share makes no hot key. Neighbouring
   windows mostly have one key: they are shipped as one segment, a few times the text in all, and
   compressed. A task ships a segment's bytes once however often it has them, with all positions,
   so copies of one text are merged before the shuffle.
3. ``earlier``: a bucket merges equal segments again; of a segment, all occurrences but the first are
   repeats throughout. The suffixes of the distinct segments are sorted by prefix doubling; with the
   common prefixes of neighbours in that order, the previous and next suffix of smaller text position
   give each suffix's longest previous factor, up to ``length``. Where it is ``length``, a repeat starts.
4. The spans are gathered by document and cut out of its text.

Bucket sizes follow the corpus: ``BUCKET_BYTES`` of segments each. Keys are dealt by range.

A null or empty text has no bytes. Rows that repeat an id: a row is the same document as its equals
in id and text, and rows of one id with other texts follow each other by a hash of the text. Rows
without an id come last, in the same way. Columns that clash with an added one are replaced, others
pass through. An empty table stays empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from vacfleet.llm.common import mix64, without
from vacfleet.session import store

#: Bytes of the strings whose hashes are keys.
GRAM = 24
#: Text bytes that a task works on before it ships.
CHUNK_BYTES = 16 << 20
#: Text bytes of one numpy pass.
PASS_BYTES = 1 << 17
#: Compression of what is shipped.
LEVEL = 6
#: Bytes of segments in a bucket, and how many bytes of segments a byte of text makes.
BUCKET_BYTES, SPREAD = 12 << 20, 4
#: A segment's greatest number of windows.
MAX_RUN = 256
#: A hash is frequent with so many places in the corpus and in one chunk, and that share of all places.
FREQUENT, FREQUENT_CHUNK, FREQUENT_SHARE = 512, 16, 1 / (1 << 20)
#: Orders rows without an id behind all others.
LAST_ID = (1 << 63) - 1

_ODD = mix64(np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``GRAM`` bytes at each place."""
    part, width, out, size = _BYTE[data], 1, None, 0  # strings of 1, 2, 4, ... bytes make up GRAM
    with np.errstate(over="ignore"):
        for odd in _ODD:
            if GRAM & width:
                out = part if out is None else part[:len(part) - size] * odd + out[width:]
                size += width
            if 2 * width > GRAM:
                return mix64(out)
            part = part[:-width] * odd + part[width:]
            width *= 2


def least(h: np.ndarray, span: int) -> np.ndarray:
    """The least of ``span`` neighbours at each place."""
    size = 1
    while 2 * size <= span:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:len(h) - (span - size)], h[span - size:]) if span > size else h


class Frequent:
    """Membership in a sorted set of hashes, with a table of leading bits in front."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.table = np.zeros(1 << 20, bool)
        self.table[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def mark(self, h: np.ndarray) -> np.ndarray:
        """Hashes in their order of choice: without the last bit, frequent ones behind all others."""
        out = h >> np.uint64(1)
        maybe = np.flatnonzero(self.table[(h >> np.uint64(44)).astype(np.int64)]) if len(self.hashes) else ()
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            out[maybe[self.hashes[at] == h[maybe]]] |= np.uint64(1) << np.uint64(63)
        return out


def rows_and_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """End of each text, and all bytes."""
    return np.cumsum([len(t) for t in texts], dtype=np.int64), np.frombuffer(b"".join(texts), np.uint8)


def segments(ends: np.ndarray, data: np.ndarray, length: int, frequent: Frequent) -> list[np.ndarray]:
    """Key, first window and number of windows of each segment of some texts, and whether the string
    of the key stands there more than once: else no two windows of the segment are equal."""
    out, span = [], length - GRAM + 1
    limit = np.concatenate([[0], ends])
    for low in range(0, max(0, len(data) - length + 1), PASS_BYTES):
        part = data[low:low + PASS_BYTES + length - 1]
        marked = frequent.mark(grams(part))
        key = least(marked, span)
        # windows that run into the next text are none
        start = low + np.arange(len(key))
        valid = start + length <= ends[np.searchsorted(limit, start, "right") - 1]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
        first = np.flatnonzero(new & valid)
        if not len(first):
            continue
        stop = np.append(np.flatnonzero(new | ~valid), len(key))
        run = stop[np.searchsorted(stop, first, "right")] - first
        pieces = -(-run // MAX_RUN)
        which = np.repeat(np.arange(len(first)), pieces)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, run = first[which] + nth * MAX_RUN, np.minimum(run[which] - nth * MAX_RUN, MAX_RUN)
        # the leftmost place of the least hash in the first window, the rightmost in the last
        places, last = np.lib.stride_tricks.sliding_window_view(marked, span), begin + run - 1
        left, right = begin + places[begin].argmin(1), last + span - 1 - places[last][:, ::-1].argmin(1)
        out.append((key[begin], low + begin, run, left != right))
    if not out:
        return [np.empty(0, t) for t in (np.uint64, np.int64, np.int64, bool)]
    return [np.concatenate(x) for x in zip(*out)]


def _packed(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one compressed string; of numbers all first bytes come first, then all second ones."""
    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=LEVEL).compress(struct.pack(f"<{len(raw)}q", *map(len, raw)) + b"".join(raw))


def _unpacked(blob: bytes, types: tuple) -> list:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = struct.unpack_from(f"<{len(types)}q", raw)
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes, types):
        if kind is None:
            out.append(raw[at:at + size])
        else:
            planes = np.frombuffer(raw, np.uint8, size, at).reshape(np.dtype(kind).itemsize, -1)
            out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += size
    return out


#: A message: of each distinct segment its key, windows, whether the key stands there twice, bytes and
#: number of positions; of each position id (as a step from the one before), tag and start.
_MESSAGE = (np.uint32, np.int32, bool, None, np.int32, np.int64, np.int64, np.int64)


def messages(ids: np.ndarray, tags: np.ndarray, texts: list[bytes], length: int, buckets: int,
             frequent: Frequent) -> Iterator[tuple[int, bytes]]:
    """A chunk's distinct segments with their positions, one message for each bucket that has any."""
    ends, data = rows_and_bytes(texts)
    key, first, run, twice = segments(ends, data, length, frequent)
    raw, starts = data.tobytes(), np.concatenate([[0], ends])
    row = np.searchsorted(starts, first, "right") - 1
    key = mix64(key)  # least hashes crowd at the low end
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    key = key.astype(np.uint32)
    order = np.argsort(bucket, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
    for a, b in zip(cut[:-1], cut[1:]):
        if a == b:
            continue
        own = order[a:b]
        at = first[own].tolist()
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[s:s + n + length - 1], len(seen)) for s, n in zip(at, run[own].tolist())])
        by = np.argsort(which, kind="stable")
        head = own[by[np.concatenate([[True], np.diff(which[by]) > 0])]]
        place = own[by]
        yield int(bucket[own[0]]), _packed(
            key[head], run[head].astype(np.int32), twice[head], b"".join(seen), np.bincount(which).astype(np.int32),
            np.diff(ids[row[place]], prepend=0), tags[row[place]], first[place] - starts[row[place]])


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each of ``starts`` by its first ``length`` bytes; equal ones share a rank.

    Prefix doubling: ranks by 8 bytes, then by pairs of ranks. The last step takes two ranks
    that overlap, so no byte beyond ``length`` counts. At least ``length`` bytes follow each start.
    """

    def ranked(x: np.ndarray) -> np.ndarray:
        order = np.argsort(x)
        new = np.concatenate([[0], np.cumsum(x[order][1:] != x[order][:-1])])
        out = np.empty(len(x), np.uint64)
        out[order] = new
        return out

    n = len(data) - 7
    rank = ranked(np.ndarray((n,), ">u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64))
    size = 8
    while 2 * size <= length:
        rank = ranked(rank[:-size] << np.uint64(32) | rank[size:])
        size *= 2
    if size < length:
        return ranked(rank[starts] << np.uint64(32) | rank[starts + length - size])
    return rank[starts]


def common(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Common bytes of the suffixes at ``a`` and ``b``, up to ``length``."""
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        other = windows[a[i:i + (1 << 16)]] != windows[b[i:i + (1 << 16)]]
        out[i:i + (1 << 16)] = np.where(other.any(1), other.argmax(1), length)
    return out


def previous_smaller(text: np.ndarray, shared: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes in order: the previous one with a smaller text position (-1: none), and what it
    shares with it. ``shared[i]`` is what suffixes i-1 and i share.

    Every pointer skips only suffixes of greater position, so it may follow the pointer of the one
    that it points to; all do at once until none needs to. What shares less than ``length`` is not
    followed: it can only share less with what comes before.
    """
    to = np.arange(-1, len(text) - 1)
    got = shared.copy()
    open_ = np.arange(1, len(text))
    while len(open_):
        open_ = open_[(got[open_] >= length) & (text[to[open_]] > text[open_])]
        got[open_] = np.minimum(got[open_], got[to[open_]])
        to[open_] = to[to[open_]]
        open_ = open_[to[open_] >= 0]
    before = (to >= 0) & (text[to] < text)
    return to, np.where(before, got, 0)


def previous_factors(data: np.ndarray, starts: np.ndarray, text: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor, up to ``length``, of the suffix at each of ``starts`` (a shorter one
    may come out shorter still); ``text`` is its place in text order."""
    order = np.lexsort((text, suffix_order(data, starts, length)))
    at, text = starts[order], text[order]
    shared = np.zeros(len(at), np.int64)
    shared[1:] = common(data, at[:-1], at[1:], length)
    _, back = previous_smaller(text, shared, length)
    # the same from the other end: what i shares with the next is what stands at i + 1
    _, ahead = previous_smaller(text[::-1], np.concatenate([[0], shared[1:][::-1]]), length)
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(back, ahead[::-1])
    return out


def earlier(blobs: list[bytes], length: int) -> pd.DataFrame:
    """The spans (``id, tag, low, high``) that a bucket's repeats cover."""
    seen: dict[bytes, int] = {}
    key, run, twice, which, ids, tags, starts = [], [], [], [], [], [], []
    for blob in blobs:
        keys, runs, marks, raw, times, *place = _unpacked(blob, _MESSAGE)
        ends = np.cumsum(runs.astype(np.int64) + length - 1).tolist()
        known = len(seen)
        at = np.array([seen.setdefault(raw[a:b], len(seen)) for a, b in zip([0, *ends[:-1]], ends)], np.int64)
        new = at >= known  # a message has a segment once, so new ones are numbered as they come
        for held, x in zip((key, run, twice), (keys, runs, marks)):
            held.append(x[new])
        which.append(np.repeat(at, times))
        for held, x in zip((ids, tags, starts), (np.cumsum(place[0]), *place[1:])):
            held.append(x)
    key, run, twice, which, ids, tags, starts = map(np.concatenate, (key, run, twice, which, ids, tags, starts))
    run = run.astype(np.int64)
    order = np.lexsort((starts, tags, ids))
    which, ids, tags, starts = which[order], ids[order], tags[order], starts[order]
    # positions are in text order now: the first of a segment stands for it, the others repeat it
    _, first = np.unique(which, return_index=True)
    again = np.ones(len(which), bool)
    again[first] = False
    low, high, of = [starts[again]], [starts[again] + run[which[again]] + length - 1], [np.flatnonzero(again)]

    # the suffixes of distinct segments, but for those whose key no other has and none has twice
    _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
    live = np.flatnonzero((n[inverse] > 1) | twice)
    if len(live):
        texts = list(seen)
        size = run[live] + length - 1
        data = np.frombuffer(b"".join(texts[i] for i in live.tolist()) + bytes(8), np.uint8)
        begin = np.cumsum(size) - size
        nth = np.arange(run[live].sum()) - np.repeat(np.cumsum(run[live]) - run[live], run[live])
        suffix = np.repeat(begin, run[live]) + nth
        # text order: by the segment's first position, then the place in it. Windows of two segments
        # of one document never interleave, as segments are disjoint runs of windows.
        text = np.repeat(first[live], run[live]) * (MAX_RUN + 1) + nth
        hit = previous_factors(data, suffix, text, length) >= length
        where = np.repeat(first[live], run[live])[hit]
        low.append(starts[where] + nth[hit])
        high.append(starts[where] + nth[hit] + length)
        of.append(where)
    low, high, of = map(np.concatenate, (low, high, of))
    # spans of one document that touch are one
    order = np.lexsort((low, tags[of], ids[of]))
    low, high, of = low[order], high[order], of[order]
    if not len(low):
        return pd.DataFrame({"id": [], "tag": [], "low": [], "high": []}).astype(np.int64)
    same = (ids[of][1:] == ids[of][:-1]) & (tags[of][1:] == tags[of][:-1])
    new = np.concatenate([[True], ~same | (low[1:] > high[:-1])])
    at = np.flatnonzero(new)
    return pd.DataFrame({"id": ids[of][at], "tag": tags[of][at], "low": low[at], "high": np.maximum.reduceat(high, at)})


def kept(raw: bytes, spans: list | None) -> tuple[int, int, int, bytes]:
    """Bytes, removed bytes, removed runs and remaining bytes of a text without its sorted spans."""
    at, runs, pieces = 0, 0, []
    for span in spans or ():
        if not runs or span["low"] > at:
            pieces.append(raw[at:span["low"]])
            runs, at = runs + 1, span["low"]
        at = max(at, span["high"])
    left = b"".join([*pieces, raw[at:]])
    return len(raw), len(raw) - len(left), runs, left


def _chunks(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Ids, tags and texts of consecutive rows, about ``most`` bytes at a time."""
    ids, tags, texts, size = [], [], [], 0
    for batch in batches:
        for i, t, raw in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(i)
            tags.append(t)
            texts.append(raw)
            size += len(raw)
            if size >= most:
                yield np.array(ids, np.int64), np.array(tags, np.int64), texts
                ids, tags, texts, size = [], [], [], 0
    if texts:
        yield np.array(ids, np.int64), np.array(tags, np.int64), texts


def frequent(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Bytes of all texts, and the sorted frequent hashes: a bounded number, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in _chunks(batches):
            _, data = rows_and_bytes(texts)
            every = np.empty(max(0, len(data) - GRAM + 1), np.uint64)
            for low in range(0, len(every), PASS_BYTES):
                every[low:low + PASS_BYTES] = grams(data[low:low + PASS_BYTES + GRAM - 1])
            every.sort()
            hashes = np.unique(every[FREQUENT_CHUNK - 1:][every[FREQUENT_CHUNK - 1:] == every[:len(every) - FREQUENT_CHUNK + 1]])
            n = np.searchsorted(every, hashes, "right") - np.searchsorted(every, hashes)
            # the chunk's bytes are a row without a hash
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *hashes.astype(np.int64).tolist()], pa.int64()), pa.array([len(data), *n.tolist()], pa.int64())],
                names=["gram", "n"])

    sums = store(rows.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "repeat_grams")
    size = sums.where("gram is null").agg(F.sum("n")).first()[0] or 0
    often = sums.where(F.col("gram").isNotNull() & (F.col("n") >= max(FREQUENT, int(size * FREQUENT_SHARE)))).toPandas()
    return size, np.sort(often["gram"].to_numpy(np.int64).astype(np.uint64))


def repeated_spans(rows: DataFrame, length: int) -> DataFrame:
    """``id, tag, spans`` of the documents with repeats; spans are sorted and may touch."""
    size, hashes = frequent(rows)
    buckets = max(4, -(-size * SPREAD // BUCKET_BYTES))

    def batch_of(held: list) -> pa.RecordBatch:
        numbers, blobs = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "message"])

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Frequent(hashes)
        for ids, tags, texts in _chunks(batches):
            held, size = [], 0
            for message in messages(ids, tags, texts, length, buckets, known):
                held.append(message)
                size += len(message[1])
                if size > PASS_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        return earlier(rows["message"].tolist(), length)

    spans = (rows.mapInArrow(ship, "bucket int, message binary").groupBy("bucket")
             .applyInPandas(find, "id long, tag long, low long, high long"))
    return spans.groupBy("id", "tag").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))


def without_repeats(docs: DataFrame, length: int = 100, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_removed, n_spans, kept_text`` (binary) in place of the text."""
    if length <= GRAM:
        raise ValueError(f"a repeat has more than {GRAM} bytes")
    added = StructType([StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_text", BinaryType())])
    base = without(docs, [n for n in added.fieldNames() if n != text_col])
    rest = [c for c in base.columns if c != text_col]
    raw = F.coalesce(F.col("raw").cast("binary"), F.lit(b""))
    rows = base.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(text_col).alias("raw"),
                       F.coalesce(F.col(key_col).cast("long"), F.lit(LAST_ID)).alias("id"))
    again = store(rows.groupBy("id").count().where("count > 1").select("id", F.lit(True).alias("again")), "repeat_ids")
    if again.isEmpty():
        rows = rows.withColumn("tag", F.lit(0).cast("long"))
        single = rows
    else:  # only rows that share an id need a text's hash to tell them apart
        rows = rows.join(again, "id", "left").withColumn(
            "tag", F.when(F.col("again"), F.xxhash64(raw)).otherwise(F.lit(0).cast("long"))).drop("again")
        single = rows.dropDuplicates(["id", "tag"])
    spans = repeated_spans(single.select("id", "tag", raw.alias("raw")), length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in (b for b in batches if b.num_rows):
            new = zip(*(kept(unpack(raw), own) for raw, own in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())))
            arrays = [pa.array(x, t) for x, t in zip(new, [pa.int64()] * 3 + [pa.binary()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["row", *added.fieldNames()])

    out = StructType([StructField("row", rows.schema["row"].dataType), *added.fields])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(x) for x in batch.column(3).to_pylist()], pa.binary())],
                                             names=["row", "id", "tag", "raw"])

    # texts travel compressed to their spans
    sent = rows.select("row", "id", "tag", raw.alias("raw"))
    sent = sent.mapInArrow(squeeze, sent.schema)
    joined = sent.join(spans.hint("shuffle_hash"), ["id", "tag"], "left").select("row", "raw", "spans")
    return joined.mapInArrow(cut, out).select("row.*", *added.fieldNames())
