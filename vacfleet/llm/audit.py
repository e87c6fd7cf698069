"""Operator 11: how filters interact, audited over every order in wide packed counters.

Each document has a mask of the filters that it fails. An order applies the filters from left to
right; at each step a document is kept, removed, or was removed before (and if it fails the step's
filter too, it is redundant there). A mask fixes all of this, so it is mapped to one big integer
whose fields say, for each of the 120 orders x 5 steps, whether such a document is kept, removed or
redundant, with one more field a filter for documents that fail nothing else. Adding the integers
of a part's documents counts all fields at once. A field is as wide as the number of rows has bits,
so no sum of the table's rows can run into the next field. The sums over documents of good quality
and over toxic ones give what each step loses of these.

The filters (fixed values): A fewer than 50 words; B distinct words under 65 % of the words;
C capitals A-Z over 5 % of the code points; D any of ``#$%&*|``; E a text that a smaller id has too.

Every task adds up its own documents, at most ``HELD_PARTS`` parts at a time, and ships one integer
a part and kind; the integers of a part are added in two levels, read as a stream, so a part with
most of the documents is neither one task's rows nor one group. Equal texts are found by their
SHA-256 digest: the smallest id of a digest is a combined aggregate, and rows meet it by digest and
id together, so a text with a third of the rows is no hot key.

A null or empty text is empty: it fails A and is a text like any other to E. A null part is ''. A
row without an id never fails E and makes no other row fail it; rows that repeat an id and its text
have no smaller id among each other, and each is counted. A label holds if any row of the id says
so; null labels do not. Columns beyond those named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from vacfleet.llm.common import enrich
from vacfleet.session import store

# Fixed values of the filters.
FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_CAPITAL_PERCENT = 5
SYMBOLS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: UTF-8 bytes that begin no code point.
CONTINUATION = bytes(range(0x80, 0xC0))

ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
#: Fields of an integer: three outcomes of each step, and for each filter the masks of it alone.
OUTCOMES = ("kept", "removed", "redundant")
FIELDS = len(OUTCOMES) * STEPS + len(FILTERS)
#: Parts whose sums a task holds before it sends them on.
HELD_PARTS = 512
#: First-level sums of a part: tasks are dealt to so many of them.
SALTS = 64

_SUMS = "part string, kind int, salt int, total binary"


def bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def text_mask(raw: bytes) -> int:
    """Filters A to D that a text fails; its words are runs without ASCII white space."""
    words = raw.split()
    points = len(raw.translate(None, CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    return (bit("A") * (len(words) < MIN_WORDS)
            | bit("B") * (100 * len(set(words)) < MIN_DISTINCT_PERCENT * len(words))
            | bit("C") * (100 * capitals > MAX_CAPITAL_PERCENT * points)
            | bit("D") * (len(raw.translate(None, SYMBOLS)) < len(raw)))


def outcomes(mask: int) -> list[int]:
    """The fields (0 or 1) of a document that fails the filters of ``mask``."""
    kept, removed, redundant = [], [], []
    for order in ORDERS:
        gone = False
        for letter in order:
            fails = bool(mask & bit(letter))
            removed.append(int(fails and not gone))
            redundant.append(int(fails and gone))
            gone = gone or fails
            kept.append(int(not gone))
    return kept + removed + redundant + [int(mask == bit(f)) for f in FILTERS]


def pack(fields: list[int], width: int) -> int:
    """One integer with ``fields`` in it, the first in the lowest ``width`` bits."""
    return sum(x << (i * width) for i, x in enumerate(fields))


def unpack(total: int, width: int) -> np.ndarray:
    """The fields of an integer."""
    raw = np.frombuffer(total.to_bytes(-(-FIELDS * width // 8), "little"), np.uint8)
    bits = np.unpackbits(raw, bitorder="little")[:FIELDS * width].reshape(FIELDS, width)
    return bits.astype(np.int64) @ (np.int64(1) << np.arange(width, dtype=np.int64))


def described(docs: DataFrame, labels: DataFrame, key_col: str, text_col: str, part_col: str) -> DataFrame:
    """``part, mask, good, toxic`` of every row."""

    def start():
        def make(column: pa.Array) -> list:
            texts = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
            return [[text_mask(x) for x in texts], [hashlib.sha256(x).digest() for x in texts]]
        return make

    rows = docs.select(F.col(key_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).alias("body"))
    added = StructType([StructField("mask", IntegerType()), StructField("digest", BinaryType())])
    rows = store(enrich(rows, "body", added, start).drop("body"), "audit_rows")
    first = (rows.where("id is not null").groupBy("digest").agg(F.min("id").alias("id"))
             .withColumn("first", F.lit(True)))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # both joins have the id among their keys: no key is hot, but for repeated rows
    copies = F.when(F.col("id").isNotNull() & F.col("first").isNull(), F.lit(bit("E"))).otherwise(F.lit(0))
    return (rows.join(first, ["digest", "id"], "left").join(marks, "id", "left")
            .select("part", F.col("mask").bitwiseOR(copies).alias("mask"),
                    *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic"))))


def _flush(sums: dict, salt: int, width: int) -> pa.RecordBatch:
    size = -(-FIELDS * width // 8)
    keys = list(sums)
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
        pa.array([salt] * len(keys), pa.int32()),
        pa.array([sums[k].to_bytes(size, "little") for k in keys], pa.binary())],
        names=["part", "kind", "salt", "total"])


def packed_sums(rows: DataFrame, width: int) -> DataFrame:
    """``part, kind, total``: a part's added integers over all its rows (kind 0), the good ones (1)
    and the toxic ones (2)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        salt = TaskContext.get().partitionId() % SALTS
        value = [pack(outcomes(mask), width) for mask in range(1 << len(FILTERS))]
        sums: dict = {}
        for batch in batches:
            for part, mask, good, toxic in zip(*(c.to_pylist() for c in batch.columns)):
                for kind, counts in enumerate((True, good, toxic)):
                    if counts:
                        sums[part, kind] = sums.get((part, kind), 0) + value[mask]
                if len(sums) >= 3 * HELD_PARTS:
                    yield _flush(sums, salt, width)
                    sums = {}
        if sums:
            yield _flush(sums, salt, width)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, salt = None, 0, 0  # rows come sorted by key
        for batch in batches:
            for part, kind, at, total in zip(*(c.to_pylist() for c in batch.columns)):
                if (part, kind, at) != now:
                    if now is not None:
                        yield _flush({now[:2]: held}, now[2], width)
                    now, held = (part, kind, at), 0
                held += int.from_bytes(total, "little")
        if now is not None:
            yield _flush({now[:2]: held}, now[2], width)

    keys = ["part", "kind", "salt"]
    salted = rows.mapInArrow(add, _SUMS).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, _SUMS)
    whole = salted.withColumn("salt", F.lit(0)).select(*keys, "total")
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, _SUMS).drop("salt")


def report(sums: DataFrame, width: int) -> DataFrame:
    """The 600 rows of each part, read from its integers."""
    out = ("part string, filter_order string, step int, kept long, removed long, redundant long, "
           "unique_fails long, good_lost long, toxic_lost long, shapley long")
    names = [x.split()[0] for x in out.split(", ")]
    at = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS]).ravel()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(FIELDS, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                whole, good, toxic = (unpack(int.from_bytes(row[k], "little"), width) if row[k] else zero
                                      for k in ("whole", "good", "toxic"))
                kept, removed, redundant = whole[:3 * STEPS].reshape(3, STEPS)
                shapley = np.bincount(at, removed, len(FILTERS)).astype(np.int64)
                cols = [[row["part"]] * STEPS, np.repeat(ORDERS, len(FILTERS)).tolist(),
                        np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
                        kept, removed, redundant, whole[3 * STEPS:][at],
                        good[STEPS:2 * STEPS], toxic[STEPS:2 * STEPS], shapley[at]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    kinds = [F.max(F.when(F.col("kind") == k, F.col("total"))).alias(name) for k, name in enumerate(("whole", "good", "toxic"))]
    return sums.groupBy("part").agg(*kinds).mapInArrow(read, out)


def audit(docs: DataFrame, labels: DataFrame, key_col: str = "doc_id", text_col: str = "text",
          part_col: str = "source") -> DataFrame:
    """One row for each part, order and step: what the step keeps, removes and loses there.

    ``labels`` has ``doc_id, quality, toxic``. ``unique_fails`` counts documents that fail only the
    step's filter; ``shapley`` adds what the filter removes over all orders.
    """
    rows = store(described(docs, labels, key_col, text_col, part_col), "audit_masks")
    width = max(1, rows.count().bit_length())
    return report(packed_sums(rows, width), width)


def oracle() -> str:
    """The same report in SQL, from counts of masks instead of packed sums."""
    upto = " + ".join(f"(list_position(o, '{x}') <= step)::int * \"{x}\"" for x in FILTERS)
    return f"""with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
m as (select *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
  min(doc_id) over (partition by t) as least_id from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
f as (select part,
    (len(w) < {MIN_WORDS})::int as "A",
    (100 * len(list_distinct(w)) < {MIN_DISTINCT_PERCENT} * len(w))::int as "B",
    (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MAX_CAPITAL_PERCENT} * length(t))::int as "C",
    regexp_matches(t, '[#$%&*|]')::int as "D",
    coalesce(m.doc_id > least_id, false)::int as "E",
    coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from m left join l on l.doc_id = m.doc_id),
c as (select part, "A", "B", "C", "D", "E", "A" + "B" + "C" + "D" + "E" as fails, good, toxic, count(*) as n
  from f group by all),
x as (select unnest(string_split('A B C D E', ' ')) as x),
o as (select [a.x, b.x, c.x, d.x, e.x] as o from x a, x b, x c, x d, x e
  where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o, unnest(range(1, 6)) as step from o),
g as (select part, array_to_string(o, '') as filter_order, step::int as step, o[step] as letter, n, fails, good, toxic,
    {upto} as upto,
    case o[step] when 'A' then "A" when 'B' then "B" when 'C' then "C" when 'D' then "D" else "E" end as here
  from c, s),
r as (select part, filter_order, step, letter,
    sum(n * (upto = 0)::int)::bigint as kept,
    sum(n * (here = 1 and upto = 1)::int)::bigint as removed,
    sum(n * (here = 1 and upto > 1)::int)::bigint as redundant,
    sum(n * (here = 1 and fails = 1)::int)::bigint as unique_fails,
    sum(n * good * (here = 1 and upto = 1)::int)::bigint as good_lost,
    sum(n * toxic * (here = 1 and upto = 1)::int)::bigint as toxic_lost
  from g group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) over (partition by part, letter)::bigint as shapley
from r"""
