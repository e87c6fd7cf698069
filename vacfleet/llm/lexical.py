"""Operator 13: ranked lexical search, accumulators first, then document at a time with skipping.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, only A-Z lower-cased.
The score of a document is the sum over the query's terms, repeats included, of

    w * ((10^9 tf) div (1000 tf + 8 m)),   w = floor(1000 ln((2N + 2) / (2 df + 1))),
    m = 25 + (75 n N) div L

with N documents that have a term, L terms in all, n terms of the document, df documents with the
term and tf its occurrences in the document; all but the logarithm is 64-bit integer arithmetic.

Documents are read once and dealt in shards of consecutive rows, bounded in bytes. A shard's index
holds the posting lists of the asked terms only, as packed arrays, and is stored. Corpus numbers
(N, L, df) are sums over the shards. Each shard then answers every query:

* Term at a time: the query's shortest lists, up to ``SHORT_POSTINGS`` postings together, are added
  into one sorted list of accumulators, whose greatest entry bounds it like a posting list's.
* Document at a time: that list and the long ones are iterators with bounds. Iterators whose
  bounds together cannot reach the tenth best score are no longer walked; the others are merged
  over ranges of documents. A candidate's missing scores are looked up in the lists not walked,
  greatest bound first, and it is given up, without reading the other lists, as soon as the bounds
  left cannot lift it. The tenth best score rises from range to range.

A bound that ties with the tenth best score never excludes, so ties are ranked by id as defined. The
shards' best ``k`` are ranked once more. Work is split by documents, so neither a frequent term nor
a long list is a key. Queries are taken in blocks of bounded bytes, each with its own index.

A null or empty text has no terms; a query without known terms has no rows. Rows without an id rank
behind those with one among equal scores. A repeated document row is a document of its own, each
with its own rank. Query rows that share an id are one query of all their texts; a null id is an id.
Columns beyond those named are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacfleet.session import store

#: Text bytes of a shard (a longer document is a shard of its own).
SHARD_BYTES = 16 << 20
#: Postings of a query's short lists that are added up before the walk.
SHORT_POSTINGS = 4096
#: Documents of a range of the walk.
RANGE_DOCS = 2048
#: Query bytes that one index serves.
QUERY_BYTES = 4 << 20

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SHARD = ("ids binary, no_id binary, sizes binary, n_docs long, n_terms long, "
          "terms binary, ends binary, docs binary, tfs binary")


def terms_of(raw: bytes) -> list[bytes]:
    return raw.translate(_TERM_BYTES).split()


def build(docs: DataFrame, vocabulary: dict[bytes, int], key_col: str, text_col: str) -> DataFrame:
    """The stored index: one row a shard, with the posting lists of ``vocabulary``."""

    def pack(ids: list, sizes: list, lists: dict) -> pa.RecordBatch:
        at = sorted(lists)
        n = np.array(sizes, np.int64)
        row = [np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], bool), n,
               int((n > 0).sum()), int(n.sum()), np.array(at, np.int32),
               np.cumsum([len(lists[t][0]) for t in at], dtype=np.int64),
               np.concatenate([np.array(lists[t][0], np.int32) for t in at] or [np.empty(0, np.int32)]),
               np.concatenate([np.array(lists[t][1], np.int32) for t in at] or [np.empty(0, np.int32)])]
        return pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x]) for x in row],
            names=[c.split()[0] for c in _SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, lists, held = [], [], {}, 0
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py() or b""
                if ids and held + len(raw) > SHARD_BYTES:
                    yield pack(ids, sizes, lists)
                    ids, sizes, lists, held = [], [], {}, 0
                words, place = terms_of(raw), len(ids)
                for term in vocabulary.keys() & (counts := Counter(words)).keys():
                    own = lists.setdefault(vocabulary[term], ([], []))
                    own[0].append(place)
                    own[1].append(counts[term])
                ids.append(batch.column(0)[i].as_py())
                sizes.append(len(words))
                held += len(raw)
        if ids:
            yield pack(ids, sizes, lists)

    rows = docs.select(F.col(key_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("raw"))
    return store(rows.mapInArrow(run, _SHARD), "lexical_index")


def statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and each term's df: sums over the shards, one entry a term of the queries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, ends in zip(*(c.to_pylist() for c in batch.columns)):
                ends = np.frombuffer(ends, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(terms, np.int32)), pa.array(np.diff(ends, prepend=0))], names=["term", "df"])

    n, size = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    df = index.select("terms", "ends").mapInArrow(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return n or 0, size or 0, {r["term"]: r["df"] for r in df.collect()}


class Best:
    """The ``k`` best of the documents offered: highest score, then place in ``order``."""

    def __init__(self, k: int, order: np.ndarray):
        self.k, self.order = k, order
        self.docs, self.scores = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach to matter."""
        return int(self.scores[-1]) if len(self.docs) == self.k else 1

    def offer(self, docs: np.ndarray, scores: np.ndarray) -> None:
        fit = scores >= self.least
        docs, scores = np.concatenate([self.docs, docs[fit]]), np.concatenate([self.scores, scores[fit]])
        take = np.lexsort((self.order[docs], -scores))[:self.k]
        self.docs, self.scores = docs[take], scores[take]


def accumulate(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Term at a time: one list of the documents and summed scores of several."""
    docs, which = np.unique(np.concatenate([d for d, _ in lists]), return_inverse=True)
    scores = np.zeros(len(docs), np.int64)
    np.add.at(scores, which, np.concatenate([s for _, s in lists]))
    return docs, scores


def added(docs: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The scores that a list has for ``docs`` (0 where it has none)."""
    at = np.minimum(np.searchsorted(of[0], docs), len(of[0]) - 1)
    return np.where(of[0][at] == docs, of[1][at], 0)


def walk(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, best: Best,
         short: int = SHORT_POSTINGS, step: int = RANGE_DOCS) -> None:
    """Offer to ``best`` all documents of a query's lists (sorted documents, positive scores) that
    can be among the best."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    sizes = np.cumsum([len(x[0]) for x in lists])
    few = int(np.searchsorted(sizes, short, "right"))
    if few > 1:
        lists = [accumulate(lists[:few]), *lists[few:]]
    bounds = np.array([int(x[1].max()) for x in lists])
    rank = np.argsort(bounds, kind="stable")
    lists, bounds = [lists[i] for i in rank], bounds[rank]
    upto = np.concatenate([[0], np.cumsum(bounds)])  # upto[i]: what lists 0 .. i-1 can add together
    place = np.zeros(len(lists), np.int64)
    for low in range(0, n_docs, step):
        # lists 0 .. idle-1 alone cannot lift a document to the least score that matters
        idle = int(np.searchsorted(upto[1:], best.least, "left"))
        if idle == len(lists):
            return
        parts = []
        for i in range(idle, len(lists)):
            end = int(np.searchsorted(lists[i][0], low + step))
            parts.append((lists[i][0][place[i]:end], lists[i][1][place[i]:end]))
            place[i] = end
        total = np.bincount(np.concatenate([d for d, _ in parts]) - low,
                            np.concatenate([s for _, s in parts]), step)  # exact below 2^53
        total = total.astype(np.int64)
        docs = np.flatnonzero(total)
        scores, docs = total[docs], docs + low
        for i in range(idle - 1, -1, -1):
            stay = scores + upto[i + 1] >= best.least
            docs, scores = docs[stay], scores[stay]
            if not len(docs):
                break
            scores = scores + added(docs, lists[i])
        best.offer(docs, scores)


def answer(shard: dict, queries: dict, weight: np.ndarray, n: int, size: int, k: int) -> Iterator[tuple]:
    """``query, document, score`` of the best ``k`` documents of a shard for each query."""
    ids, no_id = np.frombuffer(shard["ids"], np.int64), np.frombuffer(shard["no_id"], bool)
    m = 25 + (75 * np.frombuffer(shard["sizes"], np.int64) * n) // max(1, size)
    terms, ends = np.frombuffer(shard["terms"], np.int32), np.frombuffer(shard["ends"], np.int64)
    docs, tfs = np.frombuffer(shard["docs"], np.int32), np.frombuffer(shard["tfs"], np.int32).astype(np.int64)
    part = (1_000_000_000 * tfs) // (1000 * tfs + 8 * m[docs])
    at = {int(t): slice(a, b) for t, a, b in zip(terms, [0, *ends[:-1]], ends)}
    order = np.empty(len(ids), np.int64)
    order[np.lexsort((np.arange(len(ids)), ids, no_id))] = np.arange(len(ids))
    for query, wanted in queries.items():
        lists = [(docs[at[t]], part[at[t]] * (times * weight[t])) for t, times in wanted.items() if t in at and weight[t] > 0]
        lists = [(d[s > 0], s[s > 0]) for d, s in lists]
        lists = [x for x in lists if len(x[0])]
        if lists:
            best = Best(k, order)
            walk(lists, len(ids), best)
            for d, s in zip(best.docs, best.scores):
                yield query, None if no_id[d] else int(ids[d]), int(s)


def blocks(items: DataFrame, key_col: str, text_col: str) -> Iterator[dict]:
    """Queries by id, with their terms' bytes, at most ``QUERY_BYTES`` at a time."""
    held, size = {}, 0
    rows = items.select(F.col(key_col).alias("id"), F.col(text_col).cast("binary").alias("raw")).orderBy("id")
    for row in rows.toLocalIterator():
        if size > QUERY_BYTES and row["id"] not in held:
            yield held
            held, size = {}, 0
        held.setdefault(row["id"], Counter()).update(terms_of(bytes(row["raw"] or b"")))
        size += len(row["raw"] or b"")
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", item_key: str = "item_id",
           text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents with a score above 0."""
    spark, out = docs.sparkSession, None
    for block in blocks(items, item_key, text_col):
        words = sorted(set().union(*block.values()))
        vocabulary = {w: i for i, w in enumerate(words)}
        index = build(docs, vocabulary, doc_key, text_col)
        n, size, df = statistics(index)
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))], np.int64)
        queries = {q: {vocabulary[w]: c for w, c in counts.items()} for q, counts in block.items()}

        def run(batches: Iterator[pa.RecordBatch], queries=queries, weight=weight, n=n, size=size) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    shard = {c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}
                    got = list(answer(shard, queries, weight, n, size, k))
                    if got:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, pa.int64()) for c in zip(*got)], names=["item_id", "doc_id", "score"])

        found = index.drop("n_docs", "n_terms").mapInArrow(run, "item_id long, doc_id long, score long")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    best = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return (out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def oracle(k: int = 10) -> str:
    term = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""with q as (select item_id, {term} as term from benchmark),
qt as (select item_id, term, count(*) as times from q group by all),
t as (select doc_id, {term} as term from documents),
d as (select doc_id, count(*) as n from t group by 1),
c as (select count(*)::hugeint as n_docs, sum(n)::hugeint as n_terms from d),
p as (select doc_id, term, count(*)::hugeint as tf from t where term in (select term from qt) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::hugeint as w
  from p, c group by term, n_docs),
s as (select item_id, doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms)))))::bigint as score
  from qt join p using (term) join w using (term) join d using (doc_id), c group by all)
select item_id, rank::int as rank, doc_id, score from (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
where rank <= {k}"""
