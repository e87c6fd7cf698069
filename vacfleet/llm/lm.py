"""Operator 10: language-model scores from a weighted backoff automaton.

Tokens are a text's words (A-Z lower-cased) and one end token. The model is a smoothed word
bigram learned from all training rows: each known word is a state; a state's arcs are the
bigrams seen after it, and its failure arc leads to the root state, whose arcs are all
words. With N training tokens, V distinct ones, c counts and weight k:

    root arc    P(w)     = (c(w) + 0.5) / (N + 0.5 (V + 1))
    arc         P(w | v) = (c(v w) + k P(w)) / (c(v) + k)
    failure arc          = k / (c(v) + k)

An unknown word leads to the root. A text is scored in one pass from left to right: the
state is carried from token to token, a token without an arc takes the failure arc first,
and the log weights add up.

The counts grow with the corpus, so no task holds the model. Some consecutive rows of a
file are a block. A block counts its own distinct n-grams and sends them, as packed arrays of hashes,
to buckets of the hash range; a bucket adds up the blocks' counts and answers each block with
the corpus counts of just its n-grams; the block builds the part of the automaton that its
texts can reach. Each block sends an n-gram once, so a frequent one is no hot key. Everything
but the answers' file streams through shuffles; a lost executor costs its tasks again.

The files are read twice, and may be split otherwise the second time. So a block is named by its
file and row numbers alone; where tasks of the first scan share a block, each asks for its piece
of it, by first and last row number, and the block scores piece by piece. Answers carry a digest
of the n-grams they are for; a piece whose texts have others ends the query with an error.

A null or empty text is the end token alone. Rows with a null key are not held out. Without
training rows all counts are 0. Extra columns are left out. Repeated rows count as often as
they stand there. The input must be read from Parquet files (a block is a piece of a file).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacfleet.llm.common import mix64, utf8, word_hashes
from vacfleet.session import store

END, START = np.uint64(0x9D39247E33776D41), np.uint64(0x2AF7398005AAA5C7)
#: Text bytes for each bucket of the hash range: what a bucket's task holds follows it.
BUCKET_BYTES = 16 << 20
#: Consecutive rows of a file that make up a block.
BLOCK_ROWS = 2048
#: Hashes that a bucket adds up at a time.
PART = 1 << 18
#: Weight of the root's distribution against a state's own counts.
SMOOTHING = 1000.0

_ASK = "bucket int, block long, first long, last long, words binary, word_n binary, pairs binary, pair_n binary"
_ANSWER = "bucket int, block long, first long, last long, word_c binary, pair_c binary, digest long, tokens long, known long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """End offsets of each row's tokens, and the tokens' hashes (the last of a row: the end)."""
    counts, words = word_hashes(*utf8(column))
    ends = np.cumsum(counts + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends - 1] = True
    out[is_end], out[~is_end] = END, words
    return ends, out


def before(ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The token before each token (the first of a row: the start)."""
    prev = np.empty_like(words)
    prev[1:] = words[:-1]
    starts = np.concatenate([[0], ends[:-1]])
    prev[starts[starts < len(words)]] = START
    return prev


def pair(prev: np.ndarray, words: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(prev * np.uint64(0x9E3779B97F4A7C15) + words)


def bounds(buckets: int) -> np.ndarray:
    """Where the buckets of the hash range begin, but for the first."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def _counted(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each stands in training tokens."""
    distinct, which = np.unique(hashes, return_inverse=True)
    return distinct, np.bincount(which[train], minlength=len(distinct)).astype(np.uint64)


def digest(words: np.ndarray, pairs: np.ndarray) -> int:
    """A number for a set of distinct words and pairs; digests of disjoint sets add up (modulo 2^64)."""
    return int((mix64(words).sum(dtype=np.uint64) + mix64(~pairs).sum(dtype=np.uint64)).astype(np.int64))


def ask(piece: tuple[int, int, int], words: np.ndarray, pairs: np.ndarray, train: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The distinct words and pairs of a piece (block, first and last row) with its own training
    counts, one row a bucket."""
    cells = []
    for hashes in (words, pairs):
        distinct, n = _counted(hashes, train)
        cut = np.concatenate([[0], np.searchsorted(distinct, bounds(buckets)), [len(distinct)]])
        cells.append([(distinct[a:b].tobytes(), n[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:])])
    return pa.RecordBatch.from_arrays([
        pa.array(range(buckets), pa.int32()), *(pa.array([x] * buckets, pa.int64()) for x in piece),
        *(pa.array([c[i] for c in kind], pa.binary()) for kind in cells for i in (0, 1))],
        names=["bucket", "block", "first", "last", "words", "word_n", "pairs", "pair_n"])


def totals(asked: list[np.ndarray], own: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """The sum of ``own`` for each hash of each sorted array ``asked``; the sum of all and the number of
    hashes above 0. The bucket is added up in ranges of about ``PART`` hashes each, one after the other,
    so that sorting takes little beside what was asked."""
    told = [np.empty(len(x), np.uint64) for x in asked]
    lows, highs = [int(x[0]) for x in asked if len(x)], [int(x[-1]) for x in asked if len(x)]
    if not lows:
        return told, 0, 0
    low, high, parts = min(lows), max(highs), -(-sum(map(len, asked)) // PART)
    inner = np.array([low + (high - low) * k // parts for k in range(1, parts)], np.uint64)
    cuts = [np.concatenate([[0], np.searchsorted(x, inner), [len(x)]]) for x in asked]
    n_all, n_known = 0, 0
    for k in range(parts):
        part = [slice(c[k], c[k + 1]) for c in cuts]
        distinct, which = np.unique(np.concatenate([x[s] for x, s in zip(asked, part)]), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        # a corpus may hold a word more than 2^32 times
        np.add.at(total, which, np.concatenate([x[s] for x, s in zip(own, part)]))
        n_all, n_known = n_all + int(total.sum(dtype=np.int64)), n_known + int((total > 0).sum())
        at = 0
        for x, s in zip(told, part):
            n = s.stop - s.start
            x[s] = total[which[at:at + n]]
            at += n
    return told, n_all, n_known


def answer(rows: pd.DataFrame) -> pd.DataFrame:
    """Corpus counts of a bucket's n-grams, in the order in which each piece asked."""
    out = rows[["bucket", "block", "first", "last"]].copy()
    out["digest"] = [digest(np.frombuffer(w, np.uint64), np.frombuffer(p, np.uint64)) for w, p in zip(rows["words"], rows["pairs"])]
    for kind in ("word", "pair"):
        asked = [np.frombuffer(x, np.uint64) for x in rows[f"{kind}s"]]
        own = [np.frombuffer(x, np.uint64) for x in rows[f"{kind}_n"]]
        told, tokens, known = totals(asked, own)
        out[f"{kind}_c"] = [x.tobytes() for x in told]
        if kind == "word":  # each bucket says its sums once
            out["tokens"], out["known"] = 0, 0
            out.iloc[0, out.columns.get_loc("tokens")] = tokens
            out.iloc[0, out.columns.get_loc("known")] = known
    return out[["bucket", "block", "first", "last", "word_c", "pair_c", "digest", "tokens", "known"]]


class Automaton:
    """The states and arcs that one block can reach, as arrays over its distinct words."""

    def __init__(self, word_c: np.ndarray, n_tokens: int, n_known: int, starts: int, smoothing: float):
        self.root = (word_c + 0.5) / (n_tokens + 0.5 * (n_known + 1))
        # state 0 is the root; word i is state i + 1, if known; the last state is the start
        self.seen = np.concatenate([[0], word_c, [starts]]).astype(np.float64)
        self.fail = np.log10(smoothing / (self.seen + smoothing))
        self.smoothing = smoothing

    def traverse(self, word: np.ndarray, ends: np.ndarray, pair_c: np.ndarray) -> np.ndarray:
        """Log10 weight added by each token; ``pair_c`` counts each token's pair with the one before."""
        state = np.empty(len(word), np.int64)  # the state in which a token is read
        state[1:] = np.where(self.seen[word[:-1] + 1] > 0, word[:-1] + 1, 0)
        begin = np.concatenate([[0], ends[:-1]])
        state[begin] = len(self.seen) - 1 if self.seen[-1] > 0 else 0
        low = self.root[word]
        arc = np.log10((pair_c + self.smoothing * low) / (self.seen[state] + self.smoothing))
        return np.where(pair_c > 0, arc, self.fail[state] + np.log10(low))


def score(docs: DataFrame, train: Column, key_col: str = "doc_id", text_col: str = "text",
          smoothing: float = SMOOTHING, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per input row: ``doc_id, trained, n_tokens, n_known, train_tokens, base_score, score``.

    ``train`` marks the rows to learn from; ``docs`` is read from files.
    """
    rows = docs.select(F.col(key_col).alias("doc_id"), F.col(text_col).alias("body"), train.alias("trained"),
                       F.xxhash64(F.input_file_name(), F.floor(F.col("_metadata.row_index") / BLOCK_ROWS)).alias("block"),
                       F.col("_metadata.row_index").alias("at"), F.input_file_block_start().alias("split"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4, -(-size // bucket_bytes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, last, held = None, 0, 0, []

        def flush() -> pa.RecordBatch:
            words, pairs, trained = map(np.concatenate, zip(*held))
            return ask((now[0], first, last), words, pairs, trained, buckets)

        for batch in batches:
            blocks, at, splits = (batch.column(k).to_numpy() for k in (2, 3, 4))
            new = (blocks[1:] != blocks[:-1]) | (splits[1:] != splits[:-1])
            cuts = np.flatnonzero(np.concatenate([[True], new])) if len(blocks) else []
            for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
                if (blocks[a], splits[a]) != now:
                    if held:
                        yield flush()
                    now, first, held = (int(blocks[a]), int(splits[a])), int(at[a]), []
                last = int(at[b - 1])
                part = batch.slice(a, b - a)
                ends, words = tokens(part.column(0))
                each = np.diff(np.concatenate([[0], ends]))
                marks = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                held.append((words, pair(before(ends, words), words), np.repeat(marks, each)))
        if held:
            yield flush()

    asked = rows.select("body", "trained", "block", "at", "split").mapInArrow(count, _ASK)
    told = store(asked.groupBy("bucket").applyInPandas(answer, _ANSWER), "lm_counts")
    sums = told.agg(F.sum("tokens"), F.sum("known")).first()
    n_tokens, n_known = int(sums[0] or 0), int(sums[1] or 0)

    def finish_piece(texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        word_c, pair_c = (np.concatenate([np.frombuffer(x, np.uint64) for x in counts[c]]) for c in ("word_c", "pair_c"))
        ends, words = tokens(pa.array(texts["body"], pa.string()))
        distinct, word = np.unique(words, return_inverse=True)
        pairs, which = np.unique(pair(before(ends, words), words), return_inverse=True)
        asked_for = int(counts["digest"].to_numpy().sum(dtype=np.int64))
        if (len(word_c), len(pair_c), asked_for) != (len(distinct), len(pairs), digest(distinct, pairs)):
            raise RuntimeError("the counts are for other texts than the block has: did the files change?")
        starts = int(word_c[np.searchsorted(distinct, END)])  # as many texts start as end
        automaton = Automaton(word_c, n_tokens, n_known, starts, smoothing)
        begin = np.concatenate([[0], ends[:-1]])
        added = automaton.traverse(word, ends, pair_c[which].astype(np.float64))
        return pd.DataFrame({
            "doc_id": texts["doc_id"], "trained": texts["trained"],
            "n_tokens": np.diff(np.concatenate([[0], ends])),
            "n_known": np.add.reduceat((word_c > 0)[word].astype(np.int64), begin), "train_tokens": n_tokens,
            "base_score": np.add.reduceat(np.log10(automaton.root)[word], begin),
            "score": np.add.reduceat(added, begin)})

    def finish(key, texts: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("at")
        at, done = texts["at"].to_numpy(), []
        for (first, last), own in counts.sort_values("bucket").groupby(["first", "last"]):
            a, b = np.searchsorted(at, first), np.searchsorted(at, last, "right")
            if a == b:
                raise RuntimeError("counts without texts: did the files change?")
            done.append(finish_piece(texts.iloc[a:b], own))
        if sum(map(len, done)) != len(texts):
            raise RuntimeError("texts without counts: did the files change?")
        return pd.concat(done)

    out = ("doc_id long, trained boolean, n_tokens long, n_known long, train_tokens long, "
           "base_score double, score double")
    told = told.select("block", "bucket", "first", "last", "word_c", "pair_c", "digest")
    return (rows.drop("split").groupBy("block").cogroup(told.groupBy("block"))
            .applyInPandas(finish, out))
