"""Operator 7: language identification by rank-order profiles.

A profile is the list of a language's most frequent character n-grams (one to three
characters of lower-cased letters, a word's edge counting as a character), most frequent
first. A document's own list over its whole text is compared with each profile by the
out-of-place distance: for each of the document's n-grams the difference of its two ranks,
or the full penalty where the profile lacks it. The nearest language wins; ties go to the
smaller name.

The classifier is fitted on a bounded sample: at most ``per_language`` labelled rows of each
language, those with the smallest key hash. Prediction reads texts only.

A text that is null or has no letter is ``und`` with score 0. Without labelled rows
everything is ``und``. Texts of any length are read whole; repeated rows count as rows.
Extra columns pass through; columns named like an added one are replaced.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from vacfleet.llm.common import enrich

PROFILE_SIZE = 300
#: Labelled rows of one language that the profiles are fitted on, at most.
PER_LANGUAGE = 500
#: Distinct letters that keep a code of their own; rarer ones share one.
ALPHABET = 1000
UNKNOWN = "und"


def letter_table(alphabet: str) -> np.ndarray:
    """Code of each code point: 0 no letter, 1.. the alphabet, then one for other letters."""
    codes = np.zeros(0x110000, np.uint32)
    every = np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)), bool, 0x110000)
    codes[every] = len(alphabet) + 1
    for i, c in enumerate(alphabet):
        codes[ord(c)] = i + 1
    return codes


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams of a row of letter codes, most frequent first (ties: by code)."""
    c = np.concatenate([[0], codes, [0]]).astype(np.uint32)
    one, two = c[1:-1], (c[:-1] << np.uint32(10)) | c[1:]
    three = (c[:-2] << np.uint32(20)) | two[1:]
    found = np.concatenate([one[one > 0], two[(c[:-1] > 0) | (c[1:] > 0)] | np.uint32(1 << 30),
                            three[c[1:-1] > 0] | np.uint32(2 << 30)])
    found.sort()
    cuts = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
    grams = found[cuts].astype(np.uint64)
    counts = np.diff(np.concatenate([cuts, [len(found)]])).astype(np.uint64)
    order = (counts << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - grams)
    if len(order) > size:
        order = np.partition(order, len(order) - size)[-size:]
    order = np.sort(order)[::-1]
    return (np.uint64(0xFFFFFFFF) - (order & np.uint64(0xFFFFFFFF))).astype(np.uint32)


def coded(text: str, table: np.ndarray) -> np.ndarray:
    return table[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]


class Profiles:
    """Ranks of every profile's n-grams, one column per language."""

    def __init__(self, texts: dict[str, list[str]], size: int = PROFILE_SIZE):
        letters = Counter()
        for own in texts.values():
            for t in own:
                letters.update(t.lower())
        kept = sorted((c for c in letters if unicodedata.category(c)[0] == "L"), key=lambda c: (-letters[c], c))
        self.alphabet = "".join(kept[:ALPHABET])
        self.size = size
        self.names = sorted(texts)
        table = letter_table(self.alphabet)
        lists = [ranked(coded(" ".join(texts[n]), table), size) for n in self.names]
        self.grams = np.unique(np.concatenate([*lists, np.empty(0, np.uint32)])).astype(np.uint32)
        self.ranks = np.full((len(self.grams) + 1, len(lists)), -1, np.int32)
        for k, own in enumerate(lists):
            self.ranks[np.searchsorted(self.grams, own), k] = np.arange(len(own))

    def nearest(self, own: np.ndarray) -> tuple[str, float]:
        """The nearest language to a document's list, and 1 - distance / largest distance."""
        at = np.searchsorted(self.grams, own)
        hit = np.append(self.grams, np.uint32(0xFFFFFFFF))[at] == own
        ranks = self.ranks[np.where(hit, at, len(self.grams))]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        away = np.where(ranks < 0, self.size, away).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(own))


def fit(docs: DataFrame, train: Column, per_language: int = PER_LANGUAGE,
        key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles from at most ``per_language`` rows of each non-null language with ``train``."""
    order = Window.partitionBy("name").orderBy(F.xxhash64("key"), "key")
    rows = docs.where(train & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(key_col).alias("key"), F.col(text_col).alias("body"), F.col(lang_col).alias("name"))
    # ids are ranked without their texts; at most per_language of each language are broadcast
    ids = (rows.select("key", "name").withColumn("at", F.row_number().over(order))
           .where(F.col("at") <= per_language).select("key", "name").distinct())
    rows = rows.join(F.broadcast(ids), ["key", "name"]).dropDuplicates(["key", "name"]).select("name", "body")
    texts: dict[str, list[str]] = {}
    for name, body in rows.collect():  # at most per_language rows of each language
        texts.setdefault(name, []).append(body)
    return Profiles({n: sorted(t) for n, t in texts.items() if n != UNKNOWN})


def predict(docs: DataFrame, model: Profiles, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1) to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        profiles = shared.value
        table = letter_table(profiles.alphabet)

        def one(text: str | None) -> tuple[str, float]:
            codes = coded(text or "", table)
            if not profiles.names or not codes.any():
                return UNKNOWN, 0.0
            return profiles.nearest(ranked(codes, profiles.size))

        def make(column: pa.Array) -> list:
            found = [one(t) for t in column.to_pylist()]
            return [[x for x, _ in found], [s for _, s in found]]

        return make

    added = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return enrich(docs, text_col, added, start)
