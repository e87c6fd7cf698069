"""Operator 1: byte-level BPE through a sentencepiece model serialised from the ranks.

The rank file's tokens become the pieces of a sentencepiece BPE model: each byte is mapped
to one printable character, a piece's score is its negative rank, and normalisation is the
identity, so sentencepiece merges in the order of the ranks. A text is split by the
tokenizer's pattern and each match is encoded by itself; ids are decoded by the inverse
mapping. A match that is itself a token is that token, whatever its merges would give.

Null and empty texts have no tokens. Texts of any length are encoded whole. Extra columns
pass through; columns named like an added one are replaced. An empty table stays empty.
"""

from __future__ import annotations

import base64
import struct
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from vacfleet.llm.common import enrich

#: Encoded matches that a task remembers before it forgets them all (bounds its memory).
CACHE_ITEMS = 150_000
#: Matches that go to sentencepiece at once (their pieces come back as Python numbers).
LEARN_ITEMS = 10_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def byte_characters() -> list[str]:
    """One visible character for each byte: itself where printable, else from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece model file whose piece ``i + 1`` is ``tokens[i]`` (piece 0: unknown).

    ``tokens`` is in the order of the ranks.
    """
    # Field numbers and codes of the public sentencepiece model format.
    # ModelProto: pieces 1, trainer_spec 2, normalizer_spec 3. SentencePiece: piece 1,
    # score 2, type 3 (unknown 2). TrainerSpec: model_type 3 (BPE 2), vocab_size 4, ids of
    # unk 40, bos 41, eos 42, pad 43. NormalizerSpec: name 1, add_dummy_prefix 3,
    # remove_extra_whitespaces 4, escape_whitespaces 5.
    mapped = byte_characters()
    parts = [_bytes(1, _bytes(1, b"<unknown>\xe2\x96\x81") + _number(3, 2))]
    for rank, token in enumerate(tokens):
        piece = "".join(mapped[b] for b in token).encode()
        parts.append(_bytes(1, _bytes(1, piece) + _varint(2 << 3 | 5) + struct.pack("<f", -rank)))
    trainer = (_number(3, 2) + _number(4, len(tokens) + 1) + _number(40, 0)
               + _number(41, -1) + _number(42, -1) + _number(43, -1))
    normalizer = _bytes(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(parts) + _bytes(2, trainer) + _bytes(3, normalizer)


class Encoder:
    """Encoder of one vocabulary (built once a task)."""

    def __init__(self, tokens: list[bytes], ids: list[int], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.split = regex.compile(pattern).findall
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = np.array([-1, *ids], np.int32)
        self.whole = {t: i + 1 for i, t in enumerate(tokens)}
        self.mapped = dict(enumerate(byte_characters()))
        # ids as bytes of int32: a list of Python numbers takes several times as much
        self.known: dict[str, bytes] = {}

    def learn(self, matches: list[str]) -> None:
        """Remember the ids of matches that are not remembered yet."""
        whole, known, mapped = self.whole, self.known, self.mapped
        merge, texts = [], []
        for m in matches:
            raw = m.encode()
            one = whole.get(raw)
            if one is None:
                merge.append(m)
                texts.append(raw.decode("latin-1").translate(mapped))
            else:
                known[m] = self.ids[one].tobytes()
        for m, pieces in zip(merge, self.pieces.encode(texts, num_threads=1)):
            known[m] = self.ids[pieces].tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the matches that are new go to sentencepiece in a few calls."""
        split = [self.split(t) for t in texts]
        new = set(filterfalse(self.known.__contains__, chain.from_iterable(split)))
        if len(self.known) + len(new) > CACHE_ITEMS:
            self.known = {}
            new = set(chain.from_iterable(split))
        new = list(new)
        for i in range(0, len(new), LEARN_ITEMS):
            self.learn(new[i:i + LEARN_ITEMS])
        of = self.known.__getitem__
        return [np.frombuffer(b"".join(map(of, m)), np.int32) for m in split]


class Decoder:
    """Decoder of one vocabulary (built once a task): it needs no model and no pattern."""

    def __init__(self, tokens: list[bytes], ids: list[int]):
        self.token = dict(zip(ids, tokens))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def _vocabulary(ranks_path: str) -> tuple[list[bytes], list[int]]:
    """The tokens in the order of their ranks, and their ids."""
    ranks = read_ranks(ranks_path)
    tokens = sorted(ranks, key=ranks.get)
    return tokens, [ranks[t] for t in tokens]


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text",
           ids_col: str = "token_ids") -> DataFrame:
    """Add the token ids of ``text_col`` as an array of int (null or empty: no ids)."""
    tokens, ids = _vocabulary(ranks_path)
    # A vocabulary file and its model: a few MB, whatever the size of the corpus.
    shared = df.sparkSession.sparkContext.broadcast((tokens, ids, serialise(tokens)))

    def start():
        of = Encoder(*shared.value, pattern)

        def make(column: pa.Array) -> list:
            rows = of.encode([t or "" for t in column.to_pylist()])
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
            flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
            return [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))]

        return make

    added = StructType([StructField(ids_col, ArrayType(IntegerType(), False))])
    return enrich(df, text_col, added, start, slice_rows=128)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids",
           bytes_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids in ``ids_col`` stand for (null ids: no bytes)."""
    shared = df.sparkSession.sparkContext.broadcast(_vocabulary(ranks_path))

    def start():
        of = Decoder(*shared.value)

        def make(column: pa.Array) -> list:
            flat = column.flatten().to_numpy().tolist()
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            return [pa.array([of.decode(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends)], pa.binary())]

        return make

    added = StructType([StructField(bytes_col, BinaryType())])
    return enrich(df, ids_col, added, start, slice_rows=128)
