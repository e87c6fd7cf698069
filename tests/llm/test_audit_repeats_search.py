"""Filter audit, repeated text and ranked search against plain versions of the same questions."""

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacfleet.llm import audit, lexical, repeats

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


# ---- filter audit ----------------------------------------------------------------------
def _audit_plainly(rows, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    least = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    fails = []
    for d, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
             "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
             "E": d is not None and d > least.get(text, d)}
        fails.append((part or "", {k for k, v in f.items() if v}, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                upto, here = set(order[:step]), set(order[:step - 1])
                gone = [x for x in own if letter in x[1] and not x[1] & here]
                removed_by[letter] += len(gone)
                out[part, "".join(order), step] = [
                    sum(not x[1] & upto for x in own), len(gone), sum(letter in x[1] and bool(x[1] & here) for x in own),
                    sum(x[1] == {letter} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed_by[order[step - 1]])
    return out


def _audited(spark, rows, labels, schema=DOCS):
    got = audit.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS)).collect()
    return {(r["part"], r["filter_order"], r["step"]):
            [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in got}


def test_audit_equals_plain_counts(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, prose, "a"), (2, prose, "a"), (3, prose, "b"), (4, "SHORT $", "a"), (5, "one two", None),
            (6, None, ""), (7, "", "b"), (None, prose, "a"), (8, "same " * 80, "b"), (9, "é" * 10 + " x", "b"),
            (2, prose, "a"), (10, prose + " A" * 200, "b"), (11, "x " * 30000 + "#", "b")]
    labels = [(1, 1, 0), (2, 1, 1), (2, None, None), (4, 0, 1), (3, 1, None), (None, 1, 1), (77, 1, 1)]
    assert _audited(spark, rows, labels) == _audit_plainly(rows, labels)


def test_audit_of_nothing(spark):
    assert _audited(spark, [], []) == {}


@given(st.lists(st.integers(0, 31), max_size=40))
@settings(max_examples=30, deadline=None)
def test_packed_fields_add_up(masks):
    width = max(1, len(masks).bit_length())
    total = sum(audit.pack(audit.outcomes(m), width) for m in masks)
    want = np.sum([audit.outcomes(m) for m in masks] or [[0] * audit.FIELDS], axis=0)
    assert (audit.unpack(total, width) == want).all()


def test_masks_read_bytes_as_characters():
    assert audit.text_mask("Ä".encode() * 40) == audit.bit("A")          # no A-Z, one word
    assert audit.text_mask(b"A" + b"a" * 19) == audit.bit("A")           # exactly 5 %
    assert audit.text_mask(b"A" + b"a" * 18) == audit.bit("A") | audit.bit("C")


# ---- repeated text ---------------------------------------------------------------------
def _without_repeats_plainly(texts, length=100):
    """Removed places of each text, in the order given."""
    seen, out = set(), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in seen:
                gone[p:p + length] = True
            seen.add(w)
        out.append(gone)
    return out


def _digest(text, gone):
    left = bytes(c for c, g in zip(text, gone) if not g)
    runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
    return len(text), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()


def _cut(spark, rows, schema="doc_id long, text string"):
    out = repeats.without_repeats(spark.createDataFrame(rows, schema).repartition(5)).collect()
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_text"]).hexdigest()) for r in out)


def _random_texts(seed, n=60):
    rng = np.random.default_rng(seed)
    make = lambda size: bytes(rng.integers(97, 101, size).astype(np.uint8)).decode()
    pool = [make(rng.integers(0, 900)) for _ in range(8)] + ["a" * 700, "abcab" * 150, "é" * 130 + "x" * 60, "\0" * 220]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.integers(0, 5)):
            passage = pool[rng.integers(len(pool))]
            a = rng.integers(0, len(passage) + 1)
            text += passage[a:rng.integers(a, len(passage) + 1)] + make(rng.integers(0, 60))
        texts.append(text)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 20000)
    monkeypatch.setattr(repeats, "FREQUENT", 30)
    monkeypatch.setattr(repeats, "FREQUENT_CHUNK", 3)
    texts = [t.encode() for t in _random_texts(seed)]
    gone = _without_repeats_plainly(texts)
    assert any(g.any() for g in gone)
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    assert _cut(spark, rows) == Counter((i, *_digest(t, g)) for i, (t, g) in enumerate(zip(texts, gone)))


def test_repeats_of_odd_rows(spark):
    """Nulls, empty and short texts, repeated rows (one document), two texts of one id (in the order
    of their hashes), rows without an id (last), clashing and extra columns, one very long text."""
    rng = np.random.default_rng(3)
    base = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
    long_text = "".join(f"{i:07d}" for i in range(60000)) + base
    rows = [(5, base, 1, "x"), (5, base, 2, "y"), (7, None, 3, None), (8, "", 4, None), (9, base[:99], 5, None),
            (None, base, 6, None), (6, "z" + base, 7, None), (2 ** 63 - 1, "q" * 250, 8, None), (10, long_text, 9, None)]
    out = repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string, N_BYTES int, extra string"))
    got = {(r["doc_id"], r["extra"], r["n_bytes"]): (r["n_removed"], r["n_spans"], bytes(r["kept_text"])) for r in out.collect()}
    assert len(got) == len(rows)
    kept = got[5, "x", 300], got[5, "y", 300]
    assert kept[0] == kept[1] == (0, 0, base.encode())                   # a repeated row is the same document
    assert got[7, None, 0] == got[8, None, 0] == (0, 0, b"") and got[9, None, 99][0] == 0
    assert got[6, None, 301] == (300, 1, b"z") and got[None, None, 300] == (300, 1, b"")
    assert got[2 ** 63 - 1, None, 250] == (249, 1, b"q")
    assert got[10, None, len(long_text)] == (300, 1, long_text[:-300].encode())
    two = [(1, "k" + base), (1, base + "m"), (2, base)]
    removed = sorted(x[2] for x in _cut(spark, two))
    assert removed == [0, 300, 300]
    assert _cut(spark, []) == Counter()


@given(st.lists(st.sampled_from(["ab", "ba", "aab", "c"]), min_size=40, max_size=120))
@settings(max_examples=25, deadline=None)
def test_previous_factors_equal_plain_search(pieces):
    data = "".join(pieces).encode()
    length = 30
    starts = np.arange(max(0, len(data) - length + 1))
    if not len(starts):
        return
    padded = np.frombuffer(data + bytes(8), np.uint8)
    got = repeats.previous_factors(padded, starts, starts, length) >= length
    want = [data.find(data[p:p + length]) < p for p in starts]
    assert got.tolist() == want


def test_windows_keep_one_segment_each():
    """Every window of every text lies in exactly one segment, whatever the passes."""
    texts = [t.encode() for t in _random_texts(4, 20)]
    ends, data = repeats.rows_and_bytes(texts)
    _, first, run, _ = repeats.segments(ends, data, 100, repeats.Frequent(np.empty(0, np.uint64)))
    covered = np.concatenate([np.arange(a, a + n) for a, n in zip(first, run)])
    want = np.concatenate([np.arange(e - len(t), e - 99) for e, t in zip(ends, texts) if len(t) >= 100])
    assert sorted(covered.tolist()) == want.tolist()


# ---- ranked search ---------------------------------------------------------------------
def _terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def _search_plainly(docs, items, k=10):
    bags = [(d, Counter(_terms(t))) for d, t in docs]
    n = sum(bool(b) for _, b in bags)
    size = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        scored = []
        for d, bag in bags:
            m = 25 + (75 * sum(bag.values()) * n) // size if size else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                        for t in _terms(text) if t in bag)
            if score > 0:
                scored.append((-score, d is None, d))
        out[item] = [(d, -s) for s, _, d in sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k]]
    return {i: v for i, v in out.items() if v}


def _searched(spark, docs, items, k=10):
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string, rank int").repartition(4),
                         spark.createDataFrame(items, "item_id long, text string, score int"), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["rank"])):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
    assert all(sorted(r["rank"] for r in got if r["item_id"] == i) == list(range(1, len(v) + 1)) for i, v in out.items())
    return out


@pytest.mark.parametrize("short,step", [(0, 16), (40, 16), (10 ** 6, 64)])
def test_search_equals_full_scoring(spark, monkeypatch, short, step):
    """Many ties, frequent and rare terms, few and many postings in the accumulators, several shards."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", 3000)
    monkeypatch.setattr(lexical, "walk", lambda lists, n, best, walk=lexical.walk: walk(lists, n, best, short, step))
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)]
    chance = 1 / np.arange(1, 41)
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 40), p=chance / chance.sum()))) for i in range(300)]
    docs += [(1000 + i, "W1 w2,w3") for i in range(30)]
    items = [(i, " ".join(rng.choice(words, rng.integers(1, 25)))) for i in range(12)] + [(50, "w1 w1 w39 w2"), (51, "unseen")]
    rows = [(d, t, 0) for d, t in docs]
    assert _searched(spark, rows, [(i, t, 0) for i, t in items]) == _search_plainly(docs, items)


def test_search_of_odd_rows(spark):
    """Nulls, empty texts, letters beyond ASCII, ids that repeat or are null, one very long text, nothing at all."""
    docs = [(1, "Ärger über naïve Wörter"), (2, None), (3, ""), (4, "über-über naïve x"), (None, "über"), (5, "über"),
            (6, "word " * 50000 + "über"), (5, "über")]
    items = [(1, "ÜBER über"), (2, None), (3, ""), (None, "naïve"), (4, "wörter"), (1, "naïve")]
    got = _searched(spark, [(d, t, 0) for d, t in docs], [(i, t, 0) for i, t in items])
    merged = [(1, "ÜBER über naïve"), (None, "naïve"), (4, "wörter")]
    assert got == _search_plainly(docs, merged)
    assert _searched(spark, [], [(1, "a", 0)]) == {} and _searched(spark, [(1, "a", 0)], []) == {}


def test_search_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 4)
    docs = [(i, f"a b{i % 3} c{i % 5}") for i in range(20)]
    items = [(i, f"b{i % 3} c{i % 5}") for i in range(7)]
    assert _searched(spark, [(d, t, 0) for d, t in docs], [(i, t, 0) for i, t in items]) == _search_plainly(docs, items)
