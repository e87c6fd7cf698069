"""The corpus operators against brute force, round trips and held-out rows, with edge cases."""

import hashlib
import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyarrow import parquet
from pyspark.sql import functions as F

import corpus_pipeline
from vacfleet.llm import bpe, chat, extract, langid, lm, minhash, mixing, pq, quality, queries, rabitq
from vacfleet.llm.common import in_fold
from vacfleet.llm.components import components

SF = "/root/testdata/sf0.001"
TEXT = "doc_id long, text string, lang string, source string, score string"
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.", "en", "a", "x"),
    (2, "the QUICK brown fox jumps over the lazy dog.", "en", "a", "x"),
    (2, "the QUICK brown fox jumps over the lazy dog.", "en", "a", "x"),
    (3, None, None, None, None), (4, "", "en", "", None), (5, " \n\t ", "fr", "b", None),
    (6, "un", "fr", "b", None), (7, "un", "fr", None, None), (8, "12 34 !!", None, "b", None),
    (9, "мир 日本語 ﻿ ▁ <|im_end|> \x00 é" + " mot" * 30000, "fr", "b", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, TEXT)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], TEXT)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text):
    return (text or "").encode().lower().split()


def test_bpe_equals_tiktoken(docs, no_docs):
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for r in bpe.decode(bpe.encode(docs, path, pattern), path, pattern).collect():
        assert list(r.token_ids) == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode(no_docs, path, pattern).count() == 0


def test_arrow_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    got = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 5 << 20


def test_bpe_remembers_ids_as_bytes(monkeypatch):
    path, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    monkeypatch.setattr(bpe, "LEARN_ITEMS", 3)
    monkeypatch.setattr(bpe, "CACHE_ITEMS", 40)
    tokens, ids = bpe._vocabulary(path)
    of = bpe.Encoder(tokens, ids, bpe.serialise(tokens), pattern)
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    texts = [r[1] or "" for r in ROWS] + [f"zqx{i} " * 3 for i in range(50)]
    for i in range(0, len(texts), 7):
        assert [a.tolist() for a in of.encode(texts[i:i + 7])] == [enc.encode_ordinary(t) for t in texts[i:i + 7]]
        assert len(of.known) <= 100 and all(type(b) is bytes for b in of.known.values())
    assert vars(bpe.Decoder(tokens, ids)).keys() == {"token"}  # no model is loaded to decode


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be <|im_start|> brief"), (1, 1, "user", "a " * 700), (1, 2, "assistant", "<\\|im_end|> <|"),
            (1, 3, "assistant", None), (1, None, None, "first"), (2, 5, "system", "alone"), (None, 0, "assistant", "ok"),
            (3, 0, "ro\nle\\n|", "x"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same")]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 40)) for i in range(700)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, budget=60, history=20)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for _, r, t in own))
        loss = "".join(t or "" for _, r, t in own if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), sha(loss))
    for r in made.collect():  # within the budget unless one turn alone is longer
        assert r.n_tokens <= 60 or r.n_turns - r.n_repeated == 1
    assert chat.windows(turns.limit(0)).count() == 0


def vectors(n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[100:180] = x[100] + rng.normal(size=(80, dim)) * 0.15
    x[200:240] = x[200]
    return x


def vector_frame(spark, x):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [nan] * 16), (1003, [inf] + [1.0] * 15), (1100, [1.0]),
             (1004, [None] + [1.0] * 15), (None, [1.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 100)
    x = vectors()
    got = rabitq.search(vector_frame(spark, x), F.col("vec_id") % 50 == 0, k=10).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(found) == list(range(0, 600, 50))
    x, hit = x.astype(np.float64), 0
    for q, near in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({v for v, _ in near} & set(np.lexsort((np.arange(len(d)), d))[:10].tolist()))
        assert len(near) == 10 and np.allclose([s for _, s in near], d[[v for v, _ in near]], rtol=1e-12)
    assert hit >= 0.9 * 10 * len(found)
    few = rabitq.search(vector_frame(spark, vectors()[:4]).where("vec_id < 4"), F.col("vec_id") == 0)
    assert few.count() == 3
    assert rabitq.search(vector_frame(spark, vectors()).limit(0), F.lit(True)).count() == 0


def test_repeated_query_rows_ask_once(spark):
    frame = vector_frame(spark, vectors()).where("vec_id < 200")
    want = sorted(rabitq.search(frame, F.col("vec_id") == 0).collect())
    assert [r["rank"] for r in want] == list(range(1, 11)) and len({r.vec_id for r in want}) == 10
    again = frame.unionByName(frame.where("vec_id = 0"))
    assert sorted(rabitq.search(again, F.col("vec_id") == 0).collect()) == want


def test_vector_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(pq, "PIECE", 64)
    x = vectors()
    got = {r.vec_id: r for r in pq.near_vectors(vector_frame(spark, x)).collect()}
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    low = pq.forest(len(x), *np.nonzero(near))
    assert len(got) == 606
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, low[i], low[i] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1100))
    assert pq.near_vectors(vector_frame(spark, x).limit(0)).count() == 0


def brute_components(rows, size, percent=80):
    sets = {}
    for d, t in rows:
        w = words(t)
        k = min(size, len(w))
        sets[d] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()
    low = {d: d for d in sets}
    changed = True
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sets, low


@pytest.mark.parametrize("size", [2, 5])
def test_near_documents(spark, size):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 60)]
    rows = []
    for i in range(120):  # a family of edits, some too far
        w = list(base)
        for j in rng.integers(0, 60, rng.integers(0, 6)):
            w[j] = f"x{rng.integers(0, 9999)}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, rows[0][1].upper()) for i in range(50)] + [(300, "one"), (301, "One "), (302, None), (303, "  "), (304, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keys", F.lit("clash")).repartition(7)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, size).collect()}
    sets, low = brute_components(rows, size)
    assert {d: (r.n_shingles, r.component_id, r.kept) for d, r in got.items()} == {
        d: (len(sets[d]), low[d], low[d] == d) for d in sets}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_near_documents_of_odd_rows(spark):
    """Ids near the largest, one id with several texts, repeated rows, rows without an id, very long texts."""
    big, text = 2 ** 63 - 1, " ".join(f"w{i}" for i in range(60))
    long_text = " ".join(f"v{i}" for i in range(40000))
    rows = [(big, text), (big - 1, text + " tail"), (big - 2, text.upper()), (7, "one two three"), (7, text), (7, text),
            (8, long_text), (9, long_text + " more"), (None, text), (10, None)]
    got = Counter((r.doc_id, r.component_id) for r in
                  minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect())
    # the digest decides which text of id 7 stands for it: all its rows are in one component
    sevens = {c for (d, c) in got if d == 7}
    assert sum(n for (d, _), n in got.items() if d == 7) == 3 and sevens == {7}
    assert got[8, 8] == got[9, 8] == got[10, 10] == 1
    assert len({c for (d, c) in got if d and d > 10}) == 1


def test_signature_distance_is_guaranteed(spark):
    """All pairs within the signature distance that are similar enough end in one component,
    however unlike the others that share their keys are."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(150):
        w = [x if rng.random() > 0.06 else f"x{rng.integers(0, 10 ** 9)}" for x in base]
        rows.append((i, " ".join(w + [f"own{i}_{j}" for j in range(rng.integers(0, 4))])))
    sets, low = brute_components(rows, 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {d: low[d] for d in sets}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3)]
    edges += [(2 ** 63 - 1 - i, 2 ** 63 - 2 - i) for i in range(50)] + [(-2 ** 63 + i, -2 ** 63 + i + 1) for i in range(50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)},
                   **{2 ** 63 - 1 - i: 2 ** 63 - 51 for i in range(51)}, **{-2 ** 63 + i: -2 ** 63 for i in range(51)}}


def test_counts_beyond_32_bits():
    """A word that two blocks have three thousand million times each."""
    import pandas as pd
    word = np.array([7], np.uint64)
    row = {"words": word.tobytes(), "word_n": np.array([3_000_000_000], np.uint64).tobytes(), "pairs": b"", "pair_n": b"",
           "bucket": 0, "first": 0, "last": 0}
    told = lm.answer(pd.DataFrame([{**row, "block": b} for b in (1, 2)]))
    assert [np.frombuffer(x, np.uint64).tolist() for x in told["word_c"]] == [[6_000_000_000]] * 2
    assert told["tokens"].sum() == 6_000_000_000


def test_hostile_pages_take_linear_time():
    """Pages of a million characters that never close what they open."""
    import time
    field = extract.train(extract.labelled_pages(100))
    n = 1 << 20
    pages = [piece * (n // len(piece)) for piece in ("</x ", "<svg><title>", "<a ", "<div>x", "<script ", "<!", "<a '\"")]
    pages += ["<div>" * (n // 10) + "<li>x</li>" * (n // 20), "<script>" + "</script " * (n // 9),
              "".join(f"<x{i}>y</q{i}><p>" for i in range(n // 20))]
    for page in pages:
        start = time.process_time()
        extract.main_text(page, field)
        assert time.process_time() - start < 60, page[:20]


def test_unclosed_tags_keep_the_text():
    own = lambda page: [b.text for b in extract.blocks(page)]
    assert own("<p>one <a href='x' two</p><p>three") == ["one", "three"]     # a tag ends before the next
    assert own('<p title="a > b">one</p>') == ["one"]
    assert own("<p>a <b>b</b> <i c") == ["a b"]


def test_language_and_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = queries.op7_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.where("lang = lang_pred").count() >= 0.95 * lang.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    good = queries.op5_quality(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert good.where("predicted = quality").count() >= 0.9 * good.count()


def test_language_and_quality_edges(docs, no_docs):
    model = langid.fit(docs, F.lit(True))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5, 8))
    assert got[1].lang_pred == "en" and got[9].lang_pred == "fr"
    assert langid.predict(docs, langid.fit(no_docs, F.lit(True))).where("lang_pred <> 'und'").count() == 0
    spark = docs.sparkSession
    none = quality.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, none).where("predicted = 1 and score = 1").count() == len(ROWS)
    some = quality.fit(docs, spark.createDataFrame([(1, 1), (8, 0), (8, 1), (6, None), (None, 1)], "doc_id long, quality int"), F.lit(True))
    assert quality.score(docs, some).where("score between 0 and 1").count() == len(ROWS)
    assert quality.score(no_docs, some).count() == 0


def test_raking_equals_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.oracle()).fetchall())
    cols = [c[0] for c in con.sql(mixing.oracle()).description]
    got = queries.op8_mixing(spark, SF).select(cols).collect()
    assert sorted(map(tuple, got)) == want
    edges = mixing.mix(docs, rounds=3).collect()
    assert len(edges) == len(ROWS) and all(r.rate >= 0 and r.kept == (r.copies > 0) for r in edges)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    mixed = Counter((r.doc_id, r.text) for r in mixing.mixed(docs, rounds=3).collect())
    want = Counter()
    for r in edges:
        want[r.doc_id, r.text] += r.copies
    assert mixed == +want
    assert {r.topic for r in mixing.mix(docs, rounds=1, by=F.col("score")).collect()} == {"", "x"}


def _shares(rows, dim, weight):
    have = Counter()
    for r in rows:
        have[r[dim]] += r.n_tokens * weight(r)
    total = sum(have.values())
    return {v: n / total for v, n in have.items()}


def _mixable(n, rare=False):
    rows = [(i, "a b c " * (1 + i % 7), "en" if i % 9 else "es", ("big", "mid", "small")[(i % 4 > 1) + (i % 16 == 3)], "x") for i in range(n)]
    rows += [(n + i, "see | this | row", "es", "small", "x") for i in range(40)]
    return rows + [(n + 99, "one short text", "en", "rare", "x")] * rare


def test_mix_meets_targets_and_keep(spark):
    """In expectation every share meets its target and the mix holds ``keep`` of the tokens; the drawn
    copies do within the chance of the draw."""
    rows = mixing.mix(spark.createDataFrame(_mixable(4000), TEXT)).collect()
    total = sum(r.n_tokens for r in rows)
    assert math.isclose(sum(r.n_tokens * r.rate for r in rows), mixing.KEEP * total, rel_tol=1e-5)
    assert math.isclose(sum(r.n_tokens * r.copies for r in rows), mixing.KEEP * total, rel_tol=0.03)
    for dim in mixing.DIMS:
        have, rate, drawn = (_shares(rows, dim, w) for w in (lambda r: 1, lambda r: r.rate, lambda r: r.copies))
        scale = sum(v ** mixing.TEMPER for v in have.values())
        for v, share in have.items():
            assert abs(rate[v] - share ** mixing.TEMPER / scale) < 2 * mixing.CLOSE
            assert abs(drawn[v] - rate[v]) < 0.03


def test_a_rare_source_thins_no_other(spark):
    """One short document of its own source is repeated; it takes its own share and no more."""
    plain, with_rare = (mixing.mix(spark.createDataFrame(_mixable(4000, rare), TEXT)).collect() for rare in (False, True))
    before = {r.doc_id: r.rate for r in plain}
    rare = [r for r in with_rare if r.source == "rare"]
    share = sum(r.n_tokens * r.rate for r in rare) / sum(r.n_tokens * r.rate for r in with_rare)
    assert rare[0].copies > 1
    for r in with_rare:
        if r.source != "rare":
            assert abs(r.rate / before[r.doc_id] - 1) < 2 * share


def test_mixing_counts_words_and_matches_patterns(spark):
    said = [("one two  three\n", 3, "prose"), ("\tab\r\ncd ", 2, "prose"), ("extraordinarily", 1, "prose"), (" ", 0, "prose"),
            ("meet me @ noon", 4, "prose"), ("Oh!! fine", 2, "prose"), ("a@b", 1, "contact"), ("x #$% y", 3, "symbols"),
            ("go HOME!!\nnow", 3, "shout"), ("an icense", 2, "prose"), ("a licence", 2, "license"), ("a | b", 3, "table")]
    rows = spark.createDataFrame([(i, t, "en", "a", "x") for i, (t, *_) in enumerate(said)], TEXT)
    got = {r.doc_id: (r.n_tokens, r.topic) for r in mixing.described(rows).collect()}
    assert got == {i: (n, kind) for i, (_, n, kind) in enumerate(said)}


def test_main_text(spark):
    field = extract.train(extract.labelled_pages(300))
    held = extract.labelled_pages(100, seed=77)
    right = n = 0
    for page, labels in held:
        own = extract.blocks(page)
        marks = field.viterbi([extract.features(b, k, len(own)) for k, b in enumerate(own)])
        right += sum(a == b for a, b in zip(marks, labels))
        n += len(labels)
    assert right >= 0.95 * n
    page = ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>"
            "<div class=cookie>We use cookies.</div><article><h1>A &amp; B</h1><p>One\n two<br>three &eacute;.<p>Four <b>five</b>."
            "<script>var t='</p>';</script><!-- no --></article><footer>&copy; me</footer>")
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, "u", ""), (4, "u", "<p")], "page_id long, url string, html string")
    got = {r.page_id: r for r in extract.extract(rows, field).collect()}
    assert got[1].text == "A & B\nOne two three é.\nFour five." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0


def test_blocks_keep_text_after_names_like_raw_ones():
    def said(page):
        return [b.text for b in extract.blocks(page)]

    assert said('<article><p>a <svg class="i"/> b</p><p>c</p></article>') == ["a b", "c"]
    assert said("<article><title-bar></title-bar><p>c</p></article>") == ["c"]
    assert said("<p>a<svg-icon name=x></svg-icon></p><template-x><p>b</p></template-x><script_x><p>c</p>") == ["a", "b", "c"]
    assert said("<p>a <math/>b</p><p>c <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>") == ["a b", "c x=1"]
    for name in ("svg", "math", "noscript", "template"):
        assert said(f"<p>a</p><{name} class=x><p>b</p><p>c</p>") == ["a", "b", "c"]
    for name in ("script", "style", "textarea", "title"):
        assert said(f"<p>a</p><{name} class=x><p>b</p><p>c</p>") == ["a"]
        assert said(f"<p>a</p><{name}><p>b</p></{name} ><p>c</p>") == ["a", "c"]
    for name in ("svg", "noscript", "template"):
        assert said(f"<p>a</p><{name}><b>x</b></{name}><p>c</p>") == ["a", "c"]
    assert said("<p>a <svg><svg>x</svg><text>y</text></svg> b</p>") == ["a b"]
    assert said("<p>a <svg><title/><style/><text>y</text></svg> b</p><p>c <svg><title>t</svg> d</p>") == ["a b", "c d"]
    assert said("<svg><p>a</p><script>x</script><svg/><p>b</p><svg>y</svg>") == ["a", "b"]


def test_viterbi_is_the_best_labelling():
    field = extract.Field()
    field.weight = {"a": 1.3, "b": -0.7, "c": 0.2}
    field.step = [[0.4, -0.9], [-0.6, 0.8]]
    page = [["a"], ["b"], ["c", "b"], ["a", "b"], ["b"], ["c"]]
    x = field.scores(page)

    def total(y):
        return sum(s for s, l in zip(x, y) if l) + sum(field.step[a][b] for a, b in zip(y, y[1:]))

    best = max(([k >> i & 1 for i in range(6)] for k in range(64)), key=total)
    assert field.viterbi(page) == best


def test_language_model(spark, tmp_path):
    rows = [(i, t) for i, (_, t, *_) in enumerate(ROWS)] + [(20 + i, f"a b c{i % 7} a b" + " z" * i) for i in range(40)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    got = {r.doc_id: r for r in lm.score(spark.read.parquet(path), ~in_fold(F.col("doc_id"), 5, 1)).collect()}
    one, two, k = Counter(), Counter(), lm.SMOOTHING
    trained = {d: zlib.crc32(str(d).encode()) % 5 != 1 for d, _ in rows}
    for d, t in rows:
        if trained[d]:
            w = ["<s>", *words(t), "</s>"]
            one.update(w)
            two.update(zip(w, w[1:]))
    starts = one.pop("<s>")
    n, v = sum(one.values()), len(one)
    for d, t in rows:
        w, base, full = ["<s>", *words(t), "</s>"], 0.0, 0.0
        for a, b in zip(w, w[1:]):
            p = (one[b] + 0.5) / (n + 0.5 * (v + 1))
            c = starts if a == "<s>" else one[a]
            base += math.log10(p)
            full += math.log10((two[a, b] + k * p) / (c + k))
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(w) - 1, sum(one[x] > 0 for x in w[1:]), n, trained[d])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, full, rel_tol=1e-9)


def test_language_model_with_other_splits_in_the_second_scan(spark, tmp_path):
    path, size = tmp_path / "docs.parquet", "spark.sql.files.maxPartitionBytes"
    table = pa.table({"doc_id": range(1000), "text": [f"a b c{i % 7} a b d{i} {sha(str(i))}" for i in range(1000)]})
    parquet.write_table(table, path, row_group_size=50)
    docs, train = spark.read.parquet(str(path)), ~in_fold(F.col("doc_id"), 5, 1)
    want = {r.doc_id: r for r in lm.score(docs, train).collect()}
    old = spark.conf.get(size)
    few, many = old, str(path.stat().st_size // 7)
    try:
        for first, second in ((few, many), (many, few)):
            spark.conf.set(size, first)
            out = lm.score(docs, train)
            spark.conf.set(size, second)
            got = {r.doc_id: r for r in out.collect()}
            assert len(got) == 1000 and all(got[d][:5] == want[d][:5] and math.isclose(got[d].score, want[d].score, rel_tol=1e-12)
                                            for d in want)
        spark.conf.set(size, old)
        out = lm.score(docs, train)
        changed = table.set_column(1, "text", pa.array([f"x{i}" for i in range(1000)]))
        parquet.write_table(changed, path, row_group_size=50)
        spark.catalog.refreshByPath(str(path))
        with pytest.raises(Exception, match="other texts"):
            out.collect()
    finally:
        spark.conf.set(size, old)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.99 * len(rows)
    good = {r.doc_id for r in corpus_pipeline.good_quality(spark, kept, SF).collect()}
    assert sum(labels[d] == 1 and d not in good for d in labels) <= 0.03 * len(labels)
    low = brute_components(list(rows.items()), 5)[1]
    alone = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    assert alone == {d for d in low if low[d] == d}
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) <= set(out.columns)
    done = out.collect()
    assert done and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in done)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def test_few_rows_are_joined_at_once(spark, monkeypatch):
    from vacfleet.llm import common
    rows = spark.createDataFrame([(k % 3 * 7, k) for k in range(90)] + [(None, 90)], "key long, v long")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"))
    few = common.join_by_key(rows, keys, "key", "n", 91)
    assert "Union" not in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(common, "FEW_ROWS", 0)
    many = common.join_by_key(rows, keys, "key", "n", 91)
    assert few.columns == many.columns and sorted(few.collect()) == sorted(many.collect()) and few.count() == 90
