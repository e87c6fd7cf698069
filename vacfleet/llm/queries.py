"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacfleet.llm import audit, bpe, chat, extract, langid, lexical, lm, minhash, mixing, pq, quality, rabitq, repeats
from vacfleet.llm.common import in_fold

RANKS = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, decoded again; digests of both."""
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.decode(bpe.encode(docs, ranks, pattern).drop("text"), ranks, pattern)
    return out.select(
        "doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("token_ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Budgeted windows of every conversation and of conversation -1, read back."""
    said = "<|im_end|><|im_start|>assistant ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return chat.digests(chat.windows(rows.unionByName(extra)))


def op3_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of all other vectors for every hundredth id."""
    return rabitq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link counts and components of all vectors at cosine 0.9."""
    return pq.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs.withColumn("held_out", held), model).drop("text")


def op6_near_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles at similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = in_fold(F.col("doc_id"), 4, 2)
    model = langid.fit(docs, ~held)
    return langid.predict(docs.drop("lang").withColumn("held_out", held), model).drop("text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raked sampling rate of every document, and its copies in the mix."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"),
                      "topic", "n_tokens", "rate", "copies", "kept")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    field = extract.train(extract.labelled_pages(400))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages, field).drop("html")


def op10_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document; learned from all rows that are not held out."""
    held = in_fold(F.col("doc_id"), 5, 1)
    out = lm.score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters keep, remove and lose at each step of every order, by source."""
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_repeated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that a 100-byte string covers which also starts earlier."""
    out = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all documents for each benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_chat_windows": op2_chat_windows,
    "op3_rotated_codes": op3_rotated_codes,
    "op4_near_vectors": op4_near_vectors,
    "op5_quality": op5_quality,
    "op6_near_text": op6_near_text,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_main_text": op9_main_text,
    "op10_backoff_lm": op10_backoff_lm,
    "op11_filter_audit": op11_filter_audit,
    "op12_repeated_text": op12_repeated_text,
    "op13_ranked_search": op13_ranked_search,
}

ORACLE = {
    "op2_chat_windows": chat.oracle(),
    "op8_mixing": mixing.oracle(),
    "op11_filter_audit": audit.oracle(),
    "op13_ranked_search": lexical.oracle(),
}
