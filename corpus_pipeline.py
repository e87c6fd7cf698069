"""A training corpus from raw documents: language, quality, near-duplicates, mix, tokens.

Each stage takes the documents that its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``; the last adds the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacfleet.llm import bpe, langid, minhash, mixing, quality
from vacfleet.llm.common import in_fold
from vacfleet.session import configure, store

#: A text whose profile is farther than this from every language's is no language's text.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents go that have no letter (null and empty texts too) or resemble no
    language's profile. Repeated rows are judged alike; without a labelled row, nothing goes but what
    has no letter. An empty table stays empty."""
    configure(spark)
    model = langid.fit(docs, ~in_fold(F.col("doc_id"), 4, 2))
    out = langid.predict(docs, model)
    if not model.names:  # nothing learned: only texts without a letter can be rejected
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = F.col("lang_pred") != langid.UNKNOWN
    return out.where(known & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents go that the classifier scores below its limit. Null texts are empty;
    repeated rows are judged alike; an empty table stays empty."""
    configure(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~in_fold(F.col("doc_id"), 4, 2))
    return quality.score(docs, model).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: one document of each group stays, the one with the smallest id (five-word
    shingles, similarity 0.8). Rows that share that id and their text are one; rows that share it
    but not their text are no copies of each other and stay. Rows without an id stay; null and empty
    texts link with nothing. An empty table stays empty."""
    configure(spark)
    kept = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    same = F.sha2(F.coalesce("text", F.lit("")), 256)
    return (docs.join(kept, "doc_id", "left_semi").withColumn("_same", same).dropDuplicates(["doc_id", "_same"])
            .select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull())))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents are sampled to the raked weights, each as often as it was drawn (a rate
    above 1 repeats a document). Null sources and languages are the value ''; repeated rows are drawn
    alike; an empty table stays empty."""
    configure(spark)
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token ids, their number, and whether they decode to the text again. A null text
    is empty: no tokens. Repeated rows are rows of their own; an empty table stays empty."""
    configure(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    out = bpe.decode(bpe.encode(docs, ranks, pattern), ranks, pattern)
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return out.withColumns({"n_tokens": F.size("token_ids").cast("long"), "round_trip": same}).drop("decoded")


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("mixing", mixed),
    ("tokens", tokenized),
]

#: Profiles, the classifier and the merges have no SQL form; tests hold run() against the
#: operators' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
