"""The corpus pipeline: raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revpulse.llm import bpe, decontaminate, minhash, pii, quality
from revpulse.llm.components import cut
from revpulse.llm.sharding import with_rank


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("good").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates (five-word shingles, 0.8): the one with the smallest id.

    Rows whose id is null or not theirs alone are told apart by their texts: of equal rows one stays, and each other one takes a number
    beyond all ids, so it is linked like any document and stays only if no document with an id of its own is in its group.
    """
    shared = cut(docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1 or doc_id is null").select(F.col("doc_id").alias("__shared")))
    if shared.isEmpty():
        return _without_copies(docs, "doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("__shared"))
    own = docs.join(shared, same, "left_anti").withColumn("__node", F.col("doc_id").cast("long"))
    others = docs.join(shared, same, "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("__node", F.lit(None).cast("long"))
    high = own.agg(F.max("__node")).first()[0]
    if high is not None and high >= 1 << 62:  # no room beyond: all are numbered
        own, others, high = own.limit(0), own.unionByName(others), None
    row = F.struct(*docs.columns).alias("__row")
    placed, _ = with_rank(others.select(row, F.isnull("__node").alias("__late"), F.isnull("doc_id").alias("__none"), F.col("doc_id").alias("__id"), F.col("text").alias("__text")),
                          ["__late", "__none", "__id", "__text"])
    numbered = placed.select("__row.*", (F.col("rank") + F.lit(0 if high is None else max(high, 0) + 1)).alias("__node"))
    return _without_copies(own.unionByName(numbered), "__node").select(*docs.columns)


def _without_copies(docs: DataFrame, node: str) -> DataFrame:
    found = minhash.near_duplicates(docs.select(F.col(node).alias("doc_id"), "text"), percent=80, bands=28)
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(node) == F.col("__gone"), "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word of any benchmark window."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.find_passages(docs, items).where(F.size("hits") == 0).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars counts the new text."""
    found = pii.find_personal_data(docs)
    changed = F.size("spans") > 0
    return found.withColumn("n_chars", F.when(changed, F.char_length("redacted").cast("long")).otherwise(F.col("n_chars"))).withColumn(
        "text", F.col("redacted")).select(*docs.columns)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", mask_personal_data),
    ("BPE encoding and decoding", to_tokens),
]

ORACLE_SQL = None  # trained models take part; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)  # the next stage reads it several times
    return docs
