"""From raw documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longspark.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from longspark.llm.common import table
from longspark.session import materialize, work_folder


def _plain_reads(spark: SparkSession) -> None:
    """Stages get frames that somebody else reads: see ``common.table``."""
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule go."""
    _plain_reads(spark)
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier go, also nearly; documents of which no text is left go with them.

    The number of characters follows the text.
    """
    _plain_reads(spark)
    found = line_dedup.dedup_lines(docs, apart=True)
    word = r"[^\x20\x09-\x0D]"
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & ~F.col("text").rlike(word)
    out = found.where(F.col("text").isNull() | ~emptied)
    if "n_chars" in docs.columns:
        changed = F.col("n_exact") + F.col("n_near") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the least id."""
    _plain_reads(spark)
    return ngram_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    _plain_reads(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text, and the digest of what they decode to.

    The ids are written before they are decoded: in one plan every task would hold two Python workers at
    once, and all of them would stay, with an encoder each, for the stages of the next run.
    """
    _plain_reads(spark)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = materialize(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN).drop("text"))
    decoded = bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id",
        "ids",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("byte-level BPE", tokens),
]

#: Edit joins, similarity components and BPE cannot be put in SQL at this size: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = f"{work_folder(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
