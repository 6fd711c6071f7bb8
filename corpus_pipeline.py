"""A training-text pipeline: documents in, cleaned and encoded documents out.

Each stage works on all that its predecessor kept. In every stage null and empty texts have no words (the quality
rules reject them), null ids are ordinary rows that are no copies of others, rows that repeat are treated alike, and
of rows equal in id and text near-dedup keeps one; very long texts are read whole, ties fall to the smallest doc_id, an
empty table gives an empty table, and columns other than those of documents don't pass. ORACLE_SQL is None: surrogates and BPE ids can't be
expressed in SQL; tests/llm/test_pipeline.py checks run() against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeplane.llm import decontam, quality, setsketch, surrogates, trie_bpe
from lodeplane.llm.common import cut, read_table
from lodeplane.llm.queries import surrogate_key, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.apply_rules(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8) the smallest doc_id stays."""
    return setsketch.keep_one(docs, k=5, threshold=80).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text."""
    out = surrogates.replace(docs, surrogate_key(spark))
    return out.withColumn("n_chars", F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document."""
    both = trie_bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path(TOKENIZER))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("quality rules", quality_rules), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontaminated), ("PII", private), ("BPE encoding and decoding", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cut(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
