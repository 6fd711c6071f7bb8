"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplane, chaining, decontam, histogram_sort, quality, rlbwt, setsketch, surrogates, toxicity, trie_bpe
from .common import read_table
from .oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(read_table(spark, sf_dir, "documents"))


def op2_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = histogram_sort.shard_documents(read_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def surrogate_key(spark: SparkSession) -> str:
    """The secret key of the session; without one, a public key by which surrogates can be recomputed."""
    return spark.conf.get("spark.lodeplane.surrogateKey", "public-demonstration-key")


def op3_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = trie_bpe.round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(read_table(spark, sf_dir, "documents"), k=4, threshold=80).drop("h")


def op5_rlbwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlbwt.strip_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op8_bitplane(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = bitplane.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)
    return bitplane.read_tokens(manifest)


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = surrogates.replace(read_table(spark, sf_dir, "documents"), surrogate_key(spark))
    return out.select("doc_id", "text", "n_entities")


def op10_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents")).drop("lang")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_chaining, op2_histogram_sort, op3_trie_bpe, op4_setsketch, op5_rlbwt, op6_prefix_filter, op7_nearest_examples, op8_bitplane, op9_surrogates, op10_divergence)}

ORACLE_SQL: dict[str, str] = SQL
