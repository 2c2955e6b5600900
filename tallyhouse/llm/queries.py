"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import (
    ann, html_text, language, minhash, mixing, packing, phrases, quality, sharding, token_counts, url_rules,
    vector_codes, vector_dedup,
)
from tallyhouse.llm.common import table, word_count
from tallyhouse.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]

TOKEN_LIMIT = 1024
SHARDS = 24
NEIGHBOURS = 20
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every whole document and whether they pass the limit."""
    counts = token_counts.count_tokens(table(spark, folder, "documents"), "doc_id", "text", _tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_hypergeometric_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 24 shards whose counts differ by one at most (law ``rows``)."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return sharding.shard_rows(sized, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces in bins of 256 to 4096 words."""
    words = table(spark, folder, "documents").select("doc_id", word_count("text").alias("n_words"))
    return packing.best_fit(words, F.col("n_words"))


def op4_multi_index_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return ann.nearest(table(spark, folder, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, NEIGHBOURS)


def op5_compression_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    taught = docs.filter(F.coalesce(~held_out, F.lit(True)))
    dictionaries = language.learn(taught, F.col("lang"), F.col("text"), F.col("doc_id"))
    judged = language.identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), dictionaries)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op6_fair_queue_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Words the mix takes of every document."""
    sized = table(spark, folder, "documents").select("doc_id", "source", word_count("text").alias("size"))
    return mixing.mix(sized, "doc_id", "source", "size").drop("source")


def op7_int8_tile_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors of one label linked by a cosine of 0.98 or more."""
    return vector_dedup.near_duplicate_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", "label", 0.98)


def op8_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by both views and together."""
    docs = table(spark, folder, "documents")
    model = quality.train_model(docs, table(spark, folder, "labels"))
    return quality.score_quality(docs, model).select("doc_id", "text_quality", "meta_quality", "quality_score", "accepted")


def op9_suffix_array_html(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, folder, "pages")).drop("boilerplate_tokens")


def op10_bbit_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents linked by three-word shingle sets of similarity 0.85 or more."""
    return minhash.near_duplicates(table(spark, folder, "documents"), "doc_id", "text", shingle=3, percent=85)


def op11_walsh_hadamard_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of every vector in eight codebooks of sixteen entries."""
    return vector_codes.code_vectors(table(spark, folder, "embeddings"), "vec_id", "embedding", "label").drop("label")


def op12_url_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path and verdict of every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, folder, "pages").select("page_id", "url"), "url", rules).drop("url")


def op13_dynamic_phrase_counting(spark: SparkSession, folder: str) -> DataFrame:
    """The 2000 strongest collocations of two and three words of every language."""
    return phrases.collocations(table(spark, folder, "documents"), F.col("lang"), F.col("text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_hypergeometric_shards, op3_best_fit_packing, op4_multi_index_hashing,
        op5_compression_language_id, op6_fair_queue_mixing, op7_int8_tile_dedup, op8_cotraining_quality,
        op9_suffix_array_html, op10_bbit_minhash, op11_walsh_hadamard_codes, op12_url_trie, op13_dynamic_phrase_counting,
    )
}
