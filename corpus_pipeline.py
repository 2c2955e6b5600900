"""A training corpus from raw documents: filter, deduplicate, mix, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.llm import language, minhash, mixing, packing, quality
from tallyhouse.llm.common import packed, stored, table, word_count


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; null and blank texts go."""
    model = quality.train_model(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).filter("accepted").select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; the declared language only teaches."""
    dictionaries = language.learn(docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    return language.identify(docs, dictionaries).filter("accepted").select(*docs.columns)


def keep_one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles of similarity 0.8 or more.

    Of rows that share a kept id one stays. Rows without id have no group and stay.
    """
    groups = minhash.near_duplicates(docs, "doc_id", "text", shingle=5, percent=80)
    kept = stored(groups.filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept-ids")
    work, columns = packed(docs, (), doc_id=F.col("doc_id"))
    found = work.join(kept, "doc_id")
    once = found.filter("rows = 1").select(*columns)
    more = found.filter("rows > 1").dropDuplicates(["doc_id"]).select(*columns)
    return once.union(more).union(docs.filter("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows alike in id, source and text share evenly."""
    keys = ["id", "origin", "content"]
    keyed, columns = packed(
        docs, (), id=F.struct("doc_id"), origin=F.struct("source"), content=F.struct(F.xxhash64("text"), F.crc32("text")), text=F.col("text")
    )
    sized = keyed.select(F.col("id.doc_id").alias("doc_id"), F.col("origin.source").alias("source"), *keys, word_count("text").alias("size"))
    times = (
        mixing.mix(sized, "doc_id", "source", "size").filter("size > 0").groupBy(*keys)
        .agg(F.round(F.sum(F.col("taken") / F.col("size")) / F.count("*")).cast("int").alias("times")).filter("times > 0")
    )
    taken = keyed.drop("text").join(stored(times, "mix-times"), keys)
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in bins of permitted lengths, counted in words."""
    return packing.best_fit(docs.select("doc_id", word_count("text").alias("n_words")), F.col("n_words"))


STAGES = [
    ("quality classifier", keep_good),
    ("language identification", keep_known_languages),
    ("minhash near-dedup", keep_one_per_group),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

# Hash-ordered choices, trained models and bin packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
