"""From raw documents to mixed, sharded training data.

``STAGES`` are applied in order; each stage's result is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.llm import decontaminate, langid, minhash, mixing, sharding
from meterwise.llm.scratch import broadcast_if_small, fresh, materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found (null or letterless
    text). A document without an id is judged like any other. If no row has a
    language to learn from, only those without a letter go."""
    model = langid.train(docs, langid.fold("doc_id", 5) != 0)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    key = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    texts = docs.select(F.struct(key[0].alias("k1"), key[1].alias("k2")).alias("k"), "text")
    bad = materialize(langid.identify(texts, model, "k", "text").where(F.col("lang_pred") == langid.UNKNOWN)
                      .select(F.col("doc_id.k1").alias("f1"), F.col("doc_id.k2").alias("f2")).distinct(), "rejected")
    return _without(docs, bad)


def _without(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """``docs`` less the rows whose text has a hash in ``bad`` (f1, f2)."""
    a = fresh("k1", docs.columns)
    b = fresh("k2", [*docs.columns, a])
    c = fresh("f1", [*docs.columns, a, b])
    d = fresh("f2", [*docs.columns, a, b, c])
    return (docs.withColumn(a, F.xxhash64("text")).withColumn(b, F.xxhash64(F.lit(7), "text"))
            .join(broadcast_if_small(bad.toDF(c, d)), (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left_anti")
            .drop(a, b))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group.
    Rows without an id have no group and stay; rows that share an id stay or
    go together."""
    name = fresh("gone", docs.columns)
    gone = materialize(minhash.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name)).distinct(),
                       "near-duplicates")
    return docs.join(broadcast_if_small(gone), F.col("doc_id") == F.col(name), "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window. A null or empty text holds
    none; rows with the same text go together; with an empty benchmark all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that token shares of sources meet the flattest
    mixture of at most two passes; every document stays at least once, also
    those of a null source, which is a source of its own, and empty ones."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the shard of each row; a null text has no bytes, and rows of one id
    (null is one) share a shard, however large."""
    return sharding.shard(docs)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
    ("sharding", sharded),
]

#: Language likelihoods and MinHash buckets have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
