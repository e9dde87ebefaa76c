"""The corpus pipeline: five stages, each a Parquet table that the next one reads.

Null texts and texts without a letter go with language ID, and only these where no document names a language to learn
from; of exact copies the row with the largest doc_id stays; of
near copies (five-word shingles, similarity 0.8) the smallest doc_id; the mix repeats documents by epochs; packing
returns pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainline.llm import exact_dedup, language_id, mixing, near_dedup, packing
from grainline.llm.common import shared_dir, ship, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if its language is undetermined or its pooled probability is below this.
LEAST_SCORE = 0.3
#: Keys of documents that go or repeat are broadcast up to so many, about 40 bytes each, and joined by a shuffle beyond.
BROADCAST_KEYS = 100_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of undetermined language; where nothing was learned, only those without a letter."""
    ship(spark)
    languages, network = language_id.learned(docs, F.col("lang").isNotNull())
    if network is None:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language_id.predict(docs, languages, network, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def staying(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """decided (doc_id, text_hash, n, stays): the documents that stay, one of the n rows alike in id and hash.

    Only the keys of documents that go or repeat are joined; texts stay in place where these keys are few, which is
    counted.
    """
    keys = decided.groupBy(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).agg(F.max("stays").alias("k_stays"), F.sum("n").alias("n"))
    odd = stored(keys.where("n > 1 or not k_stays").drop("n"), "odd_keys")
    small = F.broadcast(odd) if odd.count() <= BROADCAST_KEYS else odd
    marked = docs.withColumn("grain_hash", F.xxhash64("text"))
    marked = marked.join(small, (marked["grain_hash"] == small["k_hash"]) & marked["doc_id"].eqNullSafe(small["k_id"]), "left")
    again = marked.where("k_stays").dropDuplicates(["doc_id", "grain_hash"])
    return marked.where("k_stays is null").unionByName(again).select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    ship(spark)
    found = stored(exact_dedup.dedup(docs).select("doc_id", "text_hash", "text_sha256", "kept"), "exact")
    chosen = found.where("kept").groupBy("text_sha256").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select("one.*", F.lit(True).alias("stays"))
    rows = found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    return staying(docs, rows.withColumn("stays", F.lit(False)).unionByName(chosen.withColumn("n", F.lit(0).cast("long"))))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    ship(spark)
    found = near_dedup.near_duplicates(docs)
    return staying(docs, found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max("stays").alias("stays")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents by source."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs every document of the mix into sequences."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("best_fit_packing", pack)]
ORACLE_SQL = None  # neither a trained network nor minhashing is SQL; tests/llm holds a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES[:-1]):
        path = f"{top}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
