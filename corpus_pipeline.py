"""A training-data pipeline: quality rules, language, near-duplicates, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the stage before kept. ``run`` writes
each stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from footlamp.llm import language, mixing, near_copies, quality, sentencepiece_lattice
from footlamp.plans.storage import cut_lineage
from footlamp.session import ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if less of its n-grams than this is known of its best language.
LEAST_LANGUAGE_SCORE = 0.2


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    ship_package(spark)
    return quality.filter_documents(docs.select(*COLUMNS))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose n-grams fit a learned language."""
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    told = language.identify(docs, language.fit(docs))
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return told.where(known).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of five-word Jaccard 0.8 or more join."""
    ship_package(spark)
    return near_copies.deduplicate(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' words as often as the mix takes them, a row for each document and pass."""
    ship_package(spark)
    return mixing.mix_documents(docs.select(*COLUMNS))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix."""
    ship_package(spark)
    model = sentencepiece_lattice.load_model(sentencepiece_lattice.model_path())
    return sentencepiece_lattice.encode(docs, model)


STAGES = [
    ("quality_rules", keep_good),
    ("language_id", keep_known_language),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode_tokens),
]

#: Estimation, fingerprints and lattices have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
