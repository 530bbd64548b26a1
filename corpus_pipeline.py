"""Documents to training sequences in five stages.

language_id drops documents without a letter or in no learned language; toxicity drops toxic ones; near_dedup keeps one document
of each group of near-duplicates; mixing repeats or drops documents until the sources have their target shares;
packing cuts what is left into token pieces and places them in sequences. Each stage works on all its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import langid, mixing, neardup, packing, toxicity
from lodestone.llm.common import checkpoint_dir, documents, labels

LEAST_COVERAGE = 0.1  # of a text's n-grams, that its language's filter must contain


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs, langid.fit(langid.training_rows(docs)))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("coverage") >= LEAST_COVERAGE)
    return found.where(known).select(*docs.columns)


def low_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs, toxicity.fit(docs, labels(spark, sf_dir)), name="_toxicity")
    return scored.where(F.col("_toxicity") < toxicity.CUT).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_report(docs)


STAGES = [
    ("language_id", language_id),
    ("toxicity", low_toxicity),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
ORACLE_SQL = None  # the stages learn, hash and tokenise; the tests hold them against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written to the shared folder and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4()}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
