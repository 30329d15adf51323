"""The corpus pipeline: language ID, near-duplicates, decontamination, surrogates, packing, one table after another.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents. Rows with a null or letterless text go at the first stage; an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontam, langid, neardup, packing, pii
from docloom.llm.shared import scratch, shared_folder

SURROGATE_KEY = "corpus-release-1"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is told; ``und`` (null text or no letter) is rejected."""
    model = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return langid.identify(spark, rows, model, keep=["row"]).filter(F.col("lang_pred") != langid.UND).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return neardup.deduplicate(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word passage (or a whole shorter item) of the benchmark."""
    return decontam.decontaminate(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in every text."""
    return pii.pseudonymise(spark, docs, SURROGATE_KEY)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; near copies are gone by now, so equal texts are the only clusters."""
    return packing.pack_encoded(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("best_fit_packing", best_fit_packing),
]

#: Language ID and near-duplicate signatures can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
