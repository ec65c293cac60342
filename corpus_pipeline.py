"""Corpus pipeline: language ID, exact dedup, near-copy removal, decontamination, packing.

Each stage takes all documents that the stage before kept; all but the last return the columns of
``documents``. Stages are written to a new folder below ``spark.checkpoint.dir`` and read again, so
an executor lost in one stage costs no rerun of the stages before.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from lexloom.llm import decontaminate, exact_dedup, jaccard, language, packing  # noqa: E402
from lexloom.session import cut_lineage, ship  # noqa: E402

NEAR_WORDS, NEAR_SHARE = 5, (80, 100)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters go; mixed texts stay, and all with letters if no row has a language."""
    ship(spark)
    return language.identified(docs, language.trained(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 on five-word shingles connect."""
    ship(spark)
    return jaccard.one_of_each(docs, NEAR_WORDS, *NEAR_SHARE)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", keep_known_language),
    ("exact copies", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("packing", pack),
]

#: Language models and tokenizers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
