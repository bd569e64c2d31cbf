"""Corpus pipeline: language ID, near-dedup, decontamination, mixing and packing, in that order.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``. ``run`` writes each stage's result
as Parquet to the shared folder and reads it back as the next stage's input, so a lost executor
costs at most the running stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, language, mixing, packing, resemblance
from lodestrata.llm.common import persist_table, table

#: The near-duplicate stage follows the general rule for word shingles: five words, and a Jaccard
#: similarity of the shingle sets of 0.8 or more. The bit budget of op8's contract does not bind it.
SHINGLE, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.drop_near_duplicates(docs, shingle=SHINGLE, similarity=SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mixing(docs, table(spark, sf_dir, "labels"))


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_domains),
    ("token_packing", pack_tokens),
]

#: Profiles, fingerprints, fitted rates and token ids are beyond SQL; tests/llm/test_pipeline.py
#: holds the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = persist_table(stage(spark, docs, sf_dir), name)
    return docs
