"""A corpus pipeline: toxic documents go, poor ones go, one of each near-duplicate group stays, sources are mixed, the rest
is packed. Every stage reads what the one before it wrote.

All stages but the last return the columns of their input, whatever their names. Null text is empty; an empty text is neither
toxic nor, without labels of both classes, poor, and all texts without words are one near-duplicate group. Rows may repeat and
may share or lack a doc_id: they are told apart by all columns, ties go to the least doc_id (null last). An empty table gives an
empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from featurelab.llm import copies, mix, pack, quality, toxicity
from featurelab.llm.common import table, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return copies.one_of_each(docs)


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix.mixed_documents(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack_documents(docs)


STAGES = [("toxicity", _toxicity), ("quality", _quality), ("near_dedup", _near_dedup), ("mixing", _mixing), ("packing", _packing)]

#: SQL cannot express the classifiers; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        docs = written(kept, f"pipeline-{name}")
        copies.drop_sets(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
