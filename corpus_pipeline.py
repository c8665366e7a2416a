"""A corpus pipeline: each stage works on all rows that the stage before it kept.

Defined cases, in every stage: a null or empty text is judged like others (the classifier scores it, the rules fail it;
near-duplicates keep one of all texts without words; packing gives it length 0); a very long text is worked on whole;
a null id stands behind all others where one of a group stays, and is packed; of equal texts (ties) the one with the
smallest id stays, of rows that repeat an id too, any one; an empty table gives an empty result; columns of any name pass through
all stages but packing, which gives its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pricelode.llm import common, gam, near_copies, packing, quality_rules


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 go; the labels of this corpus train the model."""
    return gam.keep_quality(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host does, go."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return near_copies.drop_near_copies(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets a bucket and a batch."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("near-duplicates", near_dedup_stage),
    ("packing", packing_stage),
]

#: SQL can't express the classifier or the fingerprints' search.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one's rows written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
