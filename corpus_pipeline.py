"""The corpus pipeline: rules, classifier, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import packing, quality_model, rule_list, shingle_join
from recordloom.llm.common import materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned list, with their columns; null and empty texts go, repeated rows share a verdict."""
    return rule_list.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of 0.3 or more, with their columns; ties stay, and without labels one score holds for all."""
    return quality_model.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with its columns: that of the least doc_id, null last; texts without words stay."""
    return shingle_join.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every piece of every document that is left: its place in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier), ("near_duplicates", near_duplicates), ("best_fit_packing", best_fit_packing)]

#: Trained models and tokenizers can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
