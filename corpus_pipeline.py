"""A training corpus from ``documents``: quality rules, toxicity, near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the columns
of ``documents``; the last returns the packed pieces. ``run`` writes each stage's result to the shared folder and
rereads it, so a lost executor never reaches back over a stage.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns of
any name: a null text counts as empty (the base rules drop it, later stages keep it, packing gives it the end id alone); a
null doc_id is linked with nothing and never dropped for another document's sake; repeated rows fare alike; an empty table
gives an empty result; other columns pass through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm.decontamination import decontaminate
from candlewick.llm.near_dup import keep_one_of_each_group
from candlewick.llm.packing import pack
from candlewick.llm.quality import clean_documents
from candlewick.llm.queries import table
from candlewick.llm.storage import materialize
from candlewick.llm.toxicity import drop_toxic, fit


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or line rules reject go; the others lose their host's over-frequent lines."""
    return clean_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones among them scores 0.5 or more go."""
    return drop_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: one row a piece."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Model scores, sketches and token ids are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
