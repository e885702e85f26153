"""A corpus pipeline: rules, toxicity, near duplicates, benchmark items, source weights.

Every stage works on all documents its predecessor kept and returns the columns of documents, extra ones
included; the last returns the documents that the mix takes, with the words taken of each.

In every stage an empty table gives an empty one, and texts of any length are read whole.  Null and empty texts
fall to the rules' least number of words; where they reach a later stage they are not toxic, equal nothing,
contain nothing, and are not taken.  Null languages, sources and lengths change nothing but the mix, where null
is a source of its own.  Near duplicates and benchmark items go by id: rows that share an id stay or go together
there, and a row with a null id is a document of its own, after all others (ids are taken to be below 2^62).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontaminate, mixing, near_dup, quality_rules, toxicity
from factloom.llm.common import keyed, stored, table, without_ids

SHINGLE, SIMILARITY = 5, (80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a share that equals its limit passes."""
    return quality_rules.passing(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learnt from the labels of the documents at hand.  With no labels all stay."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; rows repeated under that id all stay."""
    rows, key = keyed(docs)
    found = near_dup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, *SIMILARITY)
    return without_ids(rows, stored(found.where("not kept").select("doc_id")), key).drop(key)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item; with no items all stay."""
    rows, key = keyed(docs)
    found = decontaminate.contained_items(rows.select(F.col(key).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without_ids(rows, stored(found.select("doc_id").distinct()), key).drop(key)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; documents of which it takes nothing go."""
    return mixing.mix(docs).where("taken > 0")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = stored(docs)
    return docs
