"""A corpus pipeline: documents without toxic ones, of a determined language, without repeated lines or near copies, packed.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, linedup, packing, simhash, toxicity
from lodestone.llm.common import shared_folder, table
from lodestone.llm.queries import PACKED, PATTERN, PIECES
from lodestone.session import removed


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more by the toxicity models go."""
    return toxicity.ordinary_only(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language has a posterior below one half, go."""
    return langid.determined_only(docs, PIECES)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go from the texts; all documents stay."""
    return linedup.with_fresh_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, the one with the smallest doc_id."""
    return simhash.one_of_each(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.op7(docs, PACKED, PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("language", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("packing", packing_stage),
]

#: SQL can't express the models, the chunks or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir; the stages' tables are written below the shared checkpoint folder,
    and each is removed when the next is complete."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    before = None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return docs
