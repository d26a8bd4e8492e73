"""The corpus pipeline: quality rules, toxicity, near duplicates, packing.

Every stage takes any rows with the columns of documents. A null text is empty: the quality
rules reject it, the later stages keep it. Rows without a key, or that repeat one, are
judged row by row; in the near-duplicate stage rows with one key are one document. An empty
table gives no rows. Columns beside doc_id and text pass through unread, whatever their
names, up to the last stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from meshloom.llm.common import small_batches, table, written
from meshloom.llm.jaccard import one_of_each
from meshloom.llm.packing import packed
from meshloom.llm.quality import apply_policy
from meshloom.llm.toxicity import drop_toxic


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the default policy."""
    small_batches(spark)
    return apply_policy(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the model learns from the labels of documents that got here."""
    small_batches(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that links of similarity 0.75 join."""
    small_batches(spark)
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every run of every document that is left."""
    small_batches(spark)
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("best-fit packing", packing),
]
#: None: SQL can't express a trained score or a tokenizer's ids.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
