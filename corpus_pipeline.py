"""Corpus preparation: language, lines, near duplicates, benchmark passages, packing.

Each stage takes the documents that the one before it kept, and all but the
last return documents with the same columns. A stage's result is written as
Parquet and read again before the next, so a lost executor costs one stage at
most. ``n_chars`` follows the text where a stage changes it.

Null texts have no language and go in the first stage, as do texts without
letters; texts that lose all lines stay, empty. Extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cyclarium.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from cyclarium.llm._common import cut, drop_cut, scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model of those with a label."""
    return language_id.known_language(docs, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; exact copies count as one page, and one of them is kept later."""
    cleaned = line_dedup.clean(docs, copies_count=False, counts=())
    chars = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return ngram_join.one_of_each(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 ids."""
    return packing.result(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]
#: The stages aren't expressible in SQL; tests cover lines with near_duplicates, and what benchmark_passages calls against brute force, but not run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written is deleted once the next has read it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch():
            made = cut(stage(spark, docs, sf_dir), outside=True)
        drop_cut(docs)
        docs = made
    return docs
