"""A training corpus from raw documents, in five stages.

Each stage reads what its predecessor wrote, decides on its own input, and hands on the rows it keeps
with the columns of ``documents``; the last gives what the mix takes of each document in order of the
mix. ``ORACLE_SQL`` is None: the classifier can't be said in SQL, so tests compare the stages with
brute force.

Defined cases are those of the operators; an empty table passes every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symtrace.llm.common import Scratch, table
from symtrace.llm.decontaminate import clean_rows
from symtrace.llm.exact_dedup import kept_rows
from symtrace.llm.mixing import mix
from symtrace.llm.ngram_join import distinct_rows
from symtrace.llm.quality import good_rows


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return distinct_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", decontamination), ("mixing", mixing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = work.keep(docs, name)
            if i:
                work.drop(STAGES[i - 1][0])
    return docs
