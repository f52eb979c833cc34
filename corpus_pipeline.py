"""From documents to token files: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwright.llm.common import cut, read
from sparkwright.llm.decontaminate import decontaminated
from sparkwright.llm.jaccard import one_of_each
from sparkwright.llm.language_id import recognised
from sparkwright.llm.mixing import mixed
from sparkwright.llm.queries import tokenizer_path
from sparkwright.llm.token_planes import token_planes

#: A text of whose n-grams less than this share is known in the language that fits best is in none of them.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` less the texts that are in none of the languages that the documents' lang teaches; see ``recognised``.

    Null texts and those without letters go. Where no lang is given nothing is taught, and all rows stay.
    """
    return recognised(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies, that of the smallest doc_id (null last); see ``one_of_each``.

    Rows without words, null texts among them, are no copies of anything and stay.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` less those that hold a passage of ``benchmark``; an empty benchmark, and null texts there or here, take none."""
    return decontaminated(docs, read(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; a source without words (null is a source) gives none."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the token files, in their order."""
    return token_planes(docs, tokenizer_path()).drop("shard")


STAGES = [("language_id", language), ("jaccard_join", near_duplicates), ("decontamination", decontamination), ("mixing", mixture), ("token_planes", tokens)]
#: The last stage's rows come from a tokenizer, so no SQL gives them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``; columns of any name pass until there. No documents: no rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
