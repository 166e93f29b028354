"""A corpus pipeline of the operators in tidemark.llm.

Documents in an unknown language go, repeated lines go, of near-duplicates one
stays, sources are mixed to their target weights, and texts become tokens.

Nulls: a null or letterless text has no language, so its document goes in the first
stage; null doc_ids, langs and sources are kept (a document without a doc_id loses no
lines and is nobody's copy). Empty texts that the second stage leaves are
near-duplicates of each other. Very long texts are one row's work in each stage. Of
repeated rows one stays. An empty table gives an empty one. Other columns, whatever
their names, are carried to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, language, line_dedup, mixing, pieces, queries, simhash


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that are rejected go."""
    return language.keep_identified(docs, language.fit(docs))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that nearly repeat an earlier one."""
    return line_dedup.dedup_lines(docs, counted=False)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose fingerprints link, the one with the smallest doc_id."""
    return simhash.keep_one(docs)


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, and whether decoding gives the text again."""
    found = pieces.encode_documents(docs, queries.tokenizer_path(), keep=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "same")


STAGES = [
    ("language", known_language),
    ("lines", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("mixing", in_proportion),
    ("tokens", as_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = common.written(docs, name)
    return docs


#: Language models and tokens have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None
