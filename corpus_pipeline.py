"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage but the last returns the columns of ``documents``; a stage's decision
takes effect in what it passes on.

Defined results: null, empty and letterless texts are ``und`` and go in the first stage; rows
that share a doc_id, or have none, are judged by their own text in every stage but the near
duplicates, whose groups are named by doc_id: there a row without one stays, and an id goes only where none of
its rows is to stay. Repeated rows stay together, since they have one doc_id. Empty tables give no rows; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from churnforge.llm import decontaminate, lang_crf, minhash, packing, template_tree
from churnforge.llm.common import small_batches, stored, table
from churnforge.llm.tokens import word_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# A document whose main language has less than this share of its words is rejected.
LEAST_SHARE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: not ``und``, and more words in the main one than LEAST_SHARE."""
    small_batches(spark)
    scored = lang_crf.identify(docs, keep=COLUMNS)
    return scored.where((F.col("lang_pred") != lang_crf.UNKNOWN) & (F.col("score") >= LEAST_SHARE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines after their first place."""
    return template_tree.drop_recurring_lines(docs.select(*COLUMNS)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    small_batches(spark)
    # doc_ids of a group are compared, so a document is known by its id; a null id is never in a group
    stays = minhash.near_duplicates(docs, width=5, percent=80).groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = stays.where(~F.col("kept")).select("doc_id")
    return docs.select(*COLUMNS).join(stored(gone, "near-copies"), "doc_id", "left_anti").select(*COLUMNS)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    small_batches(spark)
    return packing.pack_documents(docs, word_bpe(), end_id=0, size=2048)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near duplicates", near_duplicates),
    ("decontamination", clean_of_tests),
    ("pack", pack),
]

# Stages learn models and pack; SQL cannot state them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}")
    return docs
