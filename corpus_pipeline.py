"""The corpus pipeline: documents to packed token sequences, in stages that are each written and read again.

Every stage works on all rows its predecessor kept. All but the last return the columns of `documents`, with any others that
these have and whatever their names; the last returns the placed pieces (see helixframe.llm.packing).

Null and empty texts have no words: the rules drop them, and where a stage is used alone they are like any text. Repeated rows are
judged alike and are near duplicates of each other; of equal ids and texts one row stays. Ties go to the smaller id. An empty
table passes every stage empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import line_rules, near_dedup, packing, pii, quality
from helixframe.llm.common import read_table, stored
from helixframe.llm.queries import tokenizer_path


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier, learnt from the labels of `docs`, predicts to be of low quality."""
    return quality.keep_predicted(docs, read_table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lose too much text to the line rules, and removes failing lines from the others; n_chars follows the new text."""
    return line_rules.keep_good(docs, cleaned=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates."""
    return near_dedup.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts surrogates for personal data and secrets; n_chars follows the new text."""
    return pii.replace_entities(docs, lengths="n_chars")


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts and packs the documents into sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]

#: No SQL has the rows of the classifier, the genetic packing or the signatures; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
