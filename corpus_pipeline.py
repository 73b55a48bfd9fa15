"""A training corpus from raw documents: quality, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written
as Parquet and reread as the next one's docs. All but the last return the
columns of documents.

No stage fails on nulls in any column, empty or very long texts, repeated rows
or ids, an empty table, or columns besides those of documents: these keep their
names and values up to the last stage, which gives pieces alone. An empty table
gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import packing, pii, quality, simhash
from quillmesh.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the line field, trained on the labelled ones, doesn't reject.

    A null or empty text is scored as one empty line; rows without an id or that
    repeat one are judged by their text like any other.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Null and empty texts are one group. Rows without an id all stay; of rows
    that repeat an id and a text one stays, with other texts each is judged by
    itself.
    """
    return simhash.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked; null text stays null, repeated rows stay."""
    return pii.mask_text(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document, packed into sequences of 2048 tokens; a null or empty text is one piece, a repeated row has pieces of its own."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]

#: SQL can't train or apply the field, nor run the tokenizer: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
