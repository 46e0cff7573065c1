"""The corpus pipeline: language, copies, near copies, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
``documents``, whatever further columns the table has, with nulls as they are; the last
returns the packed pieces. An empty table goes through every stage and gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.common import stored
from gridloom.llm.exact_dedup import kept_rows
from gridloom.llm.langid import accepted_rows
from gridloom.llm.mixing import mixed_rows
from gridloom.llm.ngram_join import distinct_rows
from gridloom.llm.packing import pack_documents


#: Languages that stay; None: every language that the documents' labels teach.
WANTED: tuple[str, ...] | None = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is learned, wanted and accepted.

    Null and empty texts and those without a letter go; texts of any length are scored
    whole; repeated rows stay or go together; null ids, sources and labels do not matter.
    """
    return accepted_rows(docs, wanted=WANTED)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id.

    Null and empty texts are copies of each other; a null id stays only where its text
    has no other; of rows that repeat id and text one stays; long texts are compared whole.
    """
    return kept_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents, the one with the smallest doc_id, a null id last.

    Texts without words are linked with nothing and stay; of rows that repeat id and text
    one stays; long texts are compared whole.
    """
    return distinct_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at its target, documents repeated or left out as the mix takes them.

    Texts without words are never taken; a null source is a source; the document at a
    source's cut ends with the words up to the budget and its n_chars follows.
    """
    return mixed_rows(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of at most 2048 tokens.

    Null and empty texts are one end token; longer texts are cut into pieces; repeated
    rows and null ids are packed each.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("pack", pack)]

#: Language identification and tokenisation are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
