"""The cleaning pipeline over ``documents``: each stage applies one operator of ``stratascene.llm`` to what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stratascene.llm.bpe import token_digests
from stratascene.llm.common import read_table, stage_table
from stratascene.llm.exact_dedup import drop_copies
from stratascene.llm.minhash import drop_near_duplicates
from stratascene.llm.mixing import mixed_documents
from stratascene.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go, by a model of the labelled rows that aren't held out.

    Null and empty texts score as texts without any passage; without labels of both kinds all score the same. Null identifiers have no label, repeated rows stay or go
    together, other columns are kept, and an empty table stays empty.
    """
    return drop_toxic(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row with the largest doc_id stays, and one of several rows that are equal in both.

    Null counts as empty; a null doc_id is the smallest. Other columns are kept, and an empty table stays empty.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more), the text with the smallest doc_id stays.

    Null and empty texts and rows without a doc_id stay; several texts of one doc_id are judged each; equal rows stay or go together. Other columns are kept, and
    an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, whole.

    A null source is a source of its own, the last. Null and empty texts have no words and aren't taken. Repeated rows of one doc_id are each taken as often as the
    most taken of them; ties are ordered by size. Other columns are kept, and an empty table stays empty.
    """
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every row, as a count and digests, and the digest of the decoded text.

    A null text is empty and has no ids; a null doc_id stays null; repeated rows have a row each; an empty table stays empty.
    """
    return token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix), ("byte_bpe", tokens)]
#: Neither the scores of the first stage nor the ids of the last can be stated in SQL; the tests hold all rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage_table(docs, name)
    return docs
