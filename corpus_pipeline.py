"""A corpus pipeline: each stage takes documents and returns them, the last returns ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseledger.llm.common import saved, table
from caseledger.llm.exact_dedup import drop_copies
from caseledger.llm.jaccard_join import drop_near_copies
from caseledger.llm.mixing import repeat_mixed
from caseledger.llm.sentencepieces import encode, load_pieces
from caseledger.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest doc_id."""
    return drop_copies(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies (five-word shingles, Jaccard
    similarity of 0.8 or more), that with the smallest doc_id."""
    return drop_near_copies(docs, width=5, num=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: sources weigh 1, 2, 3, repeating."""
    return repeat_mixed(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the ids of each row's text."""
    import public_tokenizers

    return encode(docs, load_pieces(spark, public_tokenizers.path("piece_bpe_32k.model")), keep=("doc_id", "source"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Learned scores, sampling and ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
