"""A training-corpus pipeline over ``documents``: language, quality, near duplicates, packing.

All stages take null ids, sources and texts, empty and very long texts, repeated rows, empty tables and further columns of any
name; all but the last return the columns that they were given.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import langid, packing, quality, shinglejoin
from weftline.llm.lineage import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language or with one that is too unsure.

    Null, empty and letterless texts go, and all texts if there is no label to learn from. Repeated rows each stay or go
    alike; null ids are judged like others; long texts are read whole, in pieces; of equal languages the first wins.
    """
    return langid.filter_documents(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose source is rejected.

    Null and empty texts fail; a null source is never rejected. Repeated rows each stay or go alike; sources with equal
    rates are judged alike; long texts are measured whole.
    """
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates the document with the smallest id: five-word shingles, similarity 0.8.

    Texts without words and rows with a null id link with nothing and stay. Of repeated ids in a class one row stays; long
    texts are compared whole.
    """
    return shinglejoin.keep_one_of_each(docs, n_words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; null and empty texts are an end id alone, repeated rows and null ids are packed too."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language), ("quality_rules", rules), ("ngram_jaccard_join", near_duplicates), ("packing", packed)]

#: The language stage is a trained model, which SQL cannot express; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's result is written in the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    raise ValueError("STAGES is empty")
