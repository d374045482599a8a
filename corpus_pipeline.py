"""The corpus pipeline: quality rules, exact and near deduplication, mixing and packing, each stage on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet to the cluster's shared folder
and reads it again as the next stage's ``docs``, so a lost executor costs the stage's missing parts at most.

All but the last return the columns of ``docs`` as they came, whatever their names and however many. Every stage takes null
values in any column, repeated rows, texts of any length and empty tables; what it makes of them is said with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tileforge.llm import exact, mixing, ngram_join, packing, quality
from tileforge.llm.common import shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or empty text has no words and goes, as every text of less than 50 words does; rows alike are judged alike, so
    repeated rows stay or go together. A null language is a stratum of its own.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space stays.

    The one with the most characters, then the smallest doc_id (null last), then any of rows alike. Null and empty texts are
    one group.
    """
    return exact.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of word shingles connect stays: five words, a similarity of 0.8 or more.

    The one with the smallest doc_id. Texts without words are linked with nothing and stay; those of less than five words are
    one shingle. Documents with equal sets are one group.
    """
    return ngram_join.keep_one(docs, size=5, percent=80)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as the mix takes them: not at all, or up to three times.

    A null source is a source of its own, the last in order. A document without words takes nothing of the budget; a source
    without words has a target of 0 and its documents go.
    """
    return mixing.mixed_rows(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids; a document that comes n times is packed n times.

    A null or empty text is the one id that ends a document. Texts of any length are cut into pieces of 2048 ids.
    """
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: SQL has no tokenizer and no exact form of the near-duplicate stage that ends in time; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
