"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, best-fit packing, each over all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result below the shared folder, reads it
again and deletes what the stage has written besides. All but the last return the columns of documents.

In every stage an empty table gives an empty one, very long texts are whole, and columns of other names, also those that an operator
uses inside, pass through. Null texts count as empty. What else holds is said with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metaloom.llm import exact_dedup, jaccard_join, packing, quality
from metaloom.llm.common import discard, stash, swept


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects; empty texts are scored like others, null ids too, repeated rows share a fate, and a score at the threshold stays."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops exact copies; the smallest doc_id stays, null ids count as largest, and of rows that share the id too one stays. Empty texts are copies of each other."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the document with the smallest doc_id stays.

    Empty texts and null ids have no copies and stay; rows of one id are one document and stay or go together.
    """
    return jaccard_join.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; an empty text is its end id alone, null ids and repeated rows are packed each."""
    return packing.pack(docs, packing.tokenizer_files())


STAGES = [("quality", keep_good), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]
#: A classifier's votes and a tokenizer can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        with swept(spark) as keep:
            before, docs = docs, stash(stage(spark, docs, sf_dir))
            keep.append(docs)
        discard(before)
    return docs
