"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

quality rules -> n-gram Jaccard join -> substring dedup -> mixing to target
weights -> SentencePiece encoding.  Every stage works on all rows that the one
before kept; all but the last return the columns of documents, whatever further
columns there are.

Nulls may be in any column.  Null and empty texts have no words: the quality rules
reject them.  Repeated rows are judged alike, and the near-duplicate stage keeps one of
them.  Ties go by id, then by a hash of the row.  A stage of an empty table is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.llm import curriculum, merge_dropout, quality_rules, span_dedup, token_group_join
from thicket.scratch import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their language's perplexity band keep."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each group of near copies: five-word shingles, similarity of 0.8 or more."""
    return token_group_join.keep_one(docs, token_group_join.NEAR)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; those left without a word go."""
    return span_dedup.cleaned(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, a row for each copy taken, sorted by training position."""
    return curriculum.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids): token ids of every text, in the order of docs, cut with seeded merge-dropout; copies of a document, told apart by their place in docs, each in their own way."""
    return merge_dropout.encoded(merge_dropout.numbered(docs), keep=["doc_id", "source"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mix", mix), ("encode", encode)]

#: The stages as a whole are not expressible in SQL; the tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
