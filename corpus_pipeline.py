"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns the rows that go on, all columns of
`documents`; the last returns the pieces of packed sequences. Each result is written as
Parquet and read again as the next stage's docs. Empty tables and further columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.jaccard import one_of_each
from gridloom.llm.linededup import deduplicated
from gridloom.llm.mixing import mixed
from gridloom.llm.packing import pack
from gridloom.llm.shared import release, written
from gridloom.llm.toxicity import learn, training_rows, without_toxic

#: Passes over the smallest source for one over the largest, at most.
MOST_REPEATS = 2.0


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the lexicon rejects go; it is learned from the labelled ones among them.

    Null and empty texts have the base score and stay; without labels of both kinds nothing goes; repeated rows are judged one by one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, learn(*training_rows(docs, labels)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or near to an earlier one go, and documents that had no other.

    Null, empty and blank texts stay as they are; rows with the same id and text keep the same lines.
    """
    return deduplicated(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Texts without a word are in no group and stay; of rows with one id and text one stays.
    """
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to MOST_REPEATS times.

    A null source is one of its own; documents without a word come with every pass; rows with one id come equally often.
    """
    return mixed(docs, max_repeats=MOST_REPEATS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens.

    A null or blank text is its end id alone; repeated rows are packed one by one; longer texts are cut.
    """
    return pack(docs, keep_words=False)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: The toxicity stage learns its lexicon, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
