"""A corpus pipeline from operators of reelspark.llm: each stage takes the rows that its predecessor left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import decontamination, ngram_join, packing, quality_classifier, suffix_dedup
from reelspark.llm.common import stored, table

#: Bytes of a repeat: under what passages of over 50 words of prose have.
REPEAT = 250


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``REPEAT`` bytes that start in two places go from the texts; documents stay, with what is left of their
    text. Null texts become empty, repeated rows lose what they share with each other."""
    kept = suffix_dedup.suffix_dedup(docs, length=REPEAT, carry=True)
    own = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows go or stay together."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens; a null text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark_free),
    ("packing", packed),
]
#: Suffix arrays, LSH and a tokenizer are not SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each leaves is stored as Parquet in the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
