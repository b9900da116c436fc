"""Corpus preparation in stages; each stage's rows are written and read again.

Toxic documents go, repeated chunks of lines go, one document of each group of near
duplicates stays, sources are mixed to their target weights, and what is left is
packed into bins.  Every stage works on all that the one before has kept.

All stages but the last keep the columns that they are given, whatever their names; a
document is never split over rows before the mixture, which may use one more than once.
Every stage takes an empty table and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ensemblage.llm import line_dedup, mixing, ngram_join, packing, toxicity
from ensemblage.llm.common import materialize


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.3, learned from ``labels``.  Null and empty texts
    have no evidence and stay; repeated rows are each judged by their text, of any
    length; without labels everything stays."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, texts without chunks of lines that an earlier document has.  Null
    texts stay null; a text that loses all its lines is empty and stays; of equal ids
    none is earlier, and rows of one id and text are one document."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at 0.8 make: the
    smallest id (null last), then by a hash of the text.  Texts without words (null,
    empty) are in no group and all stay; of repeated rows of one id and text one stays."""
    return ngram_join.keep_one(docs, ngram_join.Join(n=5, num=80, den=100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each whole use of a document and for the prefix that ends its leaf's
    budget.  Null language or source is a name of its own; texts without words have no
    tokens and come once for each whole epoch of their leaf; ties in rank go by id."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins of 2048 words, no two of a source or of equal
    folded texts in one bin.  Texts without words are pieces of length 0; long ones give
    several pieces; null sources are one source; repeated rows are packed apart."""
    return packing.best_fit(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", dedup_lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: A learned score decides the first stage: SQL can't express these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus: what the last stage makes of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
