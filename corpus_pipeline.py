"""Pipeline over `documents`: each stage calls one operator of scriptorium.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import ngram_join, packing, pii, quality_classifier
from scriptorium.llm.common import Tables, owned, read, written
from scriptorium.llm.quality_rules import keep_good

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or are outliers among their language and source."""
    return keep_good(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely than not of the lowest grade."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of copies and near copies."""
    return ngram_join.keep_one(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts pseudonyms in place of personal data."""
    return pii.pseudonymize(docs, pii.stored_keys(spark))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", classifier),
    ("ngram_join", near_duplicates),
    ("pii", pseudonyms),
    ("packing", best_fit),
]

#: Regression and packing have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  Each stage's intermediate tables are dropped when its result is
    written, and each result when that of the next is; what the last one reads stays.  A stage that
    is called alone drops nothing, since its result may still be unread."""
    docs, before = read(spark, sf_dir, "documents"), Tables()
    for name, stage in STAGES[:-1]:
        with owned() as work:
            made = stage(spark, docs, sf_dir)
        with owned() as result:
            docs = written(made, name)
        work.drop(spark)
        before.drop(spark)
        before = result
    return STAGES[-1][1](spark, docs, sf_dir)
