"""Corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; its
result is written and read again before the next.  All but the last return the columns of
`documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eligspark.llm.decontaminate import without_contaminated
from eligspark.llm.jaccard import one_of_each_component
from eligspark.llm.mixing import mixed_documents
from eligspark.llm.quality import keep_good, labelled_statistics, learn_rules
from eligspark.llm.sharding import shard_documents
from eligspark.storage import materialize
from eligspark.tables import table


#: Shares of all tokens after mixing.  Low-quality and most toxic text is meant to leave, so that clean documents,
#: whose share is below its target, are never read less than once.
TARGETS = {"toxic": 0.03, "low": 0.0, "clean": 0.97}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the learned decision list rejects.

    Null, empty and short texts fail the base rule; rows without an id are judged as others; repeated rows have one
    verdict each; very long texts are judged whole; an empty table gives no rows; further columns, whatever their names, stay.
    """
    return keep_good(docs, learn_rules(labelled_statistics(docs, table(spark, sf_dir, "labels"))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 over five-word shingles connect: that of the smallest id.

    Texts without words link with nothing and stay; rows without an id stay, though they connect others; of rows that
    share a kept id one stays; very long texts are compared whole; an empty table gives no rows; further columns stay.
    """
    return one_of_each_component(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts and rows without an id stay unless they are hit; repeated rows go or stay together; very long
    texts are searched whole; an empty table gives no rows, an empty benchmark all; further columns stay.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates of their soft domains say.

    Null and empty texts have no tokens but a rate; rows without an id and repeated rows have one rate each; ties can't
    arise; without labels every rate is 1; an empty table gives no rows; further columns stay.
    """
    return mixed_documents(docs, table(spark, sf_dir, "labels"), TARGETS)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row: equal texts (null as empty) together, repeated rows with slots of their own,
    ties in slot order by text and size; null ids are kept; an empty table gives no rows; other columns are not read."""
    return shard_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Learned rules, hash order and fitted rates have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
