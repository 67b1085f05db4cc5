"""From raw documents to a training mix: quality, near duplicates, contamination, personal data, mixing.

Every stage works on all rows and whole texts that the one before it has left.  In all stages a null text counts as
empty, extra columns are carried unchanged, and an empty table stays empty with its columns.  Columns whose names begin
with two underscores are the stages' own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import scratch, stored, table
from millrace.llm.decontaminate import uncontaminated
from millrace.llm.mixing import mixed
from millrace.llm.pii import masked
from millrace.llm.quality import passed
from millrace.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that a quality rule rejects; null and empty texts go, repeated rows are judged alike."""
    return passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least doc_id, then text hash; a null doc_id only alone.

    Rows that repeat doc_id and text are one document; all empty texts are one group.
    """
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of the benchmark; empty texts and an empty benchmark drop none."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data and secrets in the texts, [KIND] for each span; null texts stay null, rows and ids stay."""
    return masked(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents to the sources' target weights, in training order, a row for each copy; a null source is one more.

    Adds size, taken and position, which replace columns of those names; documents without words are not taken.
    """
    return mixed(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("mixing", mixing),
]

#: SimHash components and induced patterns have no SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage stores on its way is deleted when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as used:
            docs = stored(stage(spark, docs, sf_dir), name)
            used.pop()  # the stage's own result stays
    return STAGES[-1][1](spark, docs, sf_dir)
