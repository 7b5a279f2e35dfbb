"""A corpus pipeline: quality rules, near duplicates, secrets, source mix, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of documents.
Stages take rows as they come: null and empty texts, repeated rows, null ids and columns of any other name. An empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import jaccard_join, mixing, packing, quality_rules, secret_scan
from tidewater.llm.common import discard, temporary, written
from tidewater.llm.queries import _read, _vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules reject go; cut-offs come from the labels of the rows that are here. Null and empty texts go, as they have no words."""
    return quality_rules.passing(docs, _read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts stays, that of least id, null last, then of least hash; texts without words are in no group and stay."""
    return jaccard_join.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kinds; null texts stay null, repeated rows stay equal."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row is taken as often as the mix takes it: never, once or twice. Repeated rows count each; a null source is one of its own."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the taken texts with their sequences and places; a null or empty text is its end id alone."""
    return packing.pack_documents(docs, _vocabulary("word_bpe_49k.json"), 1).drop("th").withColumnRenamed("did", "doc_id")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("pack", pack)]
#: The rules' cut-offs, hashes and tokens are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; a stage's own tables go once its result is written, and that goes once the next one is."""
    docs, before = _read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary() as keep:
            docs = keep(written(stage(spark, docs, sf_dir), name))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
