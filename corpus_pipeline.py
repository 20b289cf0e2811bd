"""A training-data pipeline over `documents`: quality rules, language ID, near-dedup, secret scans, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents: the first two drop the documents they reject, the third keeps one document of each group of near-copies,
the fourth replaces secrets in the texts; the last returns the pieces of packed sequences.

Null texts and texts that fail the base rules go with the first stage; null lang and source are groups of their own.
Rows without doc_id stay, each by itself; of repeated rows, and of near-copies, one row of the least doc_id stays. Ties
are settled as each operator states. Other columns of documents, whatever their names, are carried up to the last
stage, which reads doc_id and text only. An empty table gives no row. Tables that a stage made are deleted as soon as
its result is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import language_mixture, near_dedup, packing, quality, secrets
from corpusloom.llm.common import Scratch, made, release
from corpusloom.llm.queries import table, vocabulary

#: SQL cannot express the stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_mixture.keep_identified(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_representatives(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_documents(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("secret_scans", secret_scans),
    ("sequence_packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`."""
    return run_on(spark, table(spark, sf_dir, "documents"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """All stages; each one's result is a table in the shared folder that the next one reads."""
    scratch = Scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES[:-1]:
        own = made()
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        release(spark, own)
        if before:
            scratch.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
