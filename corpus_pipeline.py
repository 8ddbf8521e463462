"""A training-corpus pipeline over `documents`: each stage reads what the one before kept, as written Parquet.

1. toxicity: documents scored 0.5 or more go.
2. near_duplicates: of each group of copies and near copies the smallest doc_id stays.
3. decontamination: documents that hold a benchmark item go.
4. pii: personal data becomes pseudonyms.
5. mixing: sources, languages and topics are raked to their targets and documents drawn.

Nulls, empty texts, repeated rows, empty tables and extra columns are treated as the operators' docstrings say; all
columns of the input are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltql.llm import decontaminate, feistel_pii, ipf_mix, simhash_vptree, toxic_fst
from basaltql.llm.common import crc_mod, table, written
from basaltql.llm.queries import PII_KEY


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject; it is learned from all documents' labels but a fifth, as op7 learns."""
    model = toxic_fst.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxic_fst.civil(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_vptree.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return feistel_pii.pseudonymize(docs, feistel_pii.session_key(spark, PII_KEY), count=None)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The drawn documents and the probability of each."""
    mixed = ipf_mix.mixed(docs).where("sampled")
    return mixed.withColumn("probability", F.round("probability", 6)).drop("_source", "_lang", "_topic", "_tokens", "sampled")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: Edit distances, learned weights and fingerprints have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
