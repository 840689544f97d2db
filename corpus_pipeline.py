"""Training-text pipeline: each stage reads what the one before it kept.

Quality rules, near-duplicates, benchmark passages, secrets, token ids. A stage takes
(spark, docs, sf_dir) and returns a DataFrame; `run` writes it as Parquet into the shared
folder and rereads it as the next one's documents. All but the last return the columns of
`documents`: rejected documents and copies go, benchmark passages and secrets go from texts.

Null texts fail the quality rules; rows without an id are kept like any others; an empty
table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm.common import table, written
from meterline.llm.decontaminate import decontaminate
from meterline.llm.quality import keep_good
from meterline.llm.secrets import redact_secrets
from meterline.llm.sentencepiece import encode_text
from meterline.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_text(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_passages),
    ("secret_scan", secrets),
    ("sentencepiece", token_ids),
]

#: Learned references, XXH64 and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
