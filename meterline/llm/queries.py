"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterline.llm.bradley import op13_quality_classifier
from meterline.llm.common import table
from meterline.llm.decontaminate import op5_benchmark_decontamination
from meterline.llm.extract import op10_html_extraction
from meterline.llm.fim import op11_fill_in_middle
from meterline.llm.language import op4_language_id
from meterline.llm.licenses import op1_license_scan
from meterline.llm.lm import op9_lm_scoring
from meterline.llm.merkle import op12_merkle_manifest
from meterline.llm.oracle import ORACLE_SQL  # noqa: F401  (the driver contract reads it here)
from meterline.llm.quality import op3_quality_rules
from meterline.llm.secrets import op2_secret_scan
from meterline.llm.sentencepiece import op8_sentencepiece
from meterline.llm.simhash import op7_simhash_near_dedup
from meterline.llm.toxicity import op6_toxicity


def on_documents(operator: Callable[..., DataFrame], *others: str) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over the whole documents table, with these tables beside it."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[table(spark, sf_dir, t) for t in ("documents", *others)])

    return query


def on_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_html_extraction(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": on_documents(op1_license_scan),
    "op2_secret_scan": on_documents(op2_secret_scan),
    "op3_quality_rules": on_documents(op3_quality_rules),
    "op4_language_id": on_documents(op4_language_id),
    "op5_benchmark_decontamination": on_documents(op5_benchmark_decontamination, "benchmark"),
    "op6_toxicity": on_documents(op6_toxicity, "labels"),
    "op7_simhash_near_dedup": on_documents(op7_simhash_near_dedup),
    "op8_sentencepiece": on_documents(op8_sentencepiece),
    "op9_lm_scoring": on_documents(op9_lm_scoring),
    "op10_html_extraction": on_pages,
    "op11_fill_in_middle": on_documents(op11_fill_in_middle),
    "op12_merkle_manifest": on_documents(op12_merkle_manifest),
    "op13_quality_classifier": on_documents(op13_quality_classifier, "labels"),
    "pipeline": pipeline,
}
