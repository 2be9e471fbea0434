"""The named queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import q_audit, q_citations, q_documents, q_evaluation, q_relational, q_scalars, q_segment, q_sets, q_sources, q_text

MODULES = (q_relational, q_sets, q_scalars, q_text, q_segment, q_citations, q_documents, q_audit, q_evaluation, q_sources)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.SQL.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The three best documents for each question by BM25."""
    return QUERIES["q46_bm25_topk"](spark, folder)
