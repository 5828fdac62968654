"""The library's operators bound to the driver's tables, and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tracewell.plans import document_queries, record_queries, report_queries, review_queries, score_queries, text_queries

    return text_queries.QUERIES | record_queries.QUERIES | document_queries.QUERIES | score_queries.QUERIES | review_queries.QUERIES | report_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    from tracewell.plans import oracle_documents, oracle_records, oracle_reports, oracle_reviews, oracle_scores, oracle_text

    return oracle_text.SQL | oracle_records.SQL | oracle_documents.SQL | oracle_scores.SQL | oracle_reviews.SQL | oracle_reports.SQL
