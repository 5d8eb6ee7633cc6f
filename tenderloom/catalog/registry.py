"""Registered queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.adapters import with_views

# Columns whose SQL type would differ from Spark's: exact decimals and wide sums.
_DOUBLES = {
    "H11_error_evaluations": ["confidence"], "C17_extraction_confidence": ["confidence"], "D9_parse_amendment": ["agreement_similarity"],
    "F1_extract_numeric": ["confidence"], "F1_numeric_of_pages": ["confidence"], "F3_search_table_rows": ["confidence"],
    "F5_scoped_numeric": ["confidence"], "F8_validity_date": ["confidence"], "F11_projects_from_tables": ["confidence"],
    "F12_projects_from_prose": ["confidence"], "E5_E6_E7_confidences": ["rules_confidence", "model_confidence"], "E8_E9_verdict_consensus": ["score"],
}
_COUNTS = {
    "L1_tender_summary": ["auto_committed", "pending", "completed"],
    "L3_bidder_eligibility": ["pass_count", "fail_count", "review_count", "auto_committed", "officer_reviewed"],
    "L4_report_headers": ["auto_committed", "officer_reviewed", "pending"], "K4_status_after_evaluation": ["pending"],
    "E3_L8_branch_counts": ["rules_only", "llm_only", "both"], "N6_reproduce": ["matches"],
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, views: str = "", sql: str | None = None):
    """Register a query; ``sql`` may use the named views."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = _typed(name, with_views(views, sql))
        return fn

    return register


def _typed(name: str, sql: str) -> str:
    casts = [f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in _DOUBLES.get(name, [])] + [f'CAST("{c}" AS BIGINT) AS "{c}"' for c in _COUNTS.get(name, [])]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM (\n{sql}\n) AS typed" if casts else sql
