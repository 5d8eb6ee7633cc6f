"""Summaries, eligibility and report rows.

Counts are partial aggregates, so a tender or bidder that holds a large share of
all rows costs one small partial row per task.  Nested lists of a report are given
in long form, one row per entry: one tender may be too large for a single row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluate import unwrap_value

PENDING = ["pending_review", "pending_second_officer"]


def _n(cond: Column) -> Column:
    return F.count_if(cond)


def tender_summary(evaluations: DataFrame) -> DataFrame:
    status = F.col("status")
    return evaluations.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("total"),
        _n(status == "auto_committed").alias("auto_committed"),
        _n(status.isin(*PENDING)).alias("pending"),
        _n(status == "resolved").alias("completed"),
    )


def bidder_breakdown(bidders: DataFrame, evaluations: DataFrame) -> DataFrame:
    """PASS/FAIL/REVIEW per bidder, zero for bidders without evaluations."""
    v = F.col("verdict")
    counts = evaluations.groupBy("bidder_id").agg(
        _n(v == "PASS").alias("pass_count"), _n(v == "FAIL").alias("fail_count"), _n(v == "REVIEW").alias("review_count")
    )
    joined = bidders.select("tender_id", "bidder_id", "company_name").join(counts, "bidder_id", "left")
    return joined.na.fill(0, ["pass_count", "fail_count", "review_count"])


def bidder_eligibility(bidders: DataFrame, evaluations: DataFrame, criteria: DataFrame) -> DataFrame:
    """Eligibility of every bidder from its evaluations.

    A mandatory FAIL that was not overridden excludes; an open case or a REVIEW
    verdict keeps the bidder under review.
    """
    v, status = F.col("verdict"), F.col("status")
    mandatory = F.coalesce(F.col("is_mandatory"), F.lit(False))
    overridden = F.coalesce(F.col("officer_decision") == "override", F.lit(False))
    facts = (
        evaluations.select("bidder_id", "criterion_id", "verdict", "status", "officer_decision")
        .join(criteria.select("criterion_id", "is_mandatory"), "criterion_id", "left")
        .groupBy("bidder_id")
        .agg(
            F.count(F.lit(1)).alias("total_criteria"),
            _n(v == "PASS").alias("pass_count"),
            _n(v == "FAIL").alias("fail_count"),
            _n(v == "REVIEW").alias("review_count"),
            _n(status == "auto_committed").alias("auto_committed"),
            _n(status == "resolved").alias("officer_reviewed"),
            _n(status.isin(*PENDING)).alias("pending_count"),
            _n(mandatory & (v == "FAIL") & ~overridden).alias("mandatory_fails"),
        )
    )
    counts = [c for c in facts.columns if c != "bidder_id"]
    out = bidders.select("tender_id", "bidder_id", "company_name", "debarment_status").join(facts, "bidder_id", "left")
    return (
        out.na.fill(0, counts)
        .withColumn(
            "eligibility",
            F.when(F.col("mandatory_fails") > 0, "Not Eligible")
            .when((F.col("review_count") > 0) | (F.col("pending_count") > 0), "Under Review")
            .otherwise("Eligible"),
        )
        .drop("pending_count", "mandatory_fails")
    )


def report_header(tenders: DataFrame, bidders: DataFrame, criteria: DataFrame, evaluations: DataFrame, chain: DataFrame, digests: DataFrame) -> DataFrame:
    """One header row per tender: totals, ledger digest and chain state."""
    status = F.col("status")
    evals = evaluations.groupBy("tender_id").agg(
        F.count(F.lit(1)).alias("total_evaluations"),
        _n(status == "auto_committed").alias("auto_committed"),
        _n(status == "resolved").alias("officer_reviewed"),
        _n(status.isin(*PENDING)).alias("pending"),
    )
    out = tenders.select("tender_id", "title", "department", "category", "status")
    for counted, name in ((bidders, "total_bidders"), (criteria, "total_criteria")):
        out = out.join(counted.groupBy("tender_id").agg(F.count(F.lit(1)).alias(name)), "tender_id", "left")
    out = out.join(evals, "tender_id", "left").join(chain.select("tender_id", "chain_valid"), "tender_id", "left")
    out = out.join(digests.select("tender_id", F.col("n").alias("audit_trail_entries"), F.col("digest").alias("sha256_hash")), "tender_id", "left")
    counts = ["total_bidders", "total_criteria", "total_evaluations", "auto_committed", "officer_reviewed", "pending", "audit_trail_entries"]
    return out.na.fill(0, counts).na.fill(True, ["chain_valid"])


def report_rows(evaluations: DataFrame, bidders: DataFrame, criteria: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The case lines of all reports, one row per evaluation."""
    names = criteria.select("criterion_id", "criterion_text", "criterion_type", "is_mandatory")
    out = evaluations.join(bidders.select("bidder_id", "company_name"), "bidder_id").join(names, "criterion_id", "left")
    out = out.withColumn("criterion_text", F.coalesce("criterion_text", F.lit("Unknown")))
    out = out.withColumn("criterion_type", F.coalesce("criterion_type", F.lit("Unknown")))
    out = out.withColumn("is_mandatory", F.coalesce("is_mandatory", F.lit(False)))
    if documents is not None:
        files = documents.select(F.col("document_id").alias("source_document_id"), F.col("filename").alias("source_filename"))
        out = out.join(files, "source_document_id", "left")
    if "extracted_value" in evaluations.columns:
        value, explanation = unwrap_value(F.col("extracted_value"))
        out = out.withColumn("explanation", explanation).withColumn("extracted_value", value)
    return out


def officer_reason(stored: Column) -> tuple[Column, Column]:
    """(reason, text) from a stored JSON reason; other text is the reason itself."""
    parsed = F.from_json(stored, "reason string, text string")
    is_json = F.try_parse_json(stored).isNotNull()
    return F.when(is_json, parsed["reason"]).otherwise(stored), F.when(is_json, parsed["text"])


def event_histogram(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("tender_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


def page_word_counts(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Words per page, zero for pages without words."""
    counts = words.groupBy("page_id").agg(F.count(F.lit(1)).alias("word_count"))
    out = pages.select("document_id", "page_id", "page_number", "ocr_confidence").join(counts, "page_id", "left")
    return out.na.fill(0, ["word_count"])


def branch_counts(criteria: DataFrame) -> DataFrame:
    """Criteria per document found by the rules, by the model, by both."""
    rules, model = F.array_contains("sources", "rules"), F.array_contains("sources", "llm")
    return criteria.groupBy("document_id").agg(
        _n(rules & ~model).alias("rules_only"), _n(model & ~rules).alias("llm_only"), _n(rules & model).alias("both")
    )
