"""Amendments and the effective specification: history, diff, version, approval, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.common import json_bool, json_number, json_object, json_string
from .digests import ordered_digest


#: Parts of a threshold; an amendment replaces all of them.
PARTS = ["rupees", "document", "count", "period"]


def _threshold(rows: DataFrame, prefix: str) -> Column:
    """The parts of a threshold as one value; parts that the rows have no column for are null."""
    kinds = {"rupees": "bigint", "document": "string", "count": "bigint", "period": "string"}
    return F.struct(*[(F.col(f"{prefix}_{p}") if f"{prefix}_{p}" in rows.columns else F.lit(None)).cast(kinds[p]).alias(p) for p in PARTS])


def _opened(column: str, name: str) -> list[Column]:
    """The parts of a threshold as columns; the amount has the plain name."""
    return [F.col(f"{column}.{p}").alias(name if p == "rupees" else f"{name.removesuffix('_value')}_{p}") for p in PARTS]


def _amended(criteria: DataFrame, amendments: DataFrame) -> DataFrame:
    """Criteria with the amendments of their clause, their order and the thresholds before and after.

    An amendment applies to the criteria of its clause that have its type, or to all of the clause where none has
    it. It replaces the whole threshold, whatever the type; one without a threshold leaves the one before.
    """
    base = criteria.select("criterion_id", "tender_id", F.col("source_clause_ref").alias("clause_ref"), F.col("criterion_type").alias("_own"), _threshold(criteria, "threshold").alias("_first"))
    # At most one entry for each type.
    kinds = base.groupBy("tender_id", "clause_ref").agg(F.collect_set("_own").alias("_kinds"))
    given = _threshold(amendments, "amended")
    stated = F.coalesce(*[given[p].cast("string") for p in PARTS]).isNotNull()
    changes = amendments.select("tender_id", "clause_ref", "criterion_type", "corrigendum_id", "uploaded_at", "ord", "reason", F.when(stated, given).alias("_given"))
    changes = changes.join(kinds, ["tender_id", "clause_ref"])
    fits = F.col("_own").eqNullSafe(F.col("criterion_type")) | ~F.coalesce(F.array_contains("_kinds", F.col("criterion_type")), F.lit(False))
    rows = base.join(changes, ["tender_id", "clause_ref"]).where(fits)
    order = W.partitionBy("criterion_id").orderBy("uploaded_at", "ord")
    before = F.last("_given", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("seq", F.row_number().over(order)).withColumn("_before", F.coalesce(before, F.col("_first")))
    return rows.withColumn("_after", F.coalesce("_given", "_before"))


def amendment_history(criteria: DataFrame, amendments: DataFrame) -> DataFrame:
    """One row per applied amendment: the threshold before, the threshold after, where and why."""
    return _amended(criteria, amendments).select(
        "tender_id", "criterion_id", "seq", *_opened("_before", "original_value"), *_opened("_after", "amended_value"),
        F.concat(F.lit("Corrigendum doc "), F.col("corrigendum_id")).alias("corrigendum_ref"),
        F.coalesce("reason", F.lit("Corrigendum amendment")).alias("amendment_reason"),
    )


def criterion_diff(criteria: DataFrame, history: DataFrame) -> DataFrame:
    """First and last threshold of every criterion."""
    packed = lambda name: F.struct(*[F.col(name if p == "rupees" else f"{name.removesuffix('_value')}_{p}").alias(p) for p in PARTS])
    ends = history.groupBy("criterion_id").agg(
        F.min_by(packed("original_value"), "seq").alias("_original"),
        F.max_by(packed("amended_value"), "seq").alias("_amended"),
        F.max_by("corrigendum_ref", "seq").alias("corrigendum_ref"),
        F.count(F.lit(1)).alias("amendments"),
    )
    out = criteria.select("criterion_id", "tender_id", _threshold(criteria, "threshold").alias("_first")).join(ends, "criterion_id", "left").na.fill(0, ["amendments"])
    out = out.withColumn("_original", F.coalesce("_original", "_first"))
    return out.select(
        "criterion_id", "tender_id", *_opened("_original", "original"), *_opened("_amended", "amended"), "corrigendum_ref", "amendments", (F.col("amendments") > 0).alias("has_amendments")
    )


def apply_corrigenda(criteria: DataFrame, amendments: DataFrame) -> DataFrame:
    """Criteria with the threshold of their last amendment."""
    ends = _amended(criteria, amendments).groupBy("criterion_id").agg(F.max_by("_after", "seq").alias("_last"), F.count(F.lit(1)).alias("amendments"))
    rows = criteria.join(ends, "criterion_id", "left").na.fill(0, ["amendments"])
    for p in PARTS:
        if f"threshold_{p}" in criteria.columns:
            value = F.when(F.col("amendments") > 0, F.col(f"_last.{p}")).otherwise(F.col(f"threshold_{p}"))
            rows = rows.withColumn(f"threshold_{p}", value.cast(criteria.schema[f"threshold_{p}"].dataType))
    return rows.drop("_last")


def validate_amendment_targets(amendments: DataFrame, criteria: DataFrame) -> DataFrame:
    """Amendments with a flag whether the clause exists in their tender."""
    refs = criteria.select("tender_id", F.col("source_clause_ref").alias("clause_ref")).distinct().withColumn("_found", F.lit(True))
    return amendments.join(refs, ["tender_id", "clause_ref"], "left").withColumn(
        "clause_exists", F.coalesce("_found", F.lit(False))
    ).drop("_found")


def amendment_consensus(checked: DataFrame) -> DataFrame:
    """Agreement and confidence per corrigendum; unknown clauses lower both."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("clause_exists"))
    score = F.lit(1.0) - bad / n
    return checked.groupBy("corrigendum_id").agg(
        n.alias("n"), bad.alias("bad"), score.alias("agreement_score"), (F.avg("confidence") * score).alias("consensus"),
        F.when(bad == 0, "agree").otherwise("disagree").alias("agreement"),
    )


def criterion_json() -> Column:
    """Canonical JSON of one criterion."""
    s = lambda c: json_string(F.col(c))
    n = lambda c: json_number(F.col(c))
    return json_object(
        {
            "id": n("criterion_id"), "tender_id": n("tender_id"), "criterion_text": s("criterion_text"), "criterion_type": s("criterion_type"),
            "threshold_rupees": n("threshold_rupees"), "gfr_override_permitted": json_bool(F.col("gfr_override_permitted")),
            "gfr_rule_number": s("gfr_rule_number"), "source_clause_ref": s("source_clause_ref"),
            "is_mandatory": json_bool(F.col("is_mandatory")), "status": s("status"),
        }
    )


def ets_version(criteria: DataFrame) -> DataFrame:
    """Version hash of the specification of every tender; equal inputs give equal hashes."""
    rows = criteria.select("tender_id", "source_clause_ref", "criterion_id", criterion_json().alias("line"))
    return ordered_digest(rows, "tender_id", ["source_clause_ref", "criterion_id"], "line", "[", ",", "]").select(
        "tender_id", F.col("n").alias("criteria_count"), F.col("digest").alias("version_hash")
    )


def approve_schema(approvals: DataFrame, tenders: DataFrame, criteria: DataFrame) -> DataFrame:
    """Approvals with their code; accepted ones carry the new tender state."""
    counts = criteria.groupBy("tender_id").agg(F.count(F.lit(1)).alias("criteria_count"))
    rows = approvals.join(tenders.select("tender_id", "status"), "tender_id", "left").join(counts, "tender_id", "left")
    rows = rows.na.fill(0, ["criteria_count"])
    code = (
        F.when(F.col("status").isNull(), "TENDER_NOT_FOUND")
        .when(F.col("status") != "SCHEMA_PENDING_REVIEW", "SCHEMA_NOT_APPROVED")
        .when(F.col("criteria_count") == 0, "NO_CRITERIA")
    )
    return rows.withColumn("code", code).withColumn("new_status", F.when(F.col("code").isNull(), "SCHEMA_APPROVED"))


def approved_criteria(criteria: DataFrame, accepted: DataFrame) -> DataFrame:
    """Criteria of the approved tenders with approver and time."""
    ok = accepted.where(F.col("code").isNull()).select("tender_id", F.col("officer_id").alias("approved_by"), "approved_at")
    return criteria.join(ok, "tender_id").withColumn("status", F.lit("approved"))


EDITABLE = ["criterion_text", "criterion_type", "threshold_rupees", "gfr_override_permitted", "is_mandatory", "measurement_period"]


def patch_criteria(criteria: DataFrame, edits: DataFrame, tenders: DataFrame) -> DataFrame:
    """Each edit with its code and the values it leaves behind; only during schema review."""
    old = criteria.join(tenders.select("tender_id", F.col("status").alias("tender_status")), "tender_id", "left")
    old = old.select("criterion_id", "tender_id", "tender_status", *[F.col(c).alias(f"old_{c}") for c in EDITABLE])
    rows = edits.join(old, "criterion_id", "left")
    nothing = F.coalesce(*[F.col(c).cast("string") for c in EDITABLE]).isNull()
    code = (
        F.when(F.col("tender_id").isNull(), "CRITERION_NOT_FOUND")
        .when(F.coalesce(F.col("tender_status") != "SCHEMA_PENDING_REVIEW", F.lit(True)), "NOT_IN_REVIEW")
        .when(nothing, "NO_CHANGES")
        .when(F.col("criterion_type").isNotNull() & ~F.col("criterion_type").isin(*P.CRITERION_TYPES), "INVALID_TYPE")
    )
    rows = rows.withColumn("code", code)
    ok = F.col("code").isNull()
    return rows.select(
        "edit_id", "criterion_id", "tender_id", "officer_id", "code",
        *[F.when(ok, F.coalesce(c, f"old_{c}")).alias(f"new_{c}") for c in EDITABLE],
        F.col("old_criterion_text"), F.when(ok, "reviewed").alias("new_status"),
    )


def edits_to_precedents(patched: DataFrame, tenders: DataFrame) -> DataFrame:
    """Reworded criteria as precedents."""
    changed = patched.where(F.col("code").isNull() & (F.col("new_criterion_text") != F.col("old_criterion_text")))
    return changed.join(tenders.select("tender_id", "department", F.col("category").alias("tender_category")), "tender_id").select(
        F.sha2(F.concat_ws("|", F.lit("edit"), F.col("edit_id").cast("string")), 256).alias("precedent_id"),
        F.col("old_criterion_text").alias("criterion_text"), F.col("new_criterion_text").alias("resolved_interpretation"),
        "department", "tender_category", F.lit("PASS").alias("verdict"), F.lit("confirmed").alias("officer_action"),
        "officer_id", "tender_id", "criterion_id",
    )


def is_schema_approved(status: Column) -> Column:
    return status.isin(*P.APPROVED_STATES)


_HISTORY = "array<struct<original_value:string,amended_value:string,corrigendum_ref:string,amendment_reason:string>>"


def parse_amendment(stored: Column) -> Column:
    """Stored amendment text (wrapper object or bare list) as a struct with defaults."""
    wrapper = F.from_json(
        stored, f"history {_HISTORY}, _sources array<string>, _agreement_similarity double, needs_review boolean, review_reason string"
    )
    bare = F.from_json(stored, _HISTORY)
    is_list = F.trim(stored).startswith("[")
    default = F.array(F.lit("rules"))
    empty = F.array().cast(_HISTORY)
    return F.struct(
        F.coalesce(F.when(is_list, bare).otherwise(wrapper["history"]), empty).alias("history"),
        F.coalesce(F.when(is_list, default).otherwise(wrapper["_sources"]), default).alias("sources"),
        F.when(~is_list, wrapper["_agreement_similarity"]).alias("agreement_similarity"),
        F.coalesce(F.when(~is_list, wrapper["needs_review"]), F.lit(False)).alias("needs_review"),
        F.when(~is_list, wrapper["review_reason"]).alias("review_reason"),
    )
