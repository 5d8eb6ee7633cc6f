"""Verdict, routing and explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..sources.adapters import view
from . import duck as D
from .registry import query

_JUDGED_VIEWS = "evidence criteria"
_SUBMITTED = """
    cases AS (SELECT e.*, c.criterion_text, c.criterion_type, c.source_clause_ref, c.threshold_rupees, c.threshold_label, c.threshold_value,
        c.threshold_unit, c.threshold_count, c.threshold_period, c.is_mandatory, c.gfr_override_permitted, c.gfr_rule_number
        FROM evidence e JOIN criteria c ON e.criterion_id = c.criterion_id),
    limits AS (SELECT *, CASE WHEN coalesce(threshold_rupees, 0) <> 0 THEN threshold_rupees
        ELSE coalesce(""" + D.to_rupees("cast(threshold_value AS double)", "threshold_unit") + """, 0) END AS lim FROM cases)"""

_V_NUM = "CASE WHEN NOT has_value OR amount IS NULL OR lim <= 0 THEN 'REVIEW' WHEN amount >= lim THEN 'PASS' ELSE 'FAIL' END"
_C_NUM = "CASE WHEN NOT has_value OR amount IS NULL THEN 0.0 ELSE extraction_confidence END"
_V_CAT = "CASE WHEN NOT has_value THEN 'REVIEW' WHEN NOT found THEN 'FAIL' WHEN is_valid IS NULL THEN 'REVIEW' WHEN is_valid THEN 'PASS' ELSE 'FAIL' END"
_C_CAT = "CASE WHEN NOT has_value THEN 0.0 WHEN found AND is_valid IS NULL THEN extraction_confidence * 0.7 ELSE extraction_confidence END"
_V_TMP = "CASE WHEN NOT has_value THEN 'REVIEW' WHEN project_count >= coalesce(threshold_count, 2) THEN 'PASS' ELSE 'FAIL' END"
_C_TMP = "CASE WHEN NOT has_value THEN 0.0 ELSE extraction_confidence END"
_V_QUA = "CASE WHEN NOT has_value THEN 'REVIEW' ELSE model_verdict END"
_C_QUA = "CASE WHEN NOT has_value THEN 0.0 ELSE least(extraction_confidence, model_confidence) END"
_JUDGED = _SUBMITTED + f""",
    judged AS (SELECT *, CASE criterion_type WHEN 'numeric_threshold' THEN {_V_NUM} WHEN 'categorical_presence' THEN {_V_CAT}
            WHEN 'temporal_recency' THEN {_V_TMP} WHEN 'qualitative_assessment' THEN {_V_QUA} ELSE 'REVIEW' END AS verdict,
        CASE criterion_type WHEN 'numeric_threshold' THEN {_C_NUM} WHEN 'categorical_presence' THEN {_C_CAT}
            WHEN 'temporal_recency' THEN {_C_TMP} WHEN 'qualitative_assessment' THEN {_C_QUA} ELSE 0.0 END AS confidence,
        CASE WHEN criterion_type = 'qualitative_assessment' THEN 'llm_stub' WHEN criterion_type = 'composite' THEN 'unknown' ELSE 'deterministic' END AS method
        FROM limits),
    bounds AS (SELECT CASE WHEN count(*) < 50 THEN 0.90 ELSE 0.85 END AS hi, CASE WHEN count(*) < 50 THEN 0.60 ELSE 0.50 END AS lo FROM precedents),
    routed AS (SELECT j.*, CASE WHEN is_mandatory AND verdict = 'FAIL' THEN 'mandatory_review' WHEN entity_match_flag THEN 'mandatory_review'
            WHEN confidence < lo THEN 'mandatory_review' WHEN criterion_type = 'qualitative_assessment' AND verdict = 'FAIL' THEN 'hitl_review'
            WHEN confidence < hi THEN 'hitl_review'
            WHEN criterion_type IN ('numeric_threshold', 'categorical_presence', 'temporal_recency') THEN 'auto_commit' ELSE 'hitl_review' END AS route,
        CASE WHEN is_mandatory AND verdict = 'FAIL' THEN 'Mandatory criterion FAIL requires officer confirmation'
            WHEN entity_match_flag THEN 'Flags present: entity_mismatch'
            WHEN confidence < lo THEN concat('Confidence ', {D.two('confidence')}, ' below mandatory floor ', {D.two('lo')})
            WHEN criterion_type = 'qualitative_assessment' AND verdict = 'FAIL' THEN 'LLM-based FAIL verdict requires officer review'
            WHEN confidence < hi THEN concat('Confidence ', {D.two('confidence')}, ' below auto-commit threshold ', {D.two('hi')})
            WHEN criterion_type IN ('numeric_threshold', 'categorical_presence', 'temporal_recency') THEN 'High confidence deterministic evaluation'
            ELSE 'Qualitative assessment requires review' END AS reason
        FROM judged j, bounds)"""

_CRITERION_COLUMNS = [
    "criterion_id", "criterion_text", "criterion_type", "source_clause_ref", "threshold_rupees", "threshold_label", "threshold_value",
    "threshold_unit", "threshold_document", "threshold_count", "threshold_period", "is_mandatory", "gfr_override_permitted", "gfr_rule_number",
]


def cases(spark, d):
    criteria = view(spark, d, "criteria").select(*_CRITERION_COLUMNS)
    return view(spark, d, "evidence").join(criteria.hint("shuffle_hash"), "criterion_id")  # the wide evidence is not sorted


def judged(spark, d):
    return E.with_verdicts(cases(spark, d), E.thresholds_from(view(spark, d, "precedents")))


@query(
    "H1_evaluation_pairs",
    "bidders criteria debarment_list",
    """WITH debarred AS (SELECT DISTINCT b.bidder_id FROM bidders b JOIN debarment_list l ON b.pan_number = l.pan_number)
    SELECT b.tender_id, b.bidder_id, c.criterion_id, b.company_name, c.criterion_type, c.threshold_rupees
    FROM bidders b JOIN criteria c ON b.tender_id = c.tender_id
    WHERE b.status <> 'excluded' AND c.status = 'approved' AND b.bidder_id NOT IN (SELECT bidder_id FROM debarred)""",
)
def evaluation_pairs(spark, d):
    bidders = view(spark, d, "bidders")
    debarred = bidders.join(view(spark, d, "debarment_list").select("pan_number"), "pan_number", "left_semi")
    pairs = E.evaluation_pairs(bidders, view(spark, d, "criteria"), debarred)
    return pairs.select("tender_id", "bidder_id", "criterion_id", "company_name", "criterion_type", "threshold_rupees")


def _one_type(name, kind, column, verdict, confidence):
    @query(
        name,
        _JUDGED_VIEWS,
        f"WITH {_SUBMITTED} SELECT evaluation_id, {verdict} AS verdict, round({confidence}, 6) AS confidence FROM limits WHERE criterion_type = '{kind}'",
    )
    def run(spark, d):
        rows = cases(spark, d).where(F.col("criterion_type") == kind).withColumn("_v", column())
        return rows.select("evaluation_id", "_v.verdict", F.round("_v.confidence", 6).alias("confidence"))


_one_type("H2_eval_numeric", "numeric_threshold", E.eval_numeric, _V_NUM, _C_NUM)
_one_type("H3_eval_categorical", "categorical_presence", E.eval_categorical, _V_CAT, _C_CAT)
_one_type("H4_eval_temporal", "temporal_recency", E.eval_temporal, _V_TMP, _C_TMP)
_one_type("H5_eval_qualitative", "qualitative_assessment", E.eval_qualitative, _V_QUA, _C_QUA)


@query(
    "H6_evaluate_by_type",
    "evidence criteria precedents",
    f"WITH {_JUDGED} SELECT criterion_type, verdict, method AS evaluation_method, count(*) AS n, round(sum(confidence), 4) AS confidence_sum FROM judged GROUP BY ALL",
)
def evaluate_by_type(spark, d):
    rows = cases(spark, d).withColumn("_v", E.evaluate_by_type())
    return rows.groupBy("criterion_type", "_v.verdict", F.col("_v.evaluation_method").alias("evaluation_method")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("_v.confidence"), 4).alias("confidence_sum")
    )


@query(
    "H7_compute_route",
    "evidence criteria precedents",
    f"WITH {_JUDGED} SELECT evaluation_id, verdict, round(confidence, 6) AS confidence, route, reason AS route_reason FROM routed",
)
def compute_route(spark, d):
    return judged(spark, d).select("evaluation_id", "verdict", F.round("confidence", 6).alias("confidence"), "route", "route_reason")


@query(
    "H8_status_from_route",
    "evidence criteria precedents",
    f"WITH {_JUDGED} SELECT route, CASE WHEN route = 'auto_commit' THEN 'auto_committed' ELSE 'pending_review' END AS status, count(*) AS n FROM routed GROUP BY ALL",
)
def status_from_route(spark, d):
    return judged(spark, d).groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"))


_THR = f"CASE WHEN coalesce(threshold_rupees, 0) <> 0 THEN {D.rupees('threshold_rupees')} ELSE concat(cast(threshold_value AS varchar), '.0 ', threshold_unit) END"
_REQ = "cast(coalesce(threshold_count, 2) AS varchar)"
_PER = "coalesce(threshold_period, 'the required window')"
_KIND = "coalesce(upper(certificate_type), 'certificate')"
_HEADLINE = f"""CASE criterion_type
    WHEN 'numeric_threshold' THEN CASE WHEN verdict = 'REVIEW' THEN concat('Numeric value for ', source_clause_ref, ' could not be determined with sufficient confidence.')
        ELSE concat({D.rupees('amount')}, CASE WHEN fiscal_year IS NULL THEN '' ELSE concat(' (FY ', fiscal_year, ')') END,
            CASE WHEN verdict = 'PASS' THEN ' meets the ' ELSE ' falls short of the ' END, {_THR}, ' threshold set by ', source_clause_ref, '.') END
    WHEN 'categorical_presence' THEN CASE WHEN verdict = 'PASS' THEN concat({_KIND}, ' certificate found and valid; satisfies ', source_clause_ref, '.')
        WHEN verdict = 'FAIL' AND NOT found THEN concat('Required ', {_KIND}, ' certificate not found in bidder submission; ', source_clause_ref, ' not satisfied.')
        WHEN verdict = 'FAIL' THEN concat({_KIND}, ' certificate found but does not satisfy validity requirements of ', source_clause_ref, '.')
        ELSE concat({_KIND}, ' certificate status could not be determined with confidence; needs officer review.') END
    WHEN 'temporal_recency' THEN CASE WHEN verdict = 'PASS' THEN concat('Bidder documented ', project_count, ' similar projects within ', {_PER}, ' — meets the minimum of ', {_REQ}, ' required by ', source_clause_ref, '.')
        WHEN verdict = 'FAIL' THEN concat('Only ', project_count, ' similar projects found within ', {_PER}, '; ', source_clause_ref, ' requires at least ', {_REQ}, '.')
        ELSE concat('Could not reliably count similar projects within ', {_PER}, '; officer review required.') END
    WHEN 'qualitative_assessment' THEN CASE WHEN verdict = 'PASS' THEN concat('Bidder''s submission against ', source_clause_ref, ' satisfies the qualitative requirements; consensus verdict PASS.')
        WHEN verdict = 'FAIL' THEN concat('Bidder''s submission against ', source_clause_ref, ' does not satisfy the qualitative requirements; consensus verdict FAIL.')
        ELSE concat('Qualitative assessment for ', source_clause_ref, ' is inconclusive; officer judgment required.') END
    ELSE concat('Verdict ', verdict, ' recorded for ', criterion_text, '.') END"""
_FACTS = f"""concat_ws(' | ',
    CASE WHEN criterion_type = 'numeric_threshold' THEN concat_ws(' | ', concat('Extracted figure: ', {D.rupees('amount')}),
        CASE WHEN amount IS NOT NULL THEN concat('Raw extraction: ', {D.num_text('raw_value')}, ' ', unit) END,
        CASE WHEN fiscal_year IS NOT NULL THEN concat('Fiscal year on record: ', fiscal_year) END,
        concat(CASE WHEN coalesce(threshold_rupees, 0) <> 0 THEN 'Required threshold: ' ELSE 'Threshold data: ' END, {_THR})) END,
    CASE WHEN criterion_type = 'categorical_presence' THEN concat_ws(' | ', concat('Certificate type: ', {_KIND}),
        concat('Registration number: ', coalesce(registration_number, 'not located')),
        CASE WHEN validity_date IS NOT NULL THEN concat('Validity date on document: ', validity_date) END,
        CASE WHEN is_valid THEN 'Currently valid (expiry after today)' WHEN NOT is_valid THEN 'Expired as of today' END) END,
    CASE WHEN criterion_type = 'temporal_recency' THEN concat('Projects located: ', project_count, ' | Required minimum: ', {_REQ}) END,
    CASE WHEN criterion_type = 'qualitative_assessment' THEN concat('Rules branch (semantic): ', rules_verdict, ' | Branch agreement: ', agreement) END,
    CASE WHEN entity_match_flag THEN concat('⚠ Entity mismatch: registered ''', registered_name, ''' vs. extracted ''', extracted_name, ''' (type: mismatch).') END)"""
_NOTE = f"""concat(concat_ws(', ', concat('Extracted ', CASE evaluation_method WHEN 'none' THEN 'with no evidence captured' ELSE 'via regex / table extraction' END),
    concat('at ', {D.two('extraction_confidence')}, ' extraction confidence'), concat('(page OCR confidence ', {D.two('ocr_confidence')}, ')'),
    concat('for ', replace(criterion_type, '_', ' '), ' criterion')), '.')"""
_SOURCE = """concat(CASE WHEN source_page_number IS NOT NULL THEN concat('Page ', source_page_number, ' of ') ELSE '' END,
    coalesce(source_filename, 'bidder submission'), ', clause ', source_clause_ref)"""
_EXPLAINED = _JUDGED + f""", told AS (SELECT *, {_HEADLINE} AS headline, {_FACTS} AS facts_text, {_NOTE} AS confidence_note, {_SOURCE} AS source_reference,
    CASE route WHEN 'auto_commit' THEN 'Auto-committed — no officer action required.' WHEN 'hitl_review' THEN 'Officer confirmation required.'
        ELSE 'Mandatory officer review required. Auto-commit blocked by rule.' END AS next_action FROM routed)"""


@query(
    "H9_explain",
    "evidence criteria precedents",
    f"""WITH {_EXPLAINED} SELECT evaluation_id, headline, facts_text, source_reference, confidence_note, next_action,
        concat_ws(' ', headline, confidence_note, CASE WHEN route = 'auto_commit' THEN 'Auto-committed — no officer action required.'
            WHEN route = 'mandatory_review' THEN concat('Officer confirmation required.', CASE
                WHEN is_mandatory AND verdict = 'FAIL' THEN ' This is a mandatory criterion, so the FAIL verdict cannot be auto-committed and must be reviewed by the officer.'
                WHEN entity_match_flag THEN ' A potential entity-match issue was flagged, which triggers mandatory officer review regardless of verdict.' ELSE '' END)
            ELSE 'Routed for officer review before this verdict is finalised.' END,
            CASE WHEN verdict = 'FAIL' AND NOT gfr_override_permitted THEN concat('Override is not permitted under ', coalesce(gfr_rule_number, 'the applicable GFR rule'), '.') END) AS detail
        FROM told""",
)
def explain(spark, d):
    rows = E.with_explanation(judged(spark, d))
    return rows.select(
        "evaluation_id", "headline", F.array_join("facts", " | ").alias("facts_text"), "source_reference", "confidence_note", "next_action", "detail"
    )


@query(
    "H10_wrap_unwrap_value",
    "evaluations",
    """SELECT evaluation_id, CASE WHEN amount % 3 = 0 THEN concat('{"__value__":{"amount":', amount, '},"__explanation__":{"headline":"', verdict, '"}}')
        ELSE concat('{"amount":', amount, '}') END AS stored,
        concat('{"amount":', amount, '}') AS value, CASE WHEN amount % 3 = 0 THEN concat('{"headline":"', verdict, '"}') END AS explanation
    FROM evaluations""",
)
def wrap_unwrap(spark, d):
    rows = view(spark, d, "evaluations")
    value = F.struct("amount")
    wrapped = E.wrap_value(value, F.struct(F.col("verdict").alias("headline")))
    rows = rows.withColumn("stored", F.when(F.col("amount") % 3 == 0, wrapped).otherwise(F.to_json(value)))
    v, x = E.unwrap_value(F.col("stored"))
    return rows.select("evaluation_id", "stored", v.alias("value"), x.alias("explanation"))


@query(
    "H11_error_evaluations",
    "evaluations edits",
    """SELECT tender_id, bidder_id, criterion_id, 'REVIEW' AS verdict, 0.0 AS confidence, 'error' AS evaluation_method, 'mandatory_review' AS route,
        'Error: criterion_not_found' AS routing_reason, 'pending_review' AS status
    FROM evaluations e WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.criterion_id = e.criterion_id)""",
)
def error_evaluations(spark, d):
    requested = view(spark, d, "evaluations").select("tender_id", "bidder_id", "criterion_id")
    return E.error_evaluations(requested, view(spark, d, "edits"))
