"""Listings, summaries, reports, ledger, workflow and review queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import evaluate as E
from ..operators import ingest as A
from ..operators import ledger as L
from ..operators import report as R
from ..operators import review as J
from ..operators import views as B
from ..operators import workflow as K
from ..sources.adapters import view
from . import duck as D
from .registry import query

_PEND = "('pending_review', 'pending_second_officer')"


def _views(spark, d, names):
    return [view(spark, d, n) for n in names.split()]


# --- B: listings ---------------------------------------------------------------------

_EV = "SELECT e.evaluation_id, e.tender_id, e.bidder_id, e.verdict, e.confidence, e.route, e.status, e.created_at, b.company_name, c.criterion_text, c.criterion_type FROM evaluations e JOIN bidders b ON e.bidder_id = b.bidder_id JOIN criteria c ON e.criterion_id = c.criterion_id"
_EV_COLUMNS = "evaluation_id tender_id bidder_id verdict confidence route status created_at company_name criterion_text criterion_type".split()


@query("B1_evaluations_view", "evaluations bidders criteria", f"{_EV} WHERE e.status = 'pending_review' AND e.route = 'hitl_review' ORDER BY e.created_at DESC")
def evaluations_view(spark, d):
    e, b, c = _views(spark, d, "evaluations bidders criteria")
    rows = B.evaluations_view(e, b, c, status="pending_review", route="hitl_review")
    return rows.select(*_EV_COLUMNS).orderBy(F.desc("created_at"))


@query(
    "B2_audit_trail",
    "ledger_events",
    """SELECT event_id, tender_id, event_type, event_data, actor, ts_text, json_valid(event_data) AS is_json FROM ledger_events
    WHERE event_type = 'case_routed' AND ts_text >= '2024-01-02T00:00:00.000Z' AND ts_text <= '2024-01-20T00:00:00.000Z' ORDER BY event_id""",
)
def audit_trail(spark, d):
    rows = B.audit_trail(view(spark, d, "ledger_events"), "case_routed", "2024-01-02T00:00:00.000Z", "2024-01-20T00:00:00.000Z")
    return rows.orderBy("event_id")


@query("B3_list_tenders", "tenders", "SELECT * FROM tenders ORDER BY created_at DESC")
def list_tenders(spark, d):
    return view(spark, d, "tenders").orderBy(F.desc("created_at"))


@query("B3_list_bidders", "bidders", "SELECT tender_id, bidder_id, company_name, status FROM bidders ORDER BY tender_id, company_name")
def list_bidders(spark, d):
    return view(spark, d, "bidders").select("tender_id", "bidder_id", "company_name", "status").orderBy("tender_id", "company_name")


@query("B3_list_criteria", "criteria", "SELECT tender_id, criterion_id, criterion_text, criterion_type, status FROM criteria ORDER BY tender_id, criterion_id")
def list_criteria(spark, d):
    return view(spark, d, "criteria").select("tender_id", "criterion_id", "criterion_text", "criterion_type", "status").orderBy("tender_id", "criterion_id")


@query(
    "B4_tender_detail",
    "tenders bid_pages bidders",
    """SELECT t.tender_id, t.title, t.status, k.child_kind, k.child_id, k.child_label FROM tenders t LEFT JOIN (
        SELECT tender_id, 'document' AS child_kind, document_id AS child_id, doc_type AS child_label FROM bid_pages WHERE page_number = 0
        UNION ALL SELECT tender_id, 'bidder', cast(bidder_id AS varchar), company_name FROM bidders) k ON t.tender_id = k.tender_id""",
)
def tender_detail(spark, d):
    t, p, b = _views(spark, d, "tenders bid_pages bidders")
    docs = p.where("page_number = 0")
    return B.tender_detail(t.select("tender_id", "title", "status"), docs, b)


@query(
    "B5_evaluation_detail",
    "evaluations",
    """SELECT evaluation_id, verdict, entity_match_flag, cast(json_extract(source_bbox, '$.x') AS bigint) AS bbox_x,
    cast(json_extract(source_bbox, '$.y') AS bigint) AS bbox_y FROM evaluations""",
)
def evaluation_detail(spark, d):
    return B.evaluation_detail(view(spark, d, "evaluations")).select("evaluation_id", "verdict", "entity_match_flag", "bbox_x", "bbox_y")


@query(
    "B6_summarise_event",
    "ledger_events",
    """WITH parsed AS (SELECT event_id, event_data, CASE WHEN json_valid(event_data) THEN event_data ELSE '{}' END AS j FROM ledger_events),
    lines AS (SELECT event_id, event_data, concat_ws('; ',
        CASE WHEN json_extract_string(j, '$.bidder_id') IS NOT NULL THEN concat('bidder=', substr(json_extract_string(j, '$.bidder_id'), 1, 8), '...') END,
        CASE WHEN json_extract_string(j, '$.criterion_id') IS NOT NULL THEN concat('criterion=', substr(json_extract_string(j, '$.criterion_id'), 1, 8), '...') END,
        CASE WHEN json_extract_string(j, '$.verdict') IS NOT NULL THEN concat('verdict=', json_extract_string(j, '$.verdict')) END,
        CASE WHEN json_extract_string(j, '$.decision') IS NOT NULL THEN concat('decision=', json_extract_string(j, '$.decision')) END,
        CASE WHEN json_extract_string(j, '$.officer_id') IS NOT NULL THEN concat('officer=', json_extract_string(j, '$.officer_id')) END) AS line FROM parsed)
    SELECT event_id, CASE WHEN line <> '' THEN line ELSE substr(event_data, 1, 100) END AS summary FROM lines""",
)
def summarise_event(spark, d):
    return view(spark, d, "ledger_events").select("event_id", B.summarise_event(F.col("event_data")).alias("summary"))


@query("B7_progress_pct", "tenders", f"SELECT tender_id, {D.case('status', P.PROGRESS_PCT, '0')} AS progress_pct FROM tenders")
def progress_pct(spark, d):
    return B.poll_status(view(spark, d, "tenders")).select("tender_id", "progress_pct")


@query(
    "B9_poll_status",
    "tenders",
    f"SELECT tender_id, status, {D.case('status', P.PROGRESS_PCT, '0')} AS progress_pct, status AS current_step FROM tenders",
)
def poll_status(spark, d):
    return B.poll_status(view(spark, d, "tenders"))


@query(
    "B10_first_nit",
    "uploads",
    "SELECT tender_ref, min_by(upload_id, (uploaded_at, upload_id)) AS upload_id, min(uploaded_at) AS uploaded_at FROM uploads WHERE doc_type = 'nit' GROUP BY tender_ref",
)
def first_nit(spark, d):
    return B.first_nit(view(spark, d, "uploads"))


# --- L: summaries and reports ----------------------------------------------------------


@query(
    "L1_tender_summary",
    "evaluations",
    f"""SELECT tender_id, count(*) AS total, count_if(status = 'auto_committed') AS auto_committed, count_if(status IN {_PEND}) AS pending,
    count_if(status = 'resolved') AS completed FROM evaluations GROUP BY tender_id""",
)
def tender_summary(spark, d):
    return R.tender_summary(view(spark, d, "evaluations"))


@query(
    "L2_bidder_breakdown",
    "bidders evaluations",
    """SELECT b.tender_id, b.bidder_id, b.company_name, coalesce(sum(CASE WHEN e.verdict = 'PASS' THEN 1 END), 0)::BIGINT AS pass_count,
    coalesce(sum(CASE WHEN e.verdict = 'FAIL' THEN 1 END), 0)::BIGINT AS fail_count, coalesce(sum(CASE WHEN e.verdict = 'REVIEW' THEN 1 END), 0)::BIGINT AS review_count FROM bidders b LEFT JOIN evaluations e ON b.bidder_id = e.bidder_id GROUP BY ALL""",
)
def bidder_breakdown(spark, d):
    return R.bidder_breakdown(*_views(spark, d, "bidders evaluations"))


_ELIGIBILITY = f"""WITH f AS (SELECT e.bidder_id, count(*) AS total_criteria, count_if(verdict = 'PASS') AS pass_count, count_if(verdict = 'FAIL') AS fail_count,
        count_if(verdict = 'REVIEW') AS review_count, count_if(e.status = 'auto_committed') AS auto_committed, count_if(e.status = 'resolved') AS officer_reviewed,
        count_if(e.status IN {_PEND}) AS pend, count_if(coalesce(c.is_mandatory, false) AND verdict = 'FAIL' AND coalesce(officer_decision, '') <> 'override') AS mf
        FROM evaluations e LEFT JOIN criteria c ON e.criterion_id = c.criterion_id GROUP BY e.bidder_id)
    SELECT b.tender_id, b.bidder_id, b.company_name, b.debarment_status, coalesce(total_criteria, 0) AS total_criteria, coalesce(pass_count, 0) AS pass_count,
        coalesce(fail_count, 0) AS fail_count, coalesce(review_count, 0) AS review_count, coalesce(auto_committed, 0) AS auto_committed,
        coalesce(officer_reviewed, 0) AS officer_reviewed,
        CASE WHEN coalesce(mf, 0) > 0 THEN 'Not Eligible' WHEN coalesce(review_count, 0) > 0 OR coalesce(pend, 0) > 0 THEN 'Under Review' ELSE 'Eligible' END AS eligibility
    FROM bidders b LEFT JOIN f ON b.bidder_id = f.bidder_id"""


@query("L3_bidder_eligibility", "bidders evaluations criteria", _ELIGIBILITY)
def bidder_eligibility(spark, d):
    return R.bidder_eligibility(*_views(spark, d, "bidders evaluations criteria"))


_CHAIN = """ordered AS (SELECT *, row_number() OVER (PARTITION BY tender_id ORDER BY event_id) AS rn,
        CASE WHEN json_valid(event_data) THEN event_data ELSE concat('"', event_data, '"') END AS data FROM ledger_events),
    chained AS (
        SELECT tender_id, event_id, event_type, event_data, actor, ts_text, data, rn, repeat('0', 64) AS prev_hash,
            sha256(concat('{"actor":"', actor, '","event_data":', event_data, ',"event_type":"', event_type, '","prev_hash":"', repeat('0', 64), '","timestamp":"', ts_text, '"}')) AS entry_hash
        FROM ordered WHERE rn = 1
        UNION ALL
        SELECT o.tender_id, o.event_id, o.event_type, o.event_data, o.actor, o.ts_text, o.data, o.rn, c.entry_hash,
            sha256(concat('{"actor":"', o.actor, '","event_data":', o.event_data, ',"event_type":"', o.event_type, '","prev_hash":"', c.entry_hash, '","timestamp":"', o.ts_text, '"}'))
        FROM chained c JOIN ordered o ON o.tender_id = c.tender_id AND o.rn = c.rn + 1)"""
_DIGEST = """digests AS (SELECT tender_id, count(*) AS n, sha256(concat('[', string_agg(concat('{"actor":"', actor, '","entry_hash":"', entry_hash, '","event_data":', data,
        ',"event_type":"', event_type, '","id":', event_id, ',"prev_hash":"', prev_hash, '","tender_id":"', tender_id, '","timestamp":"', ts_text, '"}'), ',' ORDER BY event_id), ']')) AS digest
    FROM chained GROUP BY tender_id)"""


def chained_ledger(spark, d):
    return L.append_events(view(spark, d, "ledger_events"))


@query(
    "L4_report_headers",
    "tenders bidders criteria evaluations ledger_events",
    f"""WITH RECURSIVE {_CHAIN}, {_DIGEST},
    bad AS (SELECT DISTINCT tender_id FROM ledger_events WHERE NOT json_valid(event_data)),
    e AS (SELECT tender_id, count(*) AS total_evaluations, count_if(status = 'auto_committed') AS auto_committed, count_if(status = 'resolved') AS officer_reviewed,
        count_if(status IN {_PEND}) AS pending FROM evaluations GROUP BY tender_id)
    SELECT t.tender_id, t.title, t.department, t.category, t.status, coalesce(b.n, 0) AS total_bidders, coalesce(c.n, 0) AS total_criteria,
        coalesce(total_evaluations, 0) AS total_evaluations, coalesce(auto_committed, 0) AS auto_committed, coalesce(officer_reviewed, 0) AS officer_reviewed,
        coalesce(pending, 0) AS pending, t.tender_id NOT IN (SELECT tender_id FROM bad) AS chain_valid,
        coalesce(g.n, 0) AS audit_trail_entries, g.digest AS sha256_hash
    FROM tenders t LEFT JOIN (SELECT tender_id, count(*) AS n FROM bidders GROUP BY 1) b ON b.tender_id = t.tender_id
    LEFT JOIN (SELECT tender_id, count(*) AS n FROM criteria GROUP BY 1) c ON c.tender_id = t.tender_id
    LEFT JOIN e ON e.tender_id = t.tender_id LEFT JOIN digests g ON g.tender_id = t.tender_id""",
)
def report_headers(spark, d):
    t, b, c, e = _views(spark, d, "tenders bidders criteria evaluations")
    ledger = chained_ledger(spark, d)
    return R.report_header(t, b, c, e, L.verify_chain(ledger), L.ledger_digest(ledger))


@query(
    "L4_report_rows",
    "evaluations bidders criteria bid_pages",
    """SELECT e.evaluation_id, e.tender_id, e.bidder_id, b.company_name, coalesce(c.criterion_text, 'Unknown') AS criterion_text,
        coalesce(c.criterion_type, 'Unknown') AS criterion_type, coalesce(c.is_mandatory, false) AS is_mandatory, e.verdict, e.confidence, e.route, e.status,
        e.officer_decision, e.officer_id, p.document_id || '.pdf' AS source_filename
    FROM evaluations e JOIN bidders b ON e.bidder_id = b.bidder_id LEFT JOIN criteria c ON e.criterion_id = c.criterion_id
    LEFT JOIN (SELECT document_id FROM bid_pages WHERE page_number = 0 AND doc_type = 'bidder_submission') p ON p.document_id = e.source_document_id""",
)
def report_rows(spark, d):
    e, b, c, p = _views(spark, d, "evaluations bidders criteria bid_pages")
    docs = p.where("page_number = 0 AND doc_type = 'bidder_submission'").select("document_id", F.concat("document_id", F.lit(".pdf")).alias("filename"))
    return R.report_rows(e, b, c, docs).select(
        "evaluation_id", "tender_id", "bidder_id", "company_name", "criterion_text", "criterion_type", "is_mandatory", "verdict", "confidence",
        "route", "status", "officer_decision", "officer_id", "source_filename",
    )


@query("L5_event_histogram", "ledger_events", "SELECT tender_id, event_type, count(*) AS n FROM ledger_events GROUP BY ALL")
def event_histogram(spark, d):
    return R.event_histogram(view(spark, d, "ledger_events"))


@query("L6_ledger_digest", "ledger_events", f"WITH RECURSIVE {_CHAIN}, {_DIGEST} SELECT tender_id, n, digest FROM digests")
def ledger_digest(spark, d):
    return L.ledger_digest(chained_ledger(spark, d))


# --- M: ledger -------------------------------------------------------------------------


@query("M1_append_events", "ledger_events", f"WITH RECURSIVE {_CHAIN} SELECT tender_id, event_id, event_type, event_data, actor, ts_text, prev_hash, entry_hash FROM chained")
def append_events(spark, d):
    return chained_ledger(spark, d)


_TAMPER = """tampered AS (SELECT tender_id, event_id, event_type, actor, ts_text,
        CASE WHEN event_id % 501 = 5 THEN '{"k":-1}' ELSE event_data END AS event_data,
        CASE WHEN event_id % 701 = 6 THEN repeat('a', 64) ELSE prev_hash END AS prev_hash, entry_hash FROM chained)"""


def tampered_ledger(spark, d):
    """A ledger in which some rows were changed after the fact."""
    rows = chained_ledger(spark, d)
    rows = rows.withColumn("event_data", F.when(F.col("event_id") % 501 == 5, F.lit('{"k":-1}')).otherwise(F.col("event_data")))
    return rows.withColumn("prev_hash", F.when(F.col("event_id") % 701 == 6, F.lit("a" * 64)).otherwise(F.col("prev_hash")))


@query(
    "M2_verify_chain",
    "ledger_events",
    f"""WITH RECURSIVE {_CHAIN}, {_TAMPER},
    linked AS (SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY tender_id ORDER BY event_id), repeat('0', 64)) AS want,
        sha256(concat('{{"actor":"', actor, '","event_data":', event_data, ',"event_type":"', event_type, '","prev_hash":"', prev_hash, '","timestamp":"', ts_text, '"}}')) AS again FROM tampered),
    told AS (SELECT tender_id, event_id, CASE WHEN NOT json_valid(event_data) THEN concat('Event ', event_id, ': event_data is not valid JSON')
        WHEN prev_hash <> want THEN concat('Event ', event_id, ': prev_hash mismatch. Expected ''', want, ''', got ''', prev_hash, '''')
        WHEN again <> entry_hash THEN concat('Event ', event_id, ': entry_hash mismatch. Recomputed ''', again, ''', stored ''', entry_hash, '''') END AS err FROM linked)
    SELECT tender_id, count(err) = 0 AS chain_valid, min_by(err, event_id) FILTER (WHERE err IS NOT NULL) AS first_error, count(*) AS event_count FROM told GROUP BY tender_id""",
)
def verify_chain(spark, d):
    return L.verify_chain(tampered_ledger(spark, d))


@query(
    "M3_canonical_json",
    "ledger_events",
    "SELECT event_id, CASE WHEN json_valid(event_data) THEN event_data END AS canonical FROM ledger_events",
)
def canonical(spark, d):
    # The same object with reordered keys and blanks must come back in canonical form.
    loose = F.regexp_replace(F.col("event_data"), r'^\{"decision":"confirm","officer_id":("[^"]*")\}$', r'{ "officer_id" : $1 , "decision" : "confirm" }')
    return view(spark, d, "ledger_events").select("event_id", L.canonical_json(loose).alias("canonical"))


# --- K: workflow -----------------------------------------------------------------------

_LEGAL = "(" + ", ".join(f"'{a}>{b}'" for a, b in P.TRANSITIONS) + ")"


@query(
    "K1_validate_transitions",
    "tenders transition_requests",
    f"""SELECT r.request_id, r.tender_id, r.target_status, t.status, CASE WHEN t.status IS NULL THEN 'TENDER_NOT_FOUND'
        WHEN concat(t.status, '>', r.target_status) NOT IN {_LEGAL} THEN 'INVALID_TRANSITION' END AS code,
        CASE WHEN concat(t.status, '>', r.target_status) IN {_LEGAL} AND t.status IS NOT NULL THEN r.target_status END AS new_status
    FROM transition_requests r LEFT JOIN tenders t ON r.tender_id = t.tender_id""",
)
def validate_transitions(spark, d):
    t, r = _views(spark, d, "tenders transition_requests")
    return K.validate_transitions(t, r).select("request_id", "tender_id", "target_status", "status", "code", "new_status")


def bid_documents(spark, d):
    p = view(spark, d, "bid_pages").where("page_number = 0")
    return p.select("tender_id", "document_id", F.when(F.col("bidder_id") % 37 == 0, "processing").otherwise("complete").alias("processing_status"))


@query(
    "K2_transition_guards",
    "tenders bidders criteria evaluations transition_requests",
    f"""WITH docs AS (SELECT tender_id, count(*) AS documents, count_if(bidder_id % 37 = 0) AS unprocessed FROM bidders GROUP BY 1),
    bs AS (SELECT tender_id, count_if(debarment_status = 'flagged') AS flagged, count_if(status <> 'excluded') AS nb FROM bidders GROUP BY 1),
    cs AS (SELECT tender_id, count_if(status = 'approved') AS nc FROM criteria GROUP BY 1),
    es AS (SELECT tender_id, count(*) AS ne, count_if(status IN {_PEND}) AS pending FROM evaluations GROUP BY 1),
    j AS (SELECT r.request_id, r.tender_id, t.status, r.target_status, concat(t.status, '>', r.target_status) AS edge, coalesce(documents, 0) AS documents,
        coalesce(unprocessed, 0) AS unprocessed, coalesce(flagged, 0) AS flagged, coalesce(nb, 0) * coalesce(nc, 0) AS expected, coalesce(ne, 0) AS ne, coalesce(pending, 0) AS pending
        FROM transition_requests r LEFT JOIN tenders t ON r.tender_id = t.tender_id LEFT JOIN docs ON docs.tender_id = r.tender_id
        LEFT JOIN bs ON bs.tender_id = r.tender_id LEFT JOIN cs ON cs.tender_id = r.tender_id LEFT JOIN es ON es.tender_id = r.tender_id),
    g AS (SELECT *, CASE WHEN edge = 'DOCUMENTS_UPLOADED>PROCESSING_OCR' AND documents = 0 THEN 'At least one document must be uploaded before processing'
        WHEN edge = 'PROCESSING_OCR>OCR_COMPLETE' AND unprocessed > 0 THEN concat(unprocessed, ' document(s) still processing')
        WHEN edge = 'DEBARMENT_CHECK>EVALUATING' AND flagged > 0 THEN concat(flagged, ' bidder(s) flagged for debarment — must resolve first')
        WHEN edge = 'EVALUATING>VERDICTS_COMPUTED' AND ne < expected THEN concat('Only ', ne, '/', expected, ' evaluations completed')
        WHEN edge = 'VERDICTS_COMPUTED>HITL_PENDING' AND pending = 0 THEN 'No cases pending HITL review'
        WHEN edge = 'HITL_PENDING>EVALUATION_COMPLETE' AND pending > 0 THEN concat(pending, ' case(s) still pending officer review') END AS guard FROM j)
    SELECT request_id, tender_id, CASE WHEN status IS NULL THEN 'TENDER_NOT_FOUND' WHEN edge NOT IN {_LEGAL} THEN 'INVALID_TRANSITION'
        WHEN guard IS NOT NULL THEN 'GUARD_FAILED' END AS code, CASE WHEN status IS NOT NULL AND edge IN {_LEGAL} THEN guard END AS guard FROM g""",
)
def transition_guards(spark, d):
    t, b, c, e, r = _views(spark, d, "tenders bidders criteria evaluations transition_requests")
    facts = K.tender_facts(bid_documents(spark, d), b, c, e)
    return K.validate_transitions(t, r, facts).select("request_id", "tender_id", "code", "guard")


@query(
    "K3_replay_status",
    "tenders transition_requests",
    f"""WITH RECURSIVE o AS (SELECT r.*, t.status, row_number() OVER (PARTITION BY r.tender_id ORDER BY requested_on, request_id) AS rn
        FROM transition_requests r JOIN tenders t ON r.tender_id = t.tender_id),
    s AS (SELECT tender_id, request_id, target_status, rn, concat(status, '>', target_status) IN {_LEGAL} AS accepted,
            CASE WHEN concat(status, '>', target_status) IN {_LEGAL} THEN target_status ELSE status END AS state_after FROM o WHERE rn = 1
        UNION ALL SELECT o.tender_id, o.request_id, o.target_status, o.rn, concat(s.state_after, '>', o.target_status) IN {_LEGAL},
            CASE WHEN concat(s.state_after, '>', o.target_status) IN {_LEGAL} THEN o.target_status ELSE s.state_after END
        FROM s JOIN o ON o.tender_id = s.tender_id AND o.rn = s.rn + 1)
    SELECT tender_id, request_id, target_status, accepted, state_after FROM s""",
)
def replay_status(spark, d):
    return K.replay_status(*_views(spark, d, "tenders transition_requests"))


@query(
    "K4_status_after_evaluation",
    "evaluations",
    f"""SELECT tender_id, count_if(status IN {_PEND}) AS pending, CASE WHEN count_if(status IN {_PEND}) > 0 THEN 'HITL_PENDING' ELSE 'EVALUATION_COMPLETE' END AS new_status
    FROM evaluations GROUP BY tender_id""",
)
def status_after_evaluation(spark, d):
    return K.status_after_evaluation(view(spark, d, "evaluations"))


@query(
    "K4_status_after_processing",
    "tenders criteria",
    """SELECT t.tender_id, count(c.criterion_id) AS criteria_count, CASE WHEN count(c.criterion_id) > 0 THEN 'SCHEMA_PENDING_REVIEW' ELSE 'OCR_COMPLETE' END AS new_status
    FROM tenders t LEFT JOIN criteria c ON t.tender_id = c.tender_id AND c.status <> 'extracted' GROUP BY t.tender_id""",
)
def status_after_processing(spark, d):
    t, c = _views(spark, d, "tenders criteria")
    return K.status_after_processing(t, c.where("status <> 'extracted'"))


# --- J: review -------------------------------------------------------------------------

_RANK = "CASE e.route WHEN 'mandatory_review' THEN 0 WHEN 'hitl_review' THEN 1 ELSE 2 END"


@query(
    "J1_review_queue",
    "evaluations criteria bidders",
    f"""SELECT e.tender_id, e.evaluation_id, e.verdict, e.confidence, e.route, e.status, c.criterion_text, c.is_mandatory, b.company_name AS bidder_name, {_RANK} AS queue_class
    FROM evaluations e JOIN criteria c ON e.criterion_id = c.criterion_id JOIN bidders b ON e.bidder_id = b.bidder_id
    WHERE e.status IN {_PEND} ORDER BY e.tender_id, queue_class, e.confidence, e.evaluation_id""",
)
def review_queue(spark, d):
    rows = J.review_queue(*_views(spark, d, "evaluations criteria bidders"))
    return rows.select(
        "tender_id", "evaluation_id", "verdict", "confidence", "route", "status", "criterion_text", "is_mandatory", "bidder_name", "queue_class"
    ).orderBy("tender_id", "queue_class", "confidence", "evaluation_id")


_DECIDED = """dj AS (SELECT x.*, e.tender_id, e.criterion_id, e.verdict, e.status, c.gfr_override_permitted AS perm, c.is_mandatory AS mand
        FROM decisions x LEFT JOIN evaluations e ON x.evaluation_id = e.evaluation_id LEFT JOIN criteria c ON e.criterion_id = c.criterion_id),
    own AS (SELECT *, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN status <> 'pending_review' THEN 'NOT_PENDING' WHEN decision NOT IN ('confirm', 'override') THEN 'INVALID_DECISION'
        WHEN decision = 'override' AND trim(coalesce(reason, '')) = '' THEN 'REASON_REQUIRED'
        WHEN decision = 'override' AND NOT coalesce(perm, true) AND verdict = 'FAIL' THEN 'OVERRIDE_NOT_PERMITTED' END AS own_code FROM dj),
    ranked AS (SELECT *, min(CASE WHEN own_code IS NULL THEN concat(decided_at, '|', decision_id) END) OVER (PARTITION BY evaluation_id) AS winner FROM own),
    coded AS (SELECT *, CASE WHEN own_code IN ('NOT_FOUND', 'NOT_PENDING') THEN own_code WHEN winner IS NOT NULL AND concat(decided_at, '|', decision_id) > winner THEN 'NOT_PENDING'
        ELSE own_code END AS code FROM ranked),
    applied AS (SELECT *, CASE WHEN code IS NOT NULL THEN NULL WHEN decision = 'override' AND perm AND mand AND verdict = 'FAIL' THEN 'pending_second_officer' ELSE 'resolved' END AS new_status FROM coded)"""


@query(
    "J3_apply_decisions",
    "decisions evaluations criteria",
    f"WITH {_DECIDED} SELECT decision_id, evaluation_id, decision, officer_id, code, new_status, CASE WHEN new_status = 'resolved' THEN decided_at END AS resolved_at FROM applied",
)
def apply_decisions(spark, d):
    e, x, c = _views(spark, d, "evaluations decisions criteria")
    return J.apply_decisions(e, x, c).select("decision_id", "evaluation_id", "decision", "officer_id", "code", "new_status", "resolved_at")


@query(
    "J4_apply_second_officer",
    "second_decisions evaluations",
    """WITH s AS (SELECT x.*, e.officer_decision, CASE WHEN e.status IS NULL THEN 'NOT_FOUND' WHEN e.status <> 'pending_second_officer' THEN 'NOT_REQUIRED'
        WHEN e.officer_id = x.officer_id THEN 'SAME_OFFICER' WHEN x.decision NOT IN ('approve', 'reject') THEN 'INVALID_DECISION' END AS code
        FROM second_decisions x LEFT JOIN evaluations e ON x.evaluation_id = e.evaluation_id)
    SELECT evaluation_id, officer_id, decision, code, CASE WHEN code IS NULL AND decision = 'approve' THEN 'resolved' WHEN code IS NULL THEN 'pending_review' END AS new_status,
        CASE WHEN code IS NULL AND decision = 'approve' THEN officer_decision END AS kept_decision, CASE WHEN code IS NULL AND decision = 'approve' THEN decided_at END AS resolved_at FROM s""",
)
def apply_second_officer(spark, d):
    return J.apply_second_officer(*_views(spark, d, "evaluations second_decisions"))


@query(
    "J5_J6_override_options",
    "evaluations criteria",
    """SELECT evaluation_id, gfr_override_permitted OR verdict <> 'FAIL' AS can_override, gfr_override_permitted AND is_mandatory AND verdict = 'FAIL' AS needs_second_officer
    FROM evaluations e JOIN criteria c ON e.criterion_id = c.criterion_id""",
)
def override_options(spark, d):
    e, c = _views(spark, d, "evaluations criteria")
    rows = e.select("evaluation_id", "criterion_id", "verdict").join(c.select("criterion_id", "is_mandatory", "gfr_override_permitted"), "criterion_id")
    return rows.select("evaluation_id", J.can_override().alias("can_override"), J.needs_second_officer().alias("needs_second_officer"))


@query(
    "J7_decisions_to_precedents",
    "decisions evaluations criteria tenders",
    f"""WITH {_DECIDED} SELECT sha256(concat(a.evaluation_id, '|', decision_id)) AS precedent_id, c.criterion_text,
        CASE WHEN decision = 'confirm' THEN concat('Confirmed system verdict: ', verdict) ELSE concat('Overridden to opposite of ', verdict, '. Reason: ', coalesce(reason, 'N/A')) END AS resolved_interpretation,
        t.department, t.category AS tender_category, verdict, decision AS officer_action, officer_id, a.tender_id, a.criterion_id
    FROM applied a JOIN criteria c ON a.criterion_id = c.criterion_id JOIN tenders t ON a.tender_id = t.tender_id WHERE new_status = 'resolved'""",
)
def decisions_to_precedents(spark, d):
    e, x, c, t = _views(spark, d, "evaluations decisions criteria tenders")
    return J.decisions_to_precedents(J.accepted_decisions(e, x, c), c, t)


# --- M4: ledger rows of every stage ------------------------------------------------------


@query(
    "M4_emit_events",
    "evaluations decisions criteria bid_pages amendments approvals bidders evidence tenders",
    f"""WITH {_DECIDED} SELECT tender_id, 'document_received' AS event_type, concat('{{"doc_type":"', doc_type, '","document_id":"', document_id, '"}}') AS event_data, 'system' AS actor, uploaded_at AS ts_text FROM bid_pages WHERE page_number = 0
    UNION ALL SELECT tender_id, 'verdict_computed', concat('{{"bidder_id":', bidder_id, ',"confidence":', {D.two('confidence')}, ',"criterion_id":', criterion_id, ',"evaluation_id":"', evaluation_id, '","verdict":"', verdict, '"}}'), 'system', created_at FROM evaluations
    UNION ALL SELECT tender_id, 'case_routed', concat('{{"evaluation_id":"', evaluation_id, '","flags":', CASE WHEN entity_match_flag THEN '["entity_mismatch"]' ELSE '[]' END, ',"route":"', route, '"}}'), 'system', created_at FROM evaluations
    UNION ALL SELECT tender_id, 'officer_decision', concat('{{"decision":"', decision, '","evaluation_id":"', evaluation_id, '","officer_id":"', officer_id, '","reason":', CASE WHEN reason IS NULL THEN 'null' ELSE concat('"', reason, '"') END,
        ',"requires_second_officer":', CASE WHEN new_status = 'resolved' THEN 'false' ELSE 'true' END, '}}'), officer_id, decided_at FROM applied WHERE code IS NULL
    UNION ALL SELECT tender_id, 'ocr_completed', concat('{{"avg_ocr_confidence":', {D.two('avg(ocr_confidence)')}, ',"degraded_pages":[', coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER (WHERE ocr_confidence < 0.5), ''),
        '],"document_id":"', document_id, '","page_count":', count(*), '}}'), 'system', max(uploaded_at) FROM bid_pages GROUP BY tender_id, document_id
    UNION ALL SELECT tender_id, 'corrigendum_linked', concat('{{"corrigendum_document_id":"', corrigendum_id, '","criteria_amended":', count(*), '}}'), 'system', min(uploaded_at) FROM amendments GROUP BY tender_id, corrigendum_id
    UNION ALL SELECT a.tender_id, 'schema_approved', concat('{{"criteria_count":', coalesce(n, 0), ',"officer_id":"', officer_id, '"}}'), officer_id, approved_at
        FROM approvals a LEFT JOIN (SELECT tender_id, count(*) AS n FROM criteria GROUP BY 1) c ON c.tender_id = a.tender_id
    UNION ALL SELECT tender_id, 'debarment_checked', concat('{{"bidder_id":', bidder_id, ',"check_method":', CASE WHEN debarment_status = 'flagged' THEN '"recorded"' ELSE 'null' END, ',"company_name":"', company_name, '","is_debarred":',
        CASE WHEN debarment_status = 'flagged' THEN 'true' ELSE 'false' END, '}}'), 'system', '2024-01-15T00:00:00Z' FROM bidders
    UNION ALL SELECT e.tender_id, 'evidence_extracted', concat('{{"bidder_id":', bidder_id, ',"criterion_id":', e.criterion_id, ',"criterion_type":"', criterion_type, '","entity_match_flag":', CASE WHEN entity_match_flag THEN 'true' ELSE 'false' END,
        ',"extraction_confidence":', {D.two('extraction_confidence')}, ',"source_document_id":', CASE WHEN source_filename IS NULL THEN 'null' ELSE concat('"', source_filename, '"') END, '}}'), 'system', '2024-02-01T00:00:00Z'
        FROM evidence e JOIN criteria c ON c.criterion_id = e.criterion_id
    UNION ALL SELECT t.tender_id, 'report_generated', concat('{{"audit_trail_entries":', coalesce(n, 0), ',"officer_id":"officer-0","report_id":"', sha256(concat('report|', t.tender_id)), '"}}'), 'officer-0', '2024-07-01T00:00:00Z'
        FROM tenders t LEFT JOIN (SELECT tender_id, count(*) AS n FROM evaluations GROUP BY 1) v ON v.tender_id = t.tender_id""",
)
def emit_events(spark, d):
    e, x, c, p = _views(spark, d, "evaluations decisions criteria bid_pages")
    from ..functions.common import json_bool, json_number, json_string, two

    s = lambda n: json_string(F.col(n))
    received = L.event_rows(
        p.where("page_number = 0"), "document_received", {"doc_type": s("doc_type"), "document_id": s("document_id")}, "system", F.col("uploaded_at")
    )
    verdicts = L.event_rows(
        e, "verdict_computed",
        {"bidder_id": json_number(F.col("bidder_id")), "criterion_id": json_number(F.col("criterion_id")), "confidence": two(F.col("confidence")),
         "evaluation_id": s("evaluation_id"), "verdict": s("verdict")},
        "system", F.col("created_at"),
    )
    flags = F.when(F.col("entity_match_flag"), F.lit('["entity_mismatch"]')).otherwise(F.lit("[]"))
    routed = L.event_rows(e, "case_routed", {"evaluation_id": s("evaluation_id"), "flags": flags, "route": s("route")}, "system", F.col("created_at"))
    accepted = J.accepted_decisions(e, x, c)
    decided = L.event_rows(
        accepted, "officer_decision",
        {"decision": s("decision"), "evaluation_id": s("evaluation_id"), "officer_id": s("officer_id"), "reason": s("reason"),
         "requires_second_officer": json_bool(F.col("new_status") == "pending_second_officer")},
        F.col("officer_id"), F.col("decided_at"),
    )
    number = lambda n: json_number(F.col(n))
    degraded = F.array_sort(F.collect_list(F.when(A.is_degraded(F.col("ocr_confidence")), F.col("page_number"))))  # pages of one file
    read = p.groupBy("tender_id", "document_id").agg(
        F.avg("ocr_confidence").alias("mean"), F.count(F.lit(1)).alias("pages"), degraded.alias("degraded"), F.max("uploaded_at").alias("at")
    )
    read = L.event_rows(
        read, "ocr_completed",
        {"document_id": s("document_id"), "page_count": number("pages"), "avg_ocr_confidence": two(F.col("mean")),
         "degraded_pages": F.concat(F.lit("["), F.array_join(F.col("degraded").cast("array<string>"), ","), F.lit("]"))},
        "system", F.col("at"),
    )
    amendments, approvals, bidders, evidence, tenders = _views(spark, d, "amendments approvals bidders evidence tenders")
    linked = amendments.groupBy("tender_id", "corrigendum_id").agg(F.count(F.lit(1)).alias("n"), F.min("uploaded_at").alias("at"))
    linked = L.event_rows(linked, "corrigendum_linked", {"corrigendum_document_id": s("corrigendum_id"), "criteria_amended": number("n")}, "system", F.col("at"))
    counted = approvals.join(c.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n")), "tender_id", "left").na.fill(0, ["n"])
    approved = L.event_rows(counted, "schema_approved", {"officer_id": s("officer_id"), "criteria_count": number("n")}, F.col("officer_id"), F.col("approved_at"))
    barred = F.col("debarment_status") == "flagged"
    screened = L.event_rows(
        bidders, "debarment_checked",
        {"bidder_id": number("bidder_id"), "company_name": s("company_name"), "is_debarred": json_bool(barred), "check_method": json_string(F.when(barred, "recorded"))},
        "system", F.lit("2024-01-15T00:00:00Z"),
    )
    found = L.event_rows(
        evidence.join(c.select("criterion_id", "criterion_type"), "criterion_id"), "evidence_extracted",
        {"bidder_id": number("bidder_id"), "criterion_id": number("criterion_id"), "criterion_type": s("criterion_type"), "source_document_id": s("source_filename"),
         "extraction_confidence": two(F.col("extraction_confidence")), "entity_match_flag": json_bool(F.col("entity_match_flag"))},
        "system", F.lit("2024-02-01T00:00:00Z"),
    )
    trails = tenders.join(e.groupBy("tender_id").agg(F.count(F.lit(1)).alias("n")), "tender_id", "left").na.fill(0, ["n"])
    report = F.sha2(F.concat(F.lit("report|"), F.col("tender_id").cast("string")), 256)
    reported = L.event_rows(
        trails, "report_generated", {"report_id": json_string(report), "officer_id": json_string(F.lit("officer-0")), "audit_trail_entries": number("n")},
        "officer-0", F.lit("2024-07-01T00:00:00Z"),
    )
    return L.emit_events(received, read, linked, approved, screened, found, verdicts, routed, decided, reported)
