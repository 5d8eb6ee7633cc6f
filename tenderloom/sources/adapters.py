"""Domain tables as plain SQL over the provided star-schema tables.

Each view is ONE SQL text in the dialect that Spark and DuckDB share; placeholders
such as ``{orders}`` name either a provided table or another view.  ``view`` builds
the Spark DataFrame, ``with_views`` puts the same texts in front of an oracle query
as common table expressions, so both sides start from identical inputs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions import patterns as P

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _txt(expr: str) -> str:
    return f"cast({expr} AS string)"


def _letters(salt: str, key: str, start: int, length: int) -> str:
    """Letters derived from a key: md5 hex with the digits mapped to letters."""
    return (
        f"translate(substr(md5(concat('{salt}', {_txt(key)})), {start}, {length}), "
        "'0123456789', 'ghijklmnop')"
    )


def _word(salt: str, key: str) -> str:
    return f"concat(upper({_letters(salt, key, 1, 1)}), {_letters(salt, key, 2, 6)})"


def _suffix(key: str) -> str:
    return (
        f"CASE {key} % 6 WHEN 0 THEN 'Pvt. Ltd.' WHEN 1 THEN 'Private Limited' WHEN 2 THEN 'Ltd.' "
        "WHEN 3 THEN 'Limited' WHEN 4 THEN 'LLP' ELSE 'Corporation' END"
    )


def _company(key: str) -> str:
    """Two invented words, a trade word and a legal suffix."""
    return (
        f"concat({_word('a', key)}, ' ', {_word('b', key)}, ' ', "
        f"CASE {key} % 5 WHEN 0 THEN 'Engg.' WHEN 1 THEN 'Infra' WHEN 2 THEN 'Tech' WHEN 3 THEN 'Const' ELSE 'Works' END, "
        f"' ', {_suffix(key)})"
    )


def _pan(key: str) -> str:
    return f"concat(upper({_letters('p', key, 1, 5)}), lpad({_txt(key + ' % 10000')}, 4, '0'), 'K')"


def _two(expr: str) -> str:
    return f"lpad({_txt(expr)}, 2, '0')"


_CKEY = "(o_orderkey - o_orderkey % 4)"

def _state(expr: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(P.STATES))
    return f"CASE {expr} {whens} ELSE 'UNKNOWN' END"


_TYPE = (
    "CASE p_partkey % 6 WHEN 0 THEN 'numeric_threshold' WHEN 1 THEN 'categorical_presence' "
    "WHEN 2 THEN 'temporal_recency' WHEN 3 THEN 'qualitative_assessment' "
    "WHEN 4 THEN 'numeric_threshold' ELSE 'composite' END"
)

VIEWS: dict[str, str] = {
    "tenders": f"""
        SELECT c_custkey AS tender_id, c_name AS title, c_mktsegment AS department,
               CASE c_custkey % 3 WHEN 0 THEN 'Goods' WHEN 1 THEN 'Services' ELSE 'Works' END AS category,
               {_state('c_custkey % 14')} AS status,
               concat('2024-', {_two('c_custkey % 12 + 1')}, '-', {_two('c_custkey % 28 + 1')}, 'T09:00:00Z') AS created_at
        FROM {{customer}}""",
    "bidders": f"""
        SELECT o_orderkey AS bidder_id, cast(floor(o_orderkey / 10) AS bigint) AS tender_id,
               {_company(_CKEY)} AS company_name,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {_pan(_CKEY)} END AS pan_number,
               concat('27', {_pan(_CKEY)}, '1Z5') AS registration_number,
               CASE WHEN o_orderkey % 17 = 0 THEN 'excluded' WHEN o_orderstatus = 'F' THEN 'evaluated'
                    ELSE 'pending' END AS status,
               CASE WHEN o_orderkey % 23 = 0 THEN 'flagged' ELSE 'clear' END AS debarment_status
        FROM {{orders}}""",
    # Matches by PAN, by name after normalising, by near name, and not at all.
    "debarment_list": f"""
        SELECT s_suppkey AS entry_id,
               CASE s_suppkey % 4
                 WHEN 0 THEN {_company('s_suppkey * 148')}
                 WHEN 1 THEN concat({_word('a', 's_suppkey * 148')}, ' ', {_word('b', 's_suppkey * 148')}, ' ',
                        CASE s_suppkey * 148 % 5 WHEN 0 THEN 'ENGINEERING' WHEN 1 THEN 'infrastructure' WHEN 2 THEN 'technologies'
                             WHEN 3 THEN 'construction' ELSE 'works' END, ' ',
                        CASE WHEN s_suppkey * 148 % 6 = 4 THEN 'LLP' WHEN s_suppkey * 148 % 6 = 5 THEN 'Corp.'
                             ELSE '(India) Private Limited' END)
                 WHEN 2 THEN concat(substr({_word('a', 's_suppkey * 148')}, 1, 6), ' ', {_word('b', 's_suppkey * 148')}, ' ',
                        CASE s_suppkey * 148 % 5 WHEN 0 THEN 'Engineering' WHEN 1 THEN 'Infra' WHEN 2 THEN 'Tech'
                             WHEN 3 THEN 'Const' ELSE 'Works' END, ' ', {_suffix('s_suppkey * 148')})
                 ELSE concat({_word('x', 's_suppkey')}, ' ', {_word('y', 's_suppkey')}, ' Traders') END AS entity_name,
               CASE WHEN s_suppkey % 4 = 0 THEN {_pan('(s_suppkey * 148)')} ELSE NULL END AS pan_number,
               CASE s_suppkey % 3 WHEN 0 THEN 'Forged certificates' WHEN 1 THEN 'Non-performance' ELSE 'Cartel' END AS reason,
               concat('2023-', {_two('s_suppkey % 12 + 1')}, '-15') AS debarment_date,
               concat('Notice ', {_txt('s_nationkey')}) AS source
        FROM {{supplier}}""",
    "criteria": f"""
        SELECT p_partkey AS criterion_id,
               cast(floor(p_partkey * 3 / 4) AS bigint) AS tender_id,
               concat(CASE p_partkey % 6 WHEN 0 THEN 'Annual turnover requirement for ' WHEN 1 THEN 'Valid registration certificate for '
                      WHEN 2 THEN 'Similar works completed for ' WHEN 3 THEN 'Adequate technical capacity for '
                      WHEN 4 THEN 'Net worth requirement for ' ELSE 'Combined requirement for ' END, p_name) AS criterion_text,
               {_TYPE} AS criterion_type,
               concat('4.', {_txt('p_size % 9 + 1')}) AS source_clause_ref,
               CASE WHEN p_partkey % 6 IN (0, 4) THEN cast(floor(p_retailprice) AS bigint) * CASE WHEN p_partkey % 12 = 10 THEN 0 ELSE 50 END
                    ELSE NULL END AS threshold_rupees,
               CASE WHEN p_partkey % 6 = 0 THEN 'turnover' WHEN p_partkey % 6 = 4 THEN 'net worth' ELSE NULL END AS threshold_label,
               CASE WHEN p_partkey % 12 = 10 THEN 5 WHEN p_partkey % 6 IN (0, 4) THEN 0 ELSE NULL END AS threshold_value,
               CASE WHEN p_partkey % 12 = 10 THEN 'lakh' WHEN p_partkey % 6 IN (0, 4) THEN 'rupees' ELSE NULL END AS threshold_unit,
               CASE WHEN p_partkey % 6 = 1 THEN CASE p_partkey % 5 WHEN 0 THEN 'gst registration' WHEN 1 THEN 'pan card'
                    WHEN 2 THEN 'iso 9001' WHEN 3 THEN 'udyam' ELSE 'cin' END ELSE NULL END AS threshold_document,
               CASE WHEN p_partkey % 6 = 2 THEN p_size % 4 + 1 ELSE NULL END AS threshold_count,
               CASE WHEN p_partkey % 6 = 2 THEN '5 years' ELSE NULL END AS threshold_period,
               CASE WHEN p_partkey % 6 IN (0, 2) THEN concat('last ', {_txt('p_size % 5 + 2')}, ' years') ELSE NULL END AS measurement_period,
               p_size % 2 = 0 AS is_mandatory,
               p_size % 3 <> 0 AS gfr_override_permitted,
               CASE WHEN p_size % 3 = 0 THEN 'GFR Rule 173(i)' ELSE NULL END AS gfr_rule_number,
               CASE p_partkey % 7 WHEN 0 THEN 'extracted' WHEN 1 THEN 'reviewed' ELSE 'approved' END AS status
        FROM {{part}}""",
    "evaluations": """
        SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(cast(floor(l_extendedprice) AS bigint) AS string)) AS evaluation_id,
               cast(floor(l_orderkey / 10) AS bigint) AS tender_id,
               l_orderkey AS bidder_id, l_partkey AS criterion_id,
               CASE WHEN l_returnflag = 'R' THEN 'FAIL' WHEN l_returnflag = 'A' THEN 'PASS'
                    WHEN l_linenumber % 2 = 0 THEN 'PASS' ELSE 'REVIEW' END AS verdict,
               round(1 - 6 * l_discount, 6) AS confidence,
               CASE WHEN l_tax < 0.02 THEN 'auto_commit' WHEN l_tax < 0.06 THEN 'hitl_review' ELSE 'mandatory_review' END AS route,
               CASE WHEN l_tax < 0.02 THEN 'auto_committed' WHEN l_linenumber = 1 THEN 'resolved'
                    WHEN l_linenumber = 2 THEN 'pending_second_officer' ELSE 'pending_review' END AS status,
               l_linenumber % 5 = 0 AS entity_match_flag,
               cast(floor(l_extendedprice) AS bigint) AS amount,
               CASE WHEN l_linenumber = 1 AND l_tax >= 0.02 AND l_quantity < 49 THEN CASE WHEN l_quantity < 25 THEN 'confirm' ELSE 'override' END
                    WHEN l_linenumber = 2 AND l_tax >= 0.02 THEN 'override' ELSE NULL END AS officer_decision,
               CASE WHEN l_linenumber <= 2 AND l_tax >= 0.02 THEN concat('officer-', cast(l_suppkey % 5 AS string)) ELSE NULL END AS officer_id,
               concat('B', cast(l_orderkey AS string)) AS source_document_id,
               l_linenumber AS source_page_number,
               concat('{"x":', cast(l_linenumber AS string), ',"y":', cast(l_partkey % 100 AS string), '}') AS source_bbox,
               concat(substr(cast(l_shipdate AS string), 1, 10), 'T10:00:00Z') AS created_at
        FROM {lineitem}""".replace('{"x":', '{{"x":').replace("'}')", "'}}')"),
    # Evidence for recorded cases, one row per order line, every type filled in.
    "evidence": """
        SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(cast(floor(l_extendedprice) AS bigint) AS string)) AS evaluation_id,
               cast(floor(l_orderkey / 10) AS bigint) AS tender_id,
               l_orderkey AS bidder_id, l_partkey AS criterion_id,
               l_linenumber <> 7 AS has_value,
               CASE WHEN l_linenumber IN (6, 7) THEN NULL ELSE cast(floor(l_extendedprice) AS bigint) END AS amount,
               cast(floor(l_extendedprice) AS double) / 4 AS raw_value, 'rupees' AS unit,
               CASE WHEN l_linenumber % 3 = 0 THEN '2023-24' ELSE NULL END AS fiscal_year,
               l_quantity > 10 AS found,
               CASE WHEN l_quantity > 10 THEN concat('REG', cast(l_suppkey AS string)) ELSE NULL END AS registration_number,
               CASE l_partkey % 3 WHEN 0 THEN 'gst' WHEN 1 THEN 'pan' ELSE NULL END AS certificate_type,
               CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE substr(cast(l_shipdate AS string), 1, 10) END AS validity_date,
               CASE WHEN l_linenumber % 4 = 3 THEN NULL ELSE l_returnflag <> 'R' END AS is_valid,
               l_linenumber AS project_count,
               CASE l_suppkey % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'FAIL' END AS model_verdict,
               round(cast(l_quantity / 50 AS double), 6) AS model_confidence,
               CASE l_suppkey % 2 WHEN 0 THEN 'PASS' ELSE 'REVIEW' END AS rules_verdict,
               'partial' AS agreement,
               round(1 - 6 * l_discount, 6) AS extraction_confidence,
               round(1 - 5 * l_discount, 6) AS ocr_confidence,
               CASE WHEN l_linenumber = 7 THEN 'none' ELSE 'deterministic' END AS evaluation_method,
               l_linenumber % 5 = 0 AS entity_match_flag,
               concat('Registered ', cast(l_suppkey AS string)) AS registered_name,
               concat('Seen ', cast(l_suppkey AS string)) AS extracted_name,
               CASE WHEN l_linenumber % 2 = 1 THEN l_linenumber ELSE NULL END AS source_page_number,
               CASE WHEN l_linenumber % 3 = 1 THEN concat('bid_', cast(l_orderkey AS string), '.pdf') ELSE NULL END AS source_filename
        FROM {lineitem}""",
    # Officer decisions on evaluations, several per case now and then, some invalid on purpose.
    "decisions": """
        SELECT concat(evaluation_id, CASE WHEN criterion_id % 41 = 0 THEN 'x' ELSE '' END) AS evaluation_id,
               concat(evaluation_id, '/1') AS decision_id,
               CASE criterion_id % 9 WHEN 0 THEN 'maybe' WHEN 1 THEN 'override' WHEN 2 THEN 'override' WHEN 3 THEN 'override' ELSE 'confirm' END AS decision,
               concat('officer-', cast(amount % 7 AS string)) AS officer_id,
               CASE WHEN criterion_id % 9 = 1 THEN NULL WHEN criterion_id % 9 = 2 THEN 'equivalent evidence' WHEN criterion_id % 9 = 3 THEN '  '
                    ELSE 'accepted' END AS reason,
               concat(substr(created_at, 1, 10), 'T12:00:00Z') AS decided_at
        FROM {evaluations}
        UNION ALL
        SELECT evaluation_id, concat(evaluation_id, '/2') AS decision_id,
               CASE criterion_id % 4 WHEN 0 THEN 'override' WHEN 1 THEN 'maybe' ELSE 'confirm' END AS decision,
               concat('officer-', cast(amount % 5 AS string)) AS officer_id, 'second look' AS reason,
               concat(substr(created_at, 1, 10), CASE WHEN amount % 2 = 0 THEN 'T11:00:00Z' ELSE 'T13:00:00Z' END) AS decided_at
        FROM {evaluations} WHERE amount % 3 = 0""",
    "second_decisions": """
        SELECT concat(cast(l_orderkey AS string), '-', cast(l_linenumber AS string), '-', cast(l_partkey AS string), '-', cast(l_suppkey AS string), '-', cast(cast(floor(l_extendedprice) AS bigint) AS string)) AS evaluation_id,
               concat('officer-', cast(l_partkey % 5 AS string)) AS officer_id,
               CASE l_partkey % 6 WHEN 0 THEN 'reject' WHEN 1 THEN 'later' ELSE 'approve' END AS decision,
               concat(substr(cast(l_shipdate AS string), 1, 10), 'T15:00:00Z') AS decided_at
        FROM {lineitem}""",
    # One page per criterion plus every prose document as a page of its own.
    "nit_pages": f"""
        SELECT concat('N', {_txt('cast(floor(p_partkey * 3 / 4) AS bigint)')}) AS document_id,
               cast(floor(p_partkey * 3 / 4) AS bigint) AS tender_id,
               p_partkey AS page_number, cast(0.95 AS double) AS ocr_confidence,
               concat('4.', {_txt('p_partkey % 9 + 1')}, CASE WHEN p_partkey % 4 = 0 THEN '(a)' ELSE '' END,
                 CASE p_partkey % 3 WHEN 0 THEN ' - ' WHEN 1 THEN ' ' ELSE '. ' END,
                 CASE p_partkey % 8
                   WHEN 0 THEN concat('The bidder shall have annual turnover of not less than Rs. ', {_txt('p_size')}, ' (Five) Crore in the last 3 financial years and a valid GST registration certificate.')
                   WHEN 1 THEN concat('Positive net worth of Rs ', {_txt('p_size')}, '.50 lakh. EMD of Rs. 2,50,000 thousand shall be furnished. Mandatory under GFR Rule 173(i).')
                   WHEN 2 THEN concat({_txt('p_size % 7 + 1')}, ' similar supply orders in the last 5 years. PAN card and permanent account number required.')
                   WHEN 3 THEN 'The firm shall demonstrate adequate manufacturing capacity and good standing.'
                   WHEN 4 THEN concat('Average turnover minimum of INR ', {_txt('p_size')}, '.25 cr. and ISO 9001:2015 certification. As amended by corrigendum, refer addendum.')
                   WHEN 5 THEN 'Three completed civil works in the preceding 24 months; operational experience of 6 years. Shop and establishment certificate, MSME registration, Udyam certificate.'
                   WHEN 6 THEN concat('Single work order value Rs. ', {_txt('p_size')}, ' crore. Banker''s certificate and EPF, ESI.', chr(10), 'The pre-qualification bid security of Rs. 3 lakh applies.')
                   ELSE 'Delivery within thirty days at the consignee site.' END,
                 chr(10), 'Item: ', p_name) AS raw_text
        FROM {{part}}
        UNION ALL
        SELECT concat('X', {_txt('doc_id')}) AS document_id, cast(-1 AS bigint) AS tender_id, cast(1 AS bigint) AS page_number,
               cast(0.95 AS double) AS ocr_confidence, text AS raw_text
        FROM {{documents}}""",
    "amendments": f"""
        SELECT cast(floor(p_partkey * 3 / 4) AS bigint) AS tender_id,
               concat('C', {_txt('p_partkey % 2')}, '-', {_txt('cast(floor(p_partkey * 3 / 4) AS bigint)')}) AS corrigendum_id,
               concat('2024-03-0', {_txt('p_partkey % 2 + 1')}, 'T08:00:00Z') AS uploaded_at,
               p_partkey AS ord,
               CASE WHEN p_size % 2 = 0 THEN concat('4.', {_txt('p_size % 9 + 1')}) ELSE '9.9' END AS clause_ref,
               {_TYPE} AS criterion_type,
               cast(floor(p_retailprice) AS bigint) * 60 AS amended_rupees,
               CASE WHEN p_partkey % 6 = 1 THEN CASE p_size % 3 WHEN 0 THEN 'iso 9001' WHEN 1 THEN 'udyam' ELSE 'pan card' END ELSE NULL END AS amended_document,
               CASE WHEN p_partkey % 6 IN (2, 5) THEN p_size % 6 + 1 ELSE NULL END AS amended_count,
               CASE WHEN p_partkey % 6 = 2 THEN concat({_txt('p_size % 5 + 2')}, ' years') ELSE NULL END AS amended_period,
               CASE WHEN p_partkey % 16 = 0 THEN 'Scope revised' ELSE NULL END AS reason,
               round(cast(p_size AS double) / 100, 6) AS confidence
        FROM {{part}}
        UNION ALL
        SELECT cast(floor(p_partkey * 3 / 4) AS bigint) AS tender_id,
               concat('C2-', {_txt('cast(floor(p_partkey * 3 / 4) AS bigint)')}) AS corrigendum_id,
               '2024-04-01T08:00:00Z' AS uploaded_at,
               p_partkey AS ord, concat('4.', {_txt('p_partkey % 9 + 1')}) AS clause_ref, {_TYPE} AS criterion_type,
               cast(floor(p_retailprice) AS bigint) * 70 AS amended_rupees,
               CASE WHEN p_partkey % 6 = 1 THEN CASE p_size % 3 WHEN 0 THEN 'iso 9001' WHEN 1 THEN 'udyam' ELSE 'pan card' END ELSE NULL END AS amended_document,
               CASE WHEN p_partkey % 6 IN (2, 5) THEN p_size % 6 + 1 ELSE NULL END AS amended_count,
               CASE WHEN p_partkey % 6 = 2 THEN concat({_txt('p_size % 5 + 2')}, ' years') ELSE NULL END AS amended_period, 'Second notice' AS reason,
               cast(0.5 AS double) AS confidence
        FROM {{part}}""",
    # Letterhead page from the order, one project page per order line.
    "bid_pages": f"""
        SELECT concat('B', {_txt('o_orderkey')}) AS document_id, cast(floor(o_orderkey / 10) AS bigint) AS tender_id,
               o_orderkey AS bidder_id, CASE WHEN o_orderkey % 3 = 0 THEN 'certificate' ELSE 'bidder_submission' END AS doc_type,
               concat(substr(cast(o_orderdate AS string), 1, 10), 'T07:00:00Z') AS uploaded_at, cast(0 AS bigint) AS page_number,
               round(cast(0.4 AS double) + cast(o_orderkey % 60 AS double) / 100, 6) AS ocr_confidence,
               concat(
                 CASE WHEN o_orderkey % 13 = 5 THEN 'Bid documents' WHEN o_orderkey % 11 = 3 THEN concat('M/s ', {_company('(o_orderkey + 1)')})
                      WHEN o_orderkey % 11 = 4 THEN concat('Submitted by ', {_company(_CKEY)}) ELSE concat('M/s ', {_company(_CKEY)}) END, chr(10),
                 CASE WHEN o_orderkey % 9 = 4 THEN 'Registration papers follow' ELSE concat('PAN: ', {_pan(_CKEY)}, ' GSTIN: 27', {_pan(_CKEY)}, '1Z5') END, chr(10),
                 CASE o_orderkey % 6 WHEN 0 THEN 'Certified ISO 9001:2015 works. ' WHEN 1 THEN 'UDYAM-MH-12-0012345 holder. ' WHEN 2 THEN 'CIN L12345MH2001PLC123456. '
                      ELSE 'TAN MUMA12345B. ' END, chr(10),
                 CASE WHEN o_orderkey % 7 = 3 THEN 'Annual turnover for FY 2023-24: Rs. ' ELSE 'Annual turnover for FY 2023-24: Rs. ' END, {_txt('cast(floor(o_totalprice / 10000) AS bigint)')}, '.', {_two('o_orderkey % 100')},
                 CASE o_orderkey % 4 WHEN 0 THEN ' Crore.' WHEN 1 THEN ' Lakh.' WHEN 2 THEN '.' ELSE ' cr in 2022/2023.' END, chr(10),
                 CASE WHEN o_orderkey % 5 = 1 THEN 'Net worth stands at 45.50 lakh. ' WHEN o_orderkey % 5 = 2 THEN 'Net worth: INR 7,50,000 (FY 22-23). ' ELSE '' END, chr(10),
                 CASE o_orderkey % 8 WHEN 0 THEN 'No expiry stated.' WHEN 1 THEN concat('Valid up to ', {_two('o_orderkey % 28 + 1')}, '-', {_two('o_orderkey % 12 + 1')}, '-', {_txt('2023 + o_orderkey % 4')}, '.')
                      WHEN 2 THEN 'Validity: 31 December 2027.' WHEN 3 THEN 'Expires on 2025-02-30 or June 2026.' WHEN 4 THEN 'Dated 05/06/2024.'
                      ELSE concat('valid till ', {_two('o_orderkey % 28 + 1')}, '.', {_two('o_orderkey % 12 + 1')}, '.', {_txt('2024 + o_orderkey % 3')}) END) AS raw_text
        FROM {{orders}}
        UNION ALL
        SELECT concat('B', {_txt('l_orderkey')}) AS document_id, cast(floor(l_orderkey / 10) AS bigint) AS tender_id,
               l_orderkey AS bidder_id, CASE WHEN l_orderkey % 3 = 0 THEN 'certificate' ELSE 'bidder_submission' END AS doc_type,
               '' AS uploaded_at, l_linenumber * cast(1000000000 AS bigint) + l_partkey AS page_number,
               round(cast(0.4 AS double) + l_quantity / 100, 6) AS ocr_confidence,
               CASE WHEN l_linenumber = 4 THEN '' ELSE
                 concat('Supply order ', {_txt('l_partkey')}, ' to depot',
                   CASE WHEN l_linenumber % 2 = 0 THEN ' - Rs. ' ELSE ': ' END, {_txt('cast(floor(l_quantity) AS bigint)')},
                   CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE '.5 Lakh' END, ' completed ', substr(cast(l_shipdate AS string), 1, 10)) END AS raw_text
        FROM {{lineitem}}""",
    # Tables found in two files of each bidder, the later one first by name: a header row (0) and one row per
    # order line. Three bidders in four have tables that list no projects.
    "bid_table_rows": f"""
        SELECT o_orderkey AS bidder_id, cast(floor(o_orderkey / 10) AS bigint) AS tender_id,
               concat('B', {_txt('o_orderkey')}) AS document_id, '2024-01-01T07:00:00Z' AS uploaded_at, 1 AS page_number, 0 AS table_index, cast(0 AS bigint) AS row_index,
               CASE WHEN o_orderkey % 4 = 0 THEN 'Nature of work' ELSE 'Remarks' END AS cell_1, 'Order Value' AS cell_2, 'Date of completion' AS cell_3
        FROM {{orders}}
        UNION ALL
        SELECT o_orderkey AS bidder_id, cast(floor(o_orderkey / 10) AS bigint) AS tender_id,
               concat('A', {_txt('o_orderkey')}) AS document_id, '2024-02-01T07:00:00Z' AS uploaded_at, 1 AS page_number, 0 AS table_index, cast(0 AS bigint) AS row_index,
               CASE WHEN o_orderkey % 4 = 0 THEN 'Nature of work' ELSE 'Remarks' END AS cell_1, 'Order Value' AS cell_2, 'Date of completion' AS cell_3
        FROM {{orders}}
        UNION ALL
        SELECT l_orderkey AS bidder_id, cast(floor(l_orderkey / 10) AS bigint) AS tender_id,
               concat(CASE WHEN l_linenumber % 2 = 0 THEN 'B' ELSE 'A' END, {_txt('l_orderkey')}) AS document_id,
               CASE WHEN l_linenumber % 2 = 0 THEN '2024-01-01T07:00:00Z' ELSE '2024-02-01T07:00:00Z' END AS uploaded_at, 1 AS page_number, 0 AS table_index, l_linenumber * cast(1000000000 AS bigint) + l_partkey AS row_index,
               CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber IN (4, 5) AND l_orderkey % 4 = 0 THEN 'Annual turnover' ELSE concat('Supply lot ', {_txt('l_partkey')}) END AS cell_1,
               CASE WHEN l_linenumber = 2 THEN '' WHEN l_linenumber = 6 THEN concat('Rs. ', {_txt('cast(floor(l_quantity) AS bigint)')})
                    ELSE concat('Rs. ', {_txt('cast(floor(l_quantity) AS bigint)')}, ' lakh') END AS cell_2,
               CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 6 THEN 'ongoing' ELSE substr(cast(l_shipdate AS string), 1, 10) END AS cell_3
        FROM {{lineitem}}""",
    # Uploads: prose documents of twenty sources, with names that pass or fail the checks.
    "uploads": f"""
        SELECT concat('U', {_txt('doc_id')}) AS upload_id, doc_id AS doc_key, source AS tender_ref,
               concat('file_', {_txt('doc_id')}, CASE doc_id % 10 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.png'
                      WHEN 4 THEN '.jpeg' WHEN 5 THEN '.tiff' WHEN 6 THEN '.exe' WHEN 7 THEN '' WHEN 8 THEN '.pdf.zip' ELSE '.bmp' END) AS filename,
               CASE doc_id % 6 WHEN 0 THEN 'nit' WHEN 1 THEN 'corrigendum' WHEN 2 THEN 'bidder_submission' WHEN 3 THEN 'certificate'
                    WHEN 4 THEN 'nit' ELSE 'invoice' END AS doc_type,
               concat('2024-01-', {_two('doc_id % 28 + 1')}, 'T00:00:00Z') AS uploaded_at,
               CASE doc_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'error' ELSE 'complete' END AS processing_status,
               text
        FROM {{documents}}""",
    # Pages of the prose documents: every line is a page text.
    "text_pages": f"""
        SELECT concat('P', {_txt('page_id')}) AS page_id, concat('D', {_txt('page_id % 20')}) AS document_id,
               page_id AS page_number, html AS raw_text,
               CASE page_id % 3 WHEN 0 THEN 'docx' WHEN 1 THEN 'pdf' ELSE 'image' END AS doc_format,
               CASE WHEN page_id % 7 = 0 THEN ' ' ELSE html END AS embedded_text,
               CASE WHEN page_id % 11 = 0 THEN NULL ELSE round(cast(page_id % 100 AS double) / 100, 6) END AS ocr_confidence
        FROM {{pages}}""",
    # OCR engine rows: one per conversation turn, confidence -1 marks layout rows.
    "ocr_rows": f"""
        SELECT conv_id AS page_id, turn AS word_no, CASE WHEN turn % 7 = 6 THEN '  ' ELSE concat(' ', text, ' ') END AS text,
               CASE WHEN turn % 5 = 4 THEN cast(-1 AS double) ELSE cast((conv_id * 7 + turn * 13) % 101 AS double) END AS conf,
               cast(turn * 50 AS double) AS left_px, cast(conv_id % 40 AS double) AS top_px,
               cast(40 AS double) AS width_px, cast(14 AS double) AS height_px
        FROM {{conversations}}""",
    "ledger_events": """
        SELECT event_id, user_id AS tender_id,
               CASE event_type WHEN 'click' THEN 'verdict_computed' WHEN 'view' THEN 'evidence_extracted' WHEN 'purchase' THEN 'officer_decision'
                    WHEN 'error' THEN 'case_routed' ELSE 'document_received' END AS event_type,
               CASE WHEN event_id % 97 = 0 THEN 'not json'
                    WHEN event_id % 3 = 0 THEN concat('{"bidder_id":"bidder-', cast(event_id AS string), '","criterion_id":"crit-', cast(user_id AS string), '-long","verdict":"PASS"}')
                    WHEN event_id % 3 = 1 THEN concat('{"decision":"confirm","officer_id":"officer-', cast(user_id AS string), '"}')
                    ELSE concat('{"k":', cast(event_id % 100 AS string), '}') END AS event_data,
               CASE WHEN event_id % 4 = 0 THEN concat('officer-', cast(user_id % 9 AS string)) ELSE 'system' END AS actor,
               concat(replace(substr(cast(ts AS string), 1, 19), ' ', 'T'), '.', lpad(cast(event_id % 1000 AS string), 3, '0'), 'Z') AS ts_text
        FROM {events}""".replace('{"', '{{"').replace('"}', '"}}').replace("'}')", "'}}')"),
    "precedents": f"""
        SELECT concat('Q', {_txt('item_id')}) AS precedent_id, text AS criterion_text,
               concat('Read as ', text) AS resolved_interpretation,
               {{seg}} AS department,
               CASE item_id % 3 WHEN 0 THEN 'Goods' WHEN 1 THEN 'Services' ELSE 'Works' END AS tender_category,
               'PASS' AS verdict, 'confirm' AS officer_action
        FROM {{benchmark}}
        UNION ALL
        SELECT concat('R', {_txt('c.conv_id')}, '-', {_txt('c.turn')}) AS precedent_id, c.text AS criterion_text,
               concat('Read as ', c.text) AS resolved_interpretation,
               {{seg2}} AS department,
               CASE c.turn % 3 WHEN 0 THEN 'Goods' WHEN 1 THEN 'Services' ELSE 'Works' END AS tender_category,
               CASE WHEN c.turn % 2 = 0 THEN 'PASS' ELSE 'FAIL' END AS verdict,
               CASE WHEN c.turn % 4 = 0 THEN 'override' ELSE 'confirm' END AS officer_action
        FROM {{conversations}} c
        UNION ALL
        SELECT concat('S', {_txt('p_partkey')}) AS precedent_id,
               concat(CASE p_partkey % 4 WHEN 0 THEN 'Annual turnover requirement for ' WHEN 1 THEN 'Valid certificate required for '
                      WHEN 2 THEN 'Completed similar works of ' ELSE 'Technical capacity needed for ' END, p_name) AS criterion_text,
               concat('Accepted with ', p_type, ' evidence for ', p_name) AS resolved_interpretation,
               {{seg4}} AS department,
               CASE p_partkey % 3 WHEN 0 THEN 'Goods' WHEN 1 THEN 'Services' ELSE 'Works' END AS tender_category,
               'PASS' AS verdict, 'confirm' AS officer_action
        FROM {{part}}""",
    # Query texts for precedent search: whole prose documents with a scope.
    "precedent_queries": f"""
        SELECT doc_id AS query_id, text AS query_text,
               {{seg3}} AS department,
               CASE doc_id % 3 WHEN 0 THEN 'Goods' WHEN 1 THEN 'Services' ELSE 'Works' END AS category
        FROM {{documents}}""",
    "precedent_vecs": """
        SELECT vec_id AS precedent_id, label AS scope, embedding FROM {embeddings} WHERE vec_id % 2 = 0""",
    "query_vecs": """
        SELECT vec_id AS query_id, label AS scope, embedding FROM {embeddings} WHERE vec_id % 2 = 1""",
    # Vectors of criteria, and three chunks of each bid.
    "criterion_vecs": """
        SELECT p.p_partkey AS criterion_id, e.label AS scope, e.embedding
        FROM {part} p CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) s JOIN {embeddings} e ON e.vec_id = p.p_partkey % s.n""",
    "bid_chunk_vecs": """
        SELECT o.o_orderkey AS bidder_id, k.chunk_no, e.embedding
        FROM {orders} o CROSS JOIN (VALUES (0), (1), (2)) AS k(chunk_no) CROSS JOIN (SELECT count(*) AS n FROM {embeddings}) s
        JOIN {embeddings} e ON e.vec_id = (o.o_orderkey * 7 + k.chunk_no * 13) % s.n""",
    # The recorded model answers: a user turn and the reply that follows it.
    "response_log": """
        SELECT u.conv_id AS tender_id, u.turn AS turn, sha256(u.text) AS prompt_hash, a.text AS response,
               CASE WHEN u.conv_id % 10 = 0 AND u.turn > 0 THEN 'model-b' ELSE 'model-a' END AS model_version,
               concat('2024-05-01T00:', lpad(cast(u.turn AS string), 2, '0'), ':00Z-', lpad(cast(u.conv_id AS string), 9, '0')) AS logged_at
        FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "prompts": """
        SELECT conv_id, turn, text AS prompt, sha256(text) AS prompt_hash FROM {conversations}""",
    "transition_requests": f"""
        SELECT o_orderkey AS request_id, o_custkey + CASE WHEN o_orderkey % 50 = 0 THEN 100000000 ELSE 0 END AS tender_id,
               {_state('(o_custkey % 14 + 1 + CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 7 ELSE 0 END) % 14')} AS target_status,
               substr(cast(o_orderdate AS string), 1, 10) AS requested_on
        FROM {{orders}}""",
    "edits": f"""
        SELECT p_partkey AS edit_id, p_partkey + CASE WHEN p_partkey % 31 = 0 THEN 1000000000 ELSE 0 END AS criterion_id,
               CASE p_partkey % 4 WHEN 0 THEN concat('Reworded requirement for ', p_name) ELSE NULL END AS criterion_text,
               CASE p_partkey % 5 WHEN 0 THEN 'composite' WHEN 1 THEN 'bogus_type' ELSE NULL END AS criterion_type,
               CASE p_partkey % 3 WHEN 0 THEN cast(p_size AS bigint) * 1000 ELSE NULL END AS threshold_rupees,
               CASE WHEN p_partkey % 7 = 0 THEN p_size % 2 = 0 ELSE NULL END AS is_mandatory,
               CASE WHEN p_partkey % 11 = 0 THEN p_size % 3 = 0 ELSE NULL END AS gfr_override_permitted,
               CASE WHEN p_partkey % 13 = 0 THEN concat('last ', {_txt('p_size % 4 + 1')}, ' financial years') ELSE NULL END AS measurement_period,
               concat('officer-', {_txt('p_size % 4')}) AS officer_id
        FROM {{part}}""",
    "approvals": f"""
        SELECT c_custkey + CASE WHEN c_custkey % 40 = 0 THEN 1000000000 ELSE 0 END AS tender_id,
               concat('officer-', {_txt('c_nationkey')}) AS officer_id, '2024-06-01T00:00:00Z' AS approved_at
        FROM {{customer}}""",
    # A second run of the same cases in which a few fields moved.
    "rerun": """
        SELECT bidder_id, criterion_id, evaluation_id,
               CASE WHEN amount % 101 = 0 THEN 'REVIEW' ELSE verdict END AS verdict,
               CASE WHEN amount % 103 = 0 THEN round(confidence + 0.01, 6) ELSE confidence END AS confidence,
               CASE WHEN amount % 107 = 0 THEN 'hitl_review' ELSE route END AS route,
               source_document_id, source_page_number,
               CASE WHEN amount % 109 = 0 THEN NULL ELSE source_bbox END AS source_bbox
        FROM {evaluations}""",
}


def _segment(key: str) -> str:
    return (
        f"CASE {key} % 5 WHEN 0 THEN 'AUTOMOBILE' WHEN 1 THEN 'BUILDING' WHEN 2 THEN 'FURNITURE' "
        "WHEN 3 THEN 'HOUSEHOLD' ELSE 'MACHINERY' END"
    )


VIEWS["precedents"] = VIEWS["precedents"].replace("{seg}", _segment("item_id")).replace("{seg2}", _segment("(c.conv_id + c.turn)")).replace("{seg4}", _segment("p_partkey"))
VIEWS["precedent_queries"] = VIEWS["precedent_queries"].replace("{seg3}", _segment("doc_id"))

_PLACEHOLDER = re.compile(r"(?<!\{)\{([a-z_]+)\}(?!\})")


def _sources_of(name: str) -> list[str]:
    return sorted(set(_PLACEHOLDER.findall(VIEWS[name])))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A provided table, read as is."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view (or a provided table) as a DataFrame."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    sources = {s: view(spark, sf_dir, s) for s in _sources_of(name)}
    sql = VIEWS[name] if name != "response_log" and name != "prompts" else VIEWS[name].replace("sha256(", "sha2x(")
    sql = re.sub(r"sha2x\(([a-z.]+)\)", r"sha2(\1, 256)", sql)
    return spark.sql(sql, **sources)


def with_views(names: str, sql: str) -> str:
    """``sql`` preceded by the common table expressions of the named views."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in VIEWS and name not in ordered:
            for source in _sources_of(name):
                visit(source)
            ordered.append(name)

    for name in names.split():
        visit(name)
    ctes = [
        f"{name} AS ({_PLACEHOLDER.sub(lambda m: m.group(1), VIEWS[name]).replace('{{', '{').replace('}}', '}')})"
        for name in ordered
    ]
    body = sql.strip()
    if not ctes:
        return body
    head = "WITH "
    if body.startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", body[len("WITH RECURSIVE ") :]
    elif body.startswith("WITH "):
        body = body[len("WITH ") :]
    else:
        return head + ",\n".join(ctes) + "\n" + body
    return head + ",\n".join([*ctes, body])
