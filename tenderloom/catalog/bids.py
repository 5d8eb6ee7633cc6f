"""Evidence, entity, debarment and full evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bidtext as B
from ..functions import patterns as P
from ..operators import branches as X
from ..operators import entity as G
from ..operators import evaluate as E
from ..operators import evidence as V
from ..operators import qualitative as Q
from ..plans import evaluation as plans
from ..sources import files
from ..sources.adapters import view
from . import documents as docs
from . import duck as D
from . import search
from .registry import query

AS_OF = "2025-06-01"
_BID = docs._BID_TEXT


def bid_documents(spark, d):
    return docs.bid_documents(spark, d)


def bid_tables(spark, d):
    rows = view(spark, d, "bid_table_rows")
    return rows.withColumn("cells", F.array("cell_1", "cell_2", "cell_3")).drop("cell_1", "cell_2", "cell_3")


_NUM_COLUMNS = "amount, raw_value, unit, fiscal_year, num_confidence AS confidence"


@query(
    "F1_extract_numeric",
    "bid_pages",
    f"WITH {_BID}, {D.numeric_value_ctes('bid_text', 'text', 'nv')} SELECT document_id, {_NUM_COLUMNS} FROM nv",
)
def extract_numeric(spark, d):
    rows = bid_documents(spark, d).select("document_id", B.numeric_value(F.col("text")).alias("n"))
    return rows.select("document_id", "n.amount", "n.raw_value", "n.unit", "n.fiscal_year", "n.confidence")


@query("F1_numeric_of_pages", "bid_pages", f"WITH {D.numeric_value_ctes('bid_pages', 'raw_text', 'nv')} SELECT document_id, page_number, raw_text, {_NUM_COLUMNS} FROM nv")
def numeric_of_pages(spark, d):
    rows = view(spark, d, "bid_pages").select("document_id", "page_number", "raw_text", B.numeric_value(F.col("raw_text")).alias("n"))
    return rows.select("document_id", "page_number", "raw_text", "n.amount", "n.raw_value", "n.unit", "n.fiscal_year", "n.confidence")


@query("F2_fiscal_year", "bid_pages", f"WITH {_BID} SELECT document_id, {D.fiscal_year('text')} AS fiscal_year FROM bid_text")
def fiscal_year(spark, d):
    return bid_documents(spark, d).select("document_id", B.fiscal_year(F.col("text")).alias("fiscal_year"))


_TERMS = """terms AS (SELECT tender_id, criterion_id, unnest(CASE WHEN len(known) > 0 THEN known WHEN hint <> '' THEN [hint] ELSE ['turnover'] END) AS term FROM (
    SELECT tender_id, criterion_id, hint, list_distinct(list_concat(
        CASE WHEN contains(hint, 'turnover') OR contains(ct, 'turnover') THEN ['turnover', 'total income', 'revenue'] ELSE [] END,
        CASE WHEN contains(hint, 'net worth') OR contains(ct, 'net worth') THEN ['net worth'] ELSE [] END,
        CASE WHEN contains(hint, 'emd') OR contains(hint, 'bid security') OR contains(ct, 'earnest') THEN ['emd', 'bid security', 'earnest money'] ELSE [] END,
        CASE WHEN contains(hint, 'work') OR contains(hint, 'contract') OR contains(hint, 'project') THEN ['order value', 'contract value', 'amount'] ELSE [] END)) AS known
    FROM (SELECT tender_id, criterion_id, lower(coalesce(threshold_label, '')) AS hint, lower(criterion_text) AS ct FROM criteria WHERE criterion_type = 'numeric_threshold')))"""


@query("F6_numeric_terms", "criteria", f"WITH {_TERMS} SELECT tender_id, criterion_id, term FROM terms")
def numeric_terms(spark, d):
    return V.criterion_terms(view(spark, d, "criteria"))


_ROWS = """lines AS (SELECT tender_id, bidder_id, uploaded_at, document_id, page_number, table_index, row_index, concat(trim(cell_1), ' ', trim(cell_2), ' ', trim(cell_3)) AS line FROM bid_table_rows),
    tt AS (SELECT DISTINCT tender_id, term FROM terms)"""
_MATCHED = f"""{_TERMS}, {_ROWS}, {D.numeric_value_ctes('lines', 'line', 'ln')},
    hits AS (SELECT ln.*, tt.term FROM ln JOIN tt ON ln.tender_id = tt.tender_id WHERE contains(lower(line), term))"""


@query(
    "F3_search_table_rows",
    "bid_table_rows criteria",
    f"WITH {_MATCHED} SELECT document_id, row_index, term, amount, CASE WHEN amount IS NULL THEN 0.7 ELSE 0.85 END AS confidence FROM hits",
)
def search_table_rows(spark, d):
    rows = V.search_table_rows(bid_tables(spark, d), V.criterion_terms(view(spark, d, "criteria")))
    return rows.select("document_id", "row_index", "term", F.col("numeric.amount").alias("amount"), "confidence")


@query(
    "F4_best_table_numeric",
    "bid_table_rows criteria",
    f"""WITH {_MATCHED} SELECT bidder_id, term, amount, document_id FROM hits WHERE amount IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY bidder_id, term ORDER BY uploaded_at, document_id, num_confidence DESC, page_number, table_index, row_index, amount, raw_value) = 1""",
)
def best_table_numeric(spark, d):
    rows = V.best_table_numeric(V.search_table_rows(bid_tables(spark, d), V.criterion_terms(view(spark, d, "criteria"))))
    return rows.select("bidder_id", "term", "best.numeric.amount", "best.document_id")


_CHUNKS = f"""cut AS (SELECT tender_id, bidder_id, uploaded_at, document_id, string_split(regexp_replace(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)) AS parts FROM bid_text),
    chunks AS (SELECT tender_id, bidder_id, uploaded_at, document_id, i AS chunk_no, parts[i] AS chunk FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM cut)),
    {D.numeric_value_ctes('chunks', 'chunk', 'cn')}, ct AS (SELECT DISTINCT tender_id, term FROM terms),
    scoped AS (SELECT bidder_id, term, amount, raw_value, unit, fiscal_year, num_confidence FROM cn JOIN ct ON cn.tender_id = ct.tender_id WHERE amount IS NOT NULL AND contains(lower(chunk), term)
        QUALIFY row_number() OVER (PARTITION BY bidder_id, term ORDER BY num_confidence DESC, uploaded_at, document_id, chunk_no) = 1)"""


@query("F5_scoped_numeric", "bid_pages criteria", f"WITH {_BID}, {_TERMS}, {_CHUNKS} SELECT bidder_id, term, amount, num_confidence AS confidence FROM scoped")
def scoped_numeric(spark, d):
    rows = V.scoped_numeric(bid_documents(spark, d), V.criterion_terms(view(spark, d, "criteria")))
    return rows.select("bidder_id", "term", "best.numeric.amount", "best.numeric.confidence")


@query("F7_first_iso_date", "bid_pages", f"SELECT document_id, page_number, raw_text, {D.first_date('raw_text')} AS iso_date FROM bid_pages")
def first_iso_date(spark, d):
    return view(spark, d, "bid_pages").select("document_id", "page_number", "raw_text", B.first_iso_date(F.col("raw_text")).alias("iso_date"))


_CUE = f"regexp_matches(text, {D.q(P.VALIDITY_CUE)})"
_VALID_DATE = f"coalesce(CASE WHEN {_CUE} THEN {D.first_date(D.group('text', P.VALIDITY_CUE, 1))} END, {D.first_date('text')})"


@query(
    "F8_validity_date",
    "bid_pages",
    f"""WITH {_BID}, v AS (SELECT document_id, {_VALID_DATE} AS validity_date, CASE WHEN {_CUE} THEN 0.85 ELSE 0.7 END AS c FROM bid_text)
    SELECT document_id, validity_date, validity_date > '{AS_OF}' AS is_valid, CASE WHEN validity_date IS NOT NULL THEN c END AS confidence FROM v""",
)
def validity_date(spark, d):
    rows = bid_documents(spark, d).select("document_id", B.validity(F.col("text"), AS_OF).alias("v"))
    return rows.select("document_id", F.col("v.date").alias("validity_date"), "v.is_valid", "v.confidence")


_REGS = ", ".join(f"{D.registration('text', k)} AS reg_{k}" for k in P.REGISTRATION_PATTERNS)


@query("F9_registration_number", "bid_pages", f"WITH {_BID} SELECT document_id, {_REGS} FROM bid_text")
def registration_number(spark, d):
    numbers = B.registration_numbers(F.col("text"))
    return bid_documents(spark, d).select("document_id", *[v.alias(f"reg_{k}") for k, v in numbers.items()])


@query("F10_company_name", "bid_pages", f"WITH {_BID} SELECT document_id, {D.company_name('text')} AS company_name FROM bid_text")
def company_name(spark, d):
    return bid_documents(spark, d).select("document_id", B.company_name(F.col("text")).alias("company_name"))


_TABLE_PROJECTS = f"""pr AS (SELECT bidder_id, uploaded_at, document_id, row_index, trim(cell_1) AS description, trim(cell_2) AS vtext, trim(cell_3) AS dtext FROM bid_table_rows b WHERE row_index > 0 AND trim(cell_1) <> ''
        AND EXISTS (SELECT 1 FROM bid_table_rows h WHERE h.document_id = b.document_id AND h.row_index = 0 AND h.cell_1 = 'Nature of work')),
    {D.numeric_value_ctes('pr', 'vtext', 'pn')},
    table_projects AS (SELECT bidder_id, uploaded_at, document_id, row_index, description, amount, {D.first_date('dtext')} AS completion_date FROM pn)"""
_PC = "round(0.55 + CASE WHEN amount IS NULL THEN 0.0 ELSE 0.2 END + CASE WHEN completion_date IS NULL THEN 0.0 ELSE {w} END, 2)"


@query(
    "F11_projects_from_tables",
    "bid_table_rows",
    f"WITH {_TABLE_PROJECTS} SELECT document_id, row_index, description, amount, completion_date, {_PC.format(w='0.15')} AS confidence FROM table_projects",
)
def projects_from_tables(spark, d):
    rows = V.projects_from_tables(bid_tables(spark, d))
    return rows.select("document_id", "row_index", "description", "amount", "completion_date", "confidence")


_PAT = P.PROJECT_IN_PROSE
_PROSE = f"""pz AS (SELECT document_id, bidder_id, uploaded_at, i AS project_no, regexp_replace({D.collapse('dd[i]')}, '^[ \\-:–|]+|[ \\-:–|]+$', '', 'g') AS description, try_cast(replace(vv[i], ',', '') AS double) AS raw, uu[i] AS u, tt[i] AS dtext
        FROM (SELECT *, unnest(range(1, len(dd) + 1)) AS i FROM (SELECT *, {D.all_groups('text', _PAT, 1)} AS dd, {D.all_groups('text', _PAT, 2)} AS vv, {D.all_groups('text', _PAT, 3)} AS uu, {D.all_groups('text', _PAT, 4)} AS tt FROM bid_text))),
    prose_projects AS (SELECT document_id, bidder_id, uploaded_at, project_no, description, CASE WHEN raw IS NULL THEN NULL WHEN u <> '' THEN {D.to_rupees('raw', 'u')} ELSE cast(round_even(raw, 0) AS bigint) END AS amount, {D.first_date('dtext')} AS completion_date
        FROM pz WHERE description <> '')"""


@query(
    "F12_projects_from_prose",
    "bid_pages",
    f"WITH {_BID}, {_PROSE} SELECT document_id, description, amount, completion_date, {_PC.format(w='0.1')} AS confidence FROM prose_projects",
)
def projects_from_prose(spark, d):
    rows = bid_documents(spark, d).select("document_id", F.explode(B.prose_projects(F.col("text"))).alias("p"))
    return rows.select("document_id", "p.description", "p.amount", "p.completion_date", "p.confidence")


@query("F13_infer_cert_type", "criteria", f"SELECT criterion_id, {D.cert_type('threshold_document', 'criterion_text')} AS cert_type FROM criteria")
def infer_cert_type(spark, d):
    return view(spark, d, "criteria").select("criterion_id", B.infer_cert_type(F.col("threshold_document"), F.col("criterion_text")).alias("cert_type"))


@query(
    "F14_source_document",
    "bid_pages",
    f"""WITH {_BID} SELECT bidder_id, min_by(document_id, (doc_type <> 'bidder_submission', uploaded_at, document_id)) AS submission_id,
        min_by(document_id, (doc_type <> 'certificate', uploaded_at, document_id)) AS certificate_id FROM bid_text GROUP BY bidder_id""",
)
def source_document(spark, d):
    return V.bidder_profile(V.document_facts(bid_documents(spark, d)), AS_OF).select("bidder_id", "submission_id", "certificate_id")


def pairs(spark, d):
    """Pairs of open bidders and approved criteria, before debarment."""
    return E.evaluation_pairs(view(spark, d, "bidders"), view(spark, d, "criteria"))


def _profile(spark, d):
    facts = V.document_facts(bid_documents(spark, d))
    return facts, V.bidder_profile(facts, AS_OF)


# In the bid data a bidder has one file, so the profile of a bidder is that of the file.
_PAIRS = """pairs AS (SELECT b.bidder_id, b.company_name, c.* EXCLUDE (status) FROM bidders b JOIN criteria c ON b.tender_id = c.tender_id WHERE b.status <> 'excluded' AND c.status = 'approved')"""
_NUMERIC_EVIDENCE = f"""{_BID}, {_MATCHED}, {_CHUNKS}, {D.numeric_value_ctes('bid_text', 'text', 'nv')},
    tbest AS (SELECT bidder_id, term, amount, raw_value, unit, fiscal_year, num_confidence, uploaded_at, document_id, page_number, table_index, row_index FROM hits WHERE amount IS NOT NULL),
    options AS (SELECT p.bidder_id, p.criterion_id, 0 AS stage, concat(t.uploaded_at, t.document_id) AS k1, -t.num_confidence AS low, t.row_index AS n, t.amount, t.num_confidence, t.document_id, t.page_number FROM pairs p JOIN terms x ON x.criterion_id = p.criterion_id JOIN tbest t ON t.bidder_id = p.bidder_id AND t.term = x.term
        UNION ALL SELECT p.bidder_id, p.criterion_id, 1, '', -s.num_confidence, 0, s.amount, s.num_confidence, NULL, NULL FROM pairs p JOIN terms x ON x.criterion_id = p.criterion_id JOIN (
            SELECT cn.bidder_id, ct.term, cn.* EXCLUDE (bidder_id) FROM cn JOIN ct ON cn.tender_id = ct.tender_id WHERE amount IS NOT NULL AND contains(lower(chunk), ct.term)) s ON s.bidder_id = p.bidder_id AND s.term = x.term
            QUALIFY row_number() OVER (PARTITION BY p.bidder_id, p.criterion_id ORDER BY s.num_confidence DESC, s.uploaded_at, s.document_id, s.chunk_no) = 1),
    best AS (SELECT * FROM options QUALIFY row_number() OVER (PARTITION BY bidder_id, criterion_id ORDER BY stage, k1, low, n, amount) = 1),
    numeric_evidence AS (SELECT p.bidder_id, p.criterion_id, coalesce(b.amount, nv.amount) AS amount, coalesce(b.document_id, nv.document_id) AS source_document_id, cast(b.page_number AS bigint) AS source_page_number,
        CASE WHEN coalesce(b.amount, nv.amount) IS NULL THEN nv.mean_confidence ELSE least(coalesce(b.num_confidence, nv.num_confidence), greatest(nv.mean_confidence, 0.5)) END AS ocr_confidence
        FROM pairs p JOIN nv ON nv.bidder_id = p.bidder_id LEFT JOIN best b ON b.bidder_id = p.bidder_id AND b.criterion_id = p.criterion_id WHERE p.criterion_type = 'numeric_threshold')"""


@query(
    "F15_numeric_evidence",
    "bid_pages bid_table_rows bidders criteria",
    f"WITH {_PAIRS}, {_NUMERIC_EVIDENCE} SELECT bidder_id, criterion_id, amount, source_document_id, source_page_number, round(ocr_confidence, 6) AS ocr_confidence FROM numeric_evidence",
)
def numeric_evidence(spark, d):
    cases = pairs(spark, d).where(F.col("criterion_type") == "numeric_threshold")
    documents = files.kept(docs.bid_documents(spark, d, cases))
    profile = V.bidder_profile(V.document_facts(documents), AS_OF)
    rows = V.numeric_evidence(cases, profile, documents, bid_tables(spark, d))
    return rows.select("bidder_id", "criterion_id", "amount", "source_document_id", "source_page_number", F.round("ocr_confidence", 6).alias("ocr_confidence"))


_CATEGORICAL = f"""{_BID}, cats AS (SELECT p.bidder_id, p.criterion_id, {D.cert_type('threshold_document', 'criterion_text')} AS certificate_type FROM pairs p WHERE criterion_type = 'categorical_presence'),
    regs AS (SELECT bidder_id, document_id, mean_confidence, {_REGS}, {_VALID_DATE} AS vd FROM bid_text),
    cat_ev AS (SELECT c.*, CASE certificate_type WHEN 'gst' THEN reg_gst WHEN 'pan' THEN reg_pan WHEN 'cin' THEN reg_cin WHEN 'tan' THEN reg_tan WHEN 'udyam' THEN reg_udyam WHEN 'iso' THEN reg_iso END AS registration_number,
        r.vd, r.mean_confidence, r.document_id FROM cats c JOIN regs r ON r.bidder_id = c.bidder_id)"""


@query(
    "F16_categorical_evidence",
    "bid_pages bidders criteria",
    f"""WITH {_PAIRS}, {_CATEGORICAL} SELECT bidder_id, criterion_id, registration_number IS NOT NULL AS found, registration_number, CASE WHEN registration_number IS NOT NULL THEN vd END AS validity_date,
        CASE WHEN registration_number IS NULL THEN false ELSE vd > '{AS_OF}' END AS is_valid, certificate_type,
        round(CASE WHEN registration_number IS NULL THEN mean_confidence ELSE least(CASE WHEN vd IS NULL THEN 0.6 ELSE 0.9 END, greatest(mean_confidence, 0.5)) END, 6) AS ocr_confidence FROM cat_ev""",
)
def categorical_evidence(spark, d):
    _, profile = _profile(spark, d)
    rows = V.categorical_evidence(pairs(spark, d), profile)
    return rows.select("bidder_id", "criterion_id", "found", "registration_number", "validity_date", "is_valid", "certificate_type", F.round("ocr_confidence", 6).alias("ocr_confidence"))


_TEMPORAL = f"""{_BID}, {_TABLE_PROJECTS}, {_PROSE},
    tc AS (SELECT bidder_id, count(*) AS n, count_if(amount IS NOT NULL AND completion_date IS NOT NULL) AS rich FROM table_projects GROUP BY 1),
    pc AS (SELECT bidder_id, count(*) AS n, count_if(amount IS NOT NULL AND completion_date IS NOT NULL) AS rich FROM prose_projects GROUP BY 1),
    tmp_ev AS (SELECT p.bidder_id, p.criterion_id, coalesce(tc.n, pc.n, 0) AS project_count, coalesce(CASE WHEN tc.n > 0 THEN tc.rich END, pc.rich, 0) AS rich, coalesce(threshold_count, 2) AS required, t.mean_confidence
        FROM pairs p JOIN bid_text t ON t.bidder_id = p.bidder_id LEFT JOIN tc ON tc.bidder_id = p.bidder_id LEFT JOIN pc ON pc.bidder_id = p.bidder_id WHERE criterion_type = 'temporal_recency')"""


@query(
    "F17_temporal_evidence",
    "bid_pages bid_table_rows bidders criteria",
    f"""WITH {_PAIRS}, {_TEMPORAL} SELECT bidder_id, criterion_id, project_count, round(CASE WHEN project_count > 0 THEN least(CASE WHEN rich >= required THEN 0.9 ELSE 0.7 END, greatest(mean_confidence, 0.5))
        ELSE mean_confidence END, 6) AS ocr_confidence FROM tmp_ev""",
)
def temporal_evidence(spark, d):
    facts, profile = _profile(spark, d)
    rows = V.temporal_evidence(pairs(spark, d), profile, facts, bid_tables(spark, d))
    return rows.select("bidder_id", "criterion_id", "project_count", F.round("ocr_confidence", 6).alias("ocr_confidence"))


# Answers recorded for the prompts of wording cases: none, a newer one after an older one, fenced, in running text, or unusable.
_ANSWER_BODY = """concat('{{"verdict": "', CASE {salt} % 3 WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'FAIL' END, '", "confidence": 0.', CAST({salt} % 9 + 1 AS {text}), ', "reasoning": "',
    CASE WHEN criterion_id % 4 = 0 THEN '' ELSE concat('Answer about case ', CAST({salt} % 97 AS {text})) END, '", "factors": ["model factor ', CAST({salt} % 5 AS {text}), '"]}}')"""
_ANSWER_TEXT = """CASE bidder_id % 7 WHEN 1 THEN concat('```json', chr(10), {body}, chr(10), '```') WHEN 2 THEN concat('The answer is ', {body}, ' as asked.') WHEN 3 THEN 'no answer' ELSE {body} END"""


def _answer(text: str, salt: str = "(bidder_id + criterion_id)") -> str:
    return _ANSWER_TEXT.format(body=_ANSWER_BODY.format(salt=salt, text=text))


def answer_log(spark, d):
    """A response log of wording cases, in versions: the first, and a second that answers one bidder's prompts anew."""
    cases = wording_cases(spark, d).where("bidder_id % 5 <> 0")
    asked = cases.withColumn("prompt_hash", X.prompt_hash(F.lit(Q.PROMPT_TYPE), Q.prompt_of(F.col("criterion_text"), F.col("company_name"), F.col("bidder_id"))))
    entry = lambda rows, text, at, version: rows.select("prompt_hash", F.expr(text).alias("response"), F.lit("model-a").alias("model_version"), F.lit(at).alias("logged_at"), F.lit(version).alias("version"))
    older = entry(asked.where("bidder_id % 5 = 1"), "'{\"verdict\": \"FAIL\", \"confidence\": 0.99}'", "2024-05-01T00:00:00Z", 1)
    newer = entry(asked, _answer("STRING"), "2024-05-02T00:00:00Z", 1)
    anew = entry(asked.where("bidder_id % 100 = 12"), "'{\"verdict\": \"PASS\", \"confidence\": 0.123}'", "2024-05-03T00:00:00Z", 2)
    return older.unionByName(newer).unionByName(anew)


def wording_cases(spark, d):
    return pairs(spark, d).where(F.col("criterion_type") == "qualitative_assessment")


def assessments(spark, d, version=1):
    """Both branches for wording criteria: vectors of the bid, and the answers logged up to a version."""
    log = Q.log_at(answer_log(spark, d), version)
    return Q.assess(wording_cases(spark, d), view(spark, d, "criterion_vecs"), view(spark, d, "bid_chunk_vecs"), view(spark, d, "precedent_vecs"), log)


_SIMILAR = """cases AS (SELECT * FROM pairs WHERE criterion_type = 'qualitative_assessment'),
    dsims AS (SELECT c.bidder_id, c.criterion_id, max(round(list_dot_product(k.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)) AS ds
        FROM cases c JOIN criterion_vecs v ON v.criterion_id = c.criterion_id JOIN bid_chunk_vecs k ON k.bidder_id = c.bidder_id GROUP BY ALL),
    psims AS (SELECT v.criterion_id, p.precedent_id, round(list_dot_product(v.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS ps
        FROM criterion_vecs v JOIN precedent_vecs p ON p.scope = v.scope QUALIFY row_number() OVER (PARTITION BY v.criterion_id ORDER BY ps DESC, p.precedent_id) = 1),
    meant AS (SELECT c.bidder_id, c.criterion_id, coalesce(ds, 0.0) AS ds, coalesce(ps, 0.0) AS ps, precedent_id FROM cases c LEFT JOIN dsims d ON d.bidder_id = c.bidder_id AND d.criterion_id = c.criterion_id LEFT JOIN psims p ON p.criterion_id = c.criterion_id),
    ruled AS (SELECT *, CASE WHEN ds >= 0.55 AND ps >= 0.55 THEN 'PASS' ELSE 'REVIEW' END AS rules_verdict, greatest(0.0, least(1.0, 0.5 * ds + 0.5 * ps)) AS rc FROM meant)"""
_OPINIONS = f"""{_BID}, {_SIMILAR},
    heard AS (SELECT *, bidder_id % 5 <> 0 AND bidder_id % 7 <> 3 AS said, (bidder_id + criterion_id) % 3 AS vote, (bidder_id + criterion_id) % 9 + 1 AS tenths FROM ruled),
    opinion AS (SELECT *, CASE WHEN said THEN CASE vote WHEN 0 THEN 'PASS' WHEN 1 THEN 'REVIEW' ELSE 'FAIL' END END AS branch_verdict, CASE WHEN said THEN tenths::DOUBLE / 10 ELSE 0.0 END AS mc FROM heard),
    voted AS (SELECT *, coalesce(branch_verdict, 'REVIEW') AS model_verdict FROM opinion),
    said AS (SELECT *, {search._AGREE} AS agreement, {search._CONSENSUS} AS verdict FROM voted),
    weighed AS (SELECT *, CASE WHEN mc = 0 THEN rc WHEN rc = 0 THEN mc * 0.8 WHEN agreement = 'agree' THEN round(least(1.0, sqrt(rc * mc) + 0.1), 3) WHEN agreement = 'disagree' THEN round(least(rc, mc) * 0.7, 3)
        ELSE round((rc + mc) / 2, 3) END AS confidence,
        CASE WHEN said AND criterion_id % 4 <> 0 THEN concat('Answer about case ', (bidder_id + criterion_id) % 97)
            ELSE concat('Semantic analysis: criterion↔document similarity: ', {D.two('ds')}, '. Rules-LLM ', agreement, '. Routing to officer review.') END AS reasoning,
        concat(CASE WHEN said THEN concat('model factor ', (bidder_id + criterion_id) % 5, '; ') ELSE '' END, 'criterion↔document similarity: ', {D.two('ds')}, '; best precedent similarity: ', {D.two('ps')},
            CASE WHEN precedent_id IS NOT NULL THEN concat('; top precedent: ', precedent_id) ELSE '' END) AS factors FROM said)"""
_VECS = "criterion_vecs bid_chunk_vecs precedent_vecs"


@query(
    "E15_qualitative_path",
    f"bid_pages bidders criteria {_VECS}",
    f"""WITH {_PAIRS}, {_OPINIONS} SELECT bidder_id, criterion_id, round(ds, 6) AS document_similarity, round(ps, 6) AS precedent_similarity, rules_verdict, branch_verdict, agreement, verdict,
        round(confidence, 3) AS confidence, reasoning, factors FROM weighed""",
)
def qualitative_path(spark, d):
    """The whole path of wording cases: vectors, precedents, logged answers, consensus."""
    return assessments(spark, d).select(
        "bidder_id", "criterion_id", F.round("document_similarity", 6).alias("document_similarity"), F.round("precedent_similarity", 6).alias("precedent_similarity"), "rules_verdict", "branch_verdict",
        "agreement", "verdict", F.round("confidence", 3).alias("confidence"), "reasoning", F.array_join("factors", "; ").alias("factors"),
    )


@query(
    "F18_qualitative_evidence",
    f"bid_pages bidders criteria {_VECS}",
    f"""WITH {_PAIRS}, {_OPINIONS} SELECT p.bidder_id, p.criterion_id, w.verdict AS model_verdict, w.mc AS model_confidence, w.agreement, w.reasoning,
        round(least(greatest(w.confidence, 0.3), greatest(coalesce(t.mean_confidence, 0.0), 0.3)), 6) AS ocr_confidence
    FROM cases p JOIN weighed w ON w.bidder_id = p.bidder_id AND w.criterion_id = p.criterion_id LEFT JOIN bid_text t ON t.bidder_id = p.bidder_id""",
)
def qualitative_evidence(spark, d):
    _, profile = _profile(spark, d)
    rows = V.qualitative_evidence(pairs(spark, d), profile, assessments(spark, d))
    return rows.select("bidder_id", "criterion_id", "model_verdict", "model_confidence", "agreement", "reasoning", F.round("ocr_confidence", 6).alias("ocr_confidence"))


_FACTOR = D.case("criterion_type", P.TYPE_CONFIDENCE_FACTORS, "1.0")


@query(
    "F19_extraction_confidence",
    "evidence criteria",
    f"""SELECT evaluation_id, round(CASE WHEN ocr_confidence <= 0 THEN 0.0 ELSE greatest(0.0, least(1.0, ocr_confidence * CASE WHEN entity_match_flag THEN 0.5 ELSE 1.0 END * {_FACTOR})) END, 6) AS extraction_confidence
    FROM evidence e JOIN criteria c ON e.criterion_id = c.criterion_id""",
)
def extraction_confidence(spark, d):
    rows = view(spark, d, "evidence").join(view(spark, d, "criteria").select("criterion_id", "criterion_type"), "criterion_id")
    conf = V.extraction_confidence(F.col("ocr_confidence"), F.col("criterion_type"), F.col("entity_match_flag"))
    return rows.select("evaluation_id", F.round(conf, 6).alias("extraction_confidence"))


def all_evidence(spark, d):
    return V.extract_evidence(pairs(spark, d), bid_documents(spark, d), bid_tables(spark, d), assessments(spark, d), as_of=AS_OF, keep=files.kept)


@query("F20_extract_evidence")
def extract_evidence(spark, d):
    return all_evidence(spark, d).select(
        "tender_id", "bidder_id", "criterion_id", "criterion_type", "has_value", "amount", "found", "project_count", "model_verdict", "extracted_name",
        F.round("similarity_score", 6).alias("similarity_score"), "mismatch_type", "entity_match_flag", F.round("extraction_confidence", 6).alias("extraction_confidence"),
    )


# --- G: entities --------------------------------------------------------------------------


@query("G1_normalise_company", "bidders debarment_list", f"SELECT company_name, {D.normalise_company('company_name')} AS name, count(*) AS n FROM (SELECT company_name FROM bidders UNION ALL SELECT entity_name FROM debarment_list) GROUP BY ALL")
def normalise_company(spark, d):
    rows = view(spark, d, "bidders").select("company_name").unionByName(view(spark, d, "debarment_list").select(F.col("entity_name").alias("company_name")))
    counted = rows.groupBy("company_name").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("company_name", B.normalise_company(F.col("company_name")).alias("name"), "n")


def _names(spark, d):
    bids = view(spark, d, "bidders").select(B.normalise_company(F.col("company_name")).alias("name"))
    listed = view(spark, d, "debarment_list").select(B.normalise_company(F.col("entity_name")).alias("name"))
    return bids, listed


@query("G2_similar_names")
def similar_names(spark, d):
    bids, listed = _names(spark, d)
    return G.similar_names(bids, listed, keep=files.kept).select("a", "b", F.round("score", 6).alias("score"))


def registered_and_extracted(spark, d):
    facts = bid_documents(spark, d).select("bidder_id", B.company_name(F.col("text")).alias("extracted_name"))
    rows = view(spark, d, "bidders").select("bidder_id", "company_name").join(facts, "bidder_id")
    return rows.withColumn("extracted_name", F.when(F.length("extracted_name") > 0, F.col("extracted_name")).otherwise(F.col("company_name")))


@query("G3_match_entity")
def match_entity(spark, d):
    rows = G.match_entity(registered_and_extracted(spark, d), "company_name", "extracted_name")
    return rows.withColumn("similarity_score", F.round("similarity_score", 6))


@query(
    "G6_equal_names_skip_disambiguation",
    "bid_pages bidders",
    f"""WITH {_BID}, j AS (SELECT b.bidder_id, b.company_name, coalesce(nullif({D.company_name('text')}, ''), b.company_name) AS ex FROM bidders b JOIN bid_text t ON t.bidder_id = b.bidder_id)
    SELECT bidder_id, {D.normalise_company('company_name')} <> {D.normalise_company('ex')} AND lower(ex) <> lower(company_name) AS needs FROM j""",
)
def needs_disambiguation(spark, d):
    rows = registered_and_extracted(spark, d)
    equal = B.normalise_company(F.col("company_name")) == B.normalise_company(F.col("extracted_name"))
    score = F.when(equal, 1.0).otherwise(0.0)  # only whether the names are equal matters here
    return rows.select("bidder_id", G.needs_disambiguation(F.col("company_name"), F.col("extracted_name"), score).alias("needs"))


_EXACT = f"""pan AS (SELECT b.bidder_id, l.entry_id, 'pan_match' AS check_method FROM bidders b JOIN debarment_list l ON b.pan_number = l.pan_number),
    same AS (SELECT b.bidder_id, l.entry_id, 'name_match' AS check_method FROM bidders b JOIN debarment_list l ON {D.normalise_company('b.company_name')} = {D.normalise_company('l.entity_name')}
        WHERE b.bidder_id NOT IN (SELECT bidder_id FROM pan)), exact AS (SELECT * FROM pan UNION ALL SELECT * FROM same)"""


@query("G4_debarment_exact", "bidders debarment_list", f"WITH {_EXACT} SELECT bidder_id, entry_id, check_method FROM exact")
def debarment_exact(spark, d):
    """Matches at threshold 1: equal PAN, else equal names."""
    return G.debarment_matches(view(spark, d, "bidders"), view(spark, d, "debarment_list"), threshold=1.0, keep=files.kept)


def debarment(spark, d):
    bidders = view(spark, d, "bidders")
    return bidders, G.debarment_check(bidders, G.debarment_matches(bidders, view(spark, d, "debarment_list"), keep=files.kept))


@query("G4_debarment_check")
def debarment_check(spark, d):
    return debarment(spark, d)[1]


def _exact_checked(spark, d):
    bidders = view(spark, d, "bidders")
    return bidders, G.debarment_check(bidders, G.debarment_matches(bidders, view(spark, d, "debarment_list"), threshold=1.0, keep=files.kept))


_CHECKED = f"""{_EXACT}, f AS (SELECT bidder_id, min(check_method) AS m, count(*) AS n, min(entry_id) AS e FROM exact GROUP BY 1)"""


@query(
    "G7_debarment_report",
    "bidders debarment_list",
    f"WITH {_CHECKED} SELECT tender_id, count(*) AS checked, count(f.n) AS flagged, count(*) - count(f.n) AS clear FROM bidders b LEFT JOIN f ON f.bidder_id = b.bidder_id GROUP BY tender_id",
)
def debarment_report(spark, d):
    return G.debarment_report(_exact_checked(spark, d)[1])


@query(
    "G8_bidder_debarment",
    "bidders debarment_list",
    f"""WITH {_CHECKED} SELECT b.bidder_id, b.company_name, b.debarment_status AS status, CASE WHEN b.debarment_status = 'flagged' THEN l.entity_name END AS matched_entity,
        CASE WHEN b.debarment_status = 'flagged' THEN l.reason END AS reason, CASE WHEN b.debarment_status = 'flagged' THEN coalesce(f.n, 0) END AS match_count
    FROM bidders b LEFT JOIN f ON f.bidder_id = b.bidder_id LEFT JOIN debarment_list l ON l.entry_id = f.e""",
)
def bidder_debarment(spark, d):
    bidders, checked = _exact_checked(spark, d)
    return G.bidder_debarment(bidders, checked, view(spark, d, "debarment_list"))


@query(
    "G9_mark_bidders",
    "bidders debarment_list",
    f"""WITH {_CHECKED} SELECT b.bidder_id, CASE WHEN f.n IS NOT NULL THEN 'flagged' ELSE 'clear' END AS debarment_status,
        CASE WHEN b.status = 'excluded' OR f.n IS NOT NULL THEN 'excluded' ELSE 'evaluated' END AS status FROM bidders b LEFT JOIN f ON f.bidder_id = b.bidder_id""",
)
def mark_bidders(spark, d):
    return G.mark_bidders(*_exact_checked(spark, d)).select("bidder_id", "debarment_status", "status")


_MODEL_OPINION = "CASE bidder_id % 6 WHEN 0 THEN 'same_entity' WHEN 1 THEN 'parent_company' WHEN 2 THEN 'subsidiary' WHEN 3 THEN 'abbreviation' WHEN 4 THEN 'unknown' ELSE NULL END"


@query(
    "G5_entity_consensus",
    "evidence",
    f"""WITH r AS (SELECT evaluation_id, extraction_confidence AS s, {_MODEL_OPINION} AS kind, bidder_id % 11 = 0 AS fraud, CASE WHEN bidder_id % 6 < 5 THEN model_confidence ELSE 0.0 END AS m FROM evidence),
    k AS (SELECT *, coalesce(kind, 'unknown') IN ('parent_company', 'subsidiary', 'unrelated') AS apart, CASE WHEN s >= 0.85 AND coalesce(kind, 'unknown') IN ('parent_company', 'subsidiary', 'unrelated') THEN 'disagree' ELSE 'agree' END AS agreement FROM r)
    SELECT evaluation_id, s < 0.85 OR fraud OR apart AS consensus_review, s >= 0.85 AND NOT fraud AS consensus_match,
        CASE WHEN coalesce(kind, 'unknown') IN ('same_entity', 'abbreviation') THEN 'different_entity' ELSE coalesce(kind, 'unknown') END AS consensus_type, agreement,
        CASE WHEN m = 0 THEN s WHEN s = 0 THEN m * 0.8 WHEN agreement = 'agree' THEN round(least(1.0, sqrt(s * m) + 0.1), 3) ELSE round(least(s, m) * 0.7, 3) END AS consensus_confidence FROM k""",
)
def entity_consensus(spark, d):
    rows = view(spark, d, "evidence").select(
        "evaluation_id", F.col("extraction_confidence").alias("similarity_score"), (F.col("extraction_confidence") >= 0.85).alias("is_match"),
        (F.col("extraction_confidence") < 0.85).alias("requires_review"), F.lit("different_entity").alias("mismatch_type"),
        F.expr(_MODEL_OPINION).alias("classification"), (F.col("bidder_id") % 11 == 0).alias("fraud_risk"),
        F.when(F.col("bidder_id") % 6 < 5, F.col("model_confidence")).otherwise(0.0).alias("model_confidence"),
    )
    return G.entity_consensus(rows).select("evaluation_id", "consensus_review", "consensus_match", "consensus_type", "agreement", "consensus_confidence")


# --- H12: everything ------------------------------------------------------------------------


def full_run(spark, d, version=1):
    return plans.evaluate_all(
        view(spark, d, "bidders"), view(spark, d, "criteria"), bid_documents(spark, d), view(spark, d, "debarment_list"), view(spark, d, "precedents"),
        bid_tables(spark, d), assessments(spark, d, version), as_of=AS_OF, keep=files.kept,
    )


def rerun(spark, d, then, now):
    """Two runs of everything over the given tables, with the answers logged up to one version and up to another."""
    run = lambda version: full_run(spark, d, version).cases
    return plans.reproduce_run(run, then, now, keep=files.kept)


# Names whose ratio reaches the threshold: matched letters are those of the longest common run, the first one in either name, and of what lies
# before and after it, again and again. Letters that both names have at all bound the ratio from above.
_ALIKE = f"""nl AS (SELECT DISTINCT {D.normalise_company('company_name')} AS a FROM bidders), nr AS (SELECT DISTINCT {D.normalise_company('entity_name')} AS b FROM debarment_list),
    near AS (SELECT a, b FROM nl, nr WHERE a <> b AND 2.0 * least(length(a), length(b)) >= {P.NAME_MATCH_THRESHOLD} * (length(a) + length(b))
        AND 2.0 * list_sum([least(length(a) - length(replace(a, c, '')), length(b) - length(replace(b, c, ''))) for c in list_distinct(string_split(a, ''))]) >= {P.NAME_MATCH_THRESHOLD} * (length(a) + length(b))),
    runs AS (SELECT a, b, a AS x, b AS y, list_filter(flatten([[substr(a, i, k) for i in range(1, length(a) - k + 2)] for k in range(length(a), 0, -1)]), lambda s: contains(b, s))[1] AS run FROM near
        UNION ALL SELECT a, b, x, y, list_filter(flatten([[substr(x, i, k) for i in range(1, length(x) - k + 2)] for k in range(length(x), 0, -1)]), lambda s: contains(y, s))[1] AS run
        FROM (SELECT a, b, unnest([substr(x, 1, strpos(x, run) - 1), substr(x, strpos(x, run) + length(run))]) AS x, unnest([substr(y, 1, strpos(y, run) - 1), substr(y, strpos(y, run) + length(run))]) AS y
            FROM runs WHERE run IS NOT NULL) WHERE x <> '' AND y <> ''),
    alike AS (SELECT a, b FROM runs GROUP BY a, b HAVING 2.0 * sum(length(run)) / (length(a) + length(b)) >= {P.NAME_MATCH_THRESHOLD})"""


@query(
    "N6_rerun",
    "bidders criteria debarment_list",
    f"""WITH RECURSIVE {_EXACT}, {_PAIRS}, {_ALIKE} SELECT tender_id, count(*) AS total, count(*) AS matches, 0 AS differences, true AS match, true AS identical FROM pairs
    WHERE bidder_id NOT IN (SELECT bidder_id FROM exact) AND coalesce({D.normalise_company('company_name')}, '') NOT IN (SELECT a FROM alike) GROUP BY tender_id""",
)
def rerun_identical(spark, d):
    """A rerun with the recorded answers gives every case again."""
    return rerun(spark, d, 1, 1).select("tender_id", "total", "matches", "differences", "match", "identical")


@query("H12_evaluate_all")
def evaluate_all(spark, d):
    return full_run(spark, d).cases.select(
        "evaluation_id", "tender_id", "bidder_id", "criterion_id", "criterion_type", "verdict", F.round("confidence", 6).alias("confidence"), "route",
        "route_reason", "status", "headline", "detail", "reasoning",
    )


@query("H12_evaluation_summary")
def evaluation_summary(spark, d):
    return full_run(spark, d).summary
