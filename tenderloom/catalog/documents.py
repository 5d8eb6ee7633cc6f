"""Intake, criteria extraction and amendment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import patterns as P
from ..functions.common import to_rupees, word_to_int
from ..operators import amend as M
from ..operators import criteria as X
from ..operators import evidence as V
from ..operators import ingest as A
from ..operators import report as R
from ..operators import views as B
from ..sources.adapters import view
from . import duck as D
from .registry import query

# --- A: intake -------------------------------------------------------------------------


def hashed_uploads(spark, d):
    return A.ingest_documents(view(spark, d, "uploads"), "text")


@query("A1_ingest_documents", "uploads", "SELECT upload_id, tender_ref, doc_type, filename, sha256(text) AS sha256_hash FROM uploads")
def ingest_documents(spark, d):
    return hashed_uploads(spark, d).select("upload_id", "tender_ref", "doc_type", "filename", "sha256_hash")


@query(
    "A2_dedupe_documents",
    "uploads",
    """WITH h AS (SELECT upload_id, doc_key, tender_ref, uploaded_at, sha256(text) AS sha256_hash FROM uploads),
    old AS (SELECT DISTINCT tender_ref, sha256_hash FROM h WHERE doc_key IN (SELECT doc_id FROM labels WHERE toxic = 1))
    SELECT tender_ref, sha256_hash, upload_id, uploaded_at FROM h WHERE (tender_ref, sha256_hash) NOT IN (SELECT (tender_ref, sha256_hash) FROM old)
    QUALIFY row_number() OVER (PARTITION BY tender_ref, sha256_hash ORDER BY uploaded_at, upload_id) = 1""",
)
def dedupe_documents(spark, d):
    rows = hashed_uploads(spark, d)
    known = view(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("doc_key"))
    kept = A.dedupe_documents(rows, rows.join(known, "doc_key", "left_semi"), "tender_ref")
    return kept.select("tender_ref", "sha256_hash", "upload_id", "uploaded_at")


_EXT = "regexp_extract(lower(filename), '\\.([a-z0-9]+)$', 1)"
_OK_EXT = "('pdf','docx','png','jpg','jpeg','tif','tiff','bmp')"


@query(
    "A3_validate_upload",
    "uploads",
    f"""SELECT upload_id, filename, doc_type, CASE WHEN {_EXT} NOT IN {_OK_EXT} THEN 'INVALID_FILE_TYPE'
        WHEN doc_type NOT IN ('nit','corrigendum','bidder_submission','certificate') THEN 'INVALID_DOC_TYPE' END AS code FROM uploads""",
)
def validate_upload(spark, d):
    return A.validate_upload(view(spark, d, "uploads")).select("upload_id", "filename", "doc_type", "code")


_FORMAT = f"CASE WHEN {_EXT} = 'pdf' THEN 'pdf' WHEN {_EXT} = 'docx' THEN 'docx' WHEN {_EXT} IN ('png','jpg','jpeg','tif','tiff','bmp') THEN 'image' ELSE 'unknown' END"


@query("A4_detect_format", "uploads", f"SELECT upload_id, {_FORMAT} AS doc_format FROM uploads")
def detect_format(spark, d):
    return view(spark, d, "uploads").select("upload_id", A.detect_format(F.col("filename")).alias("doc_format"))


_STRIPPED = D.strip("coalesce(embedded_text, '')")
_SCANNED = f"SELECT document_id, sum(length({_STRIPPED})) / count(*) AS avg_chars, sum(length({_STRIPPED})) / count(*) < 50 AS is_scanned FROM text_pages GROUP BY document_id"
_WORDS = f"""SELECT page_id, word_no, {D.strip('text')} AS text_content, left_px AS x_min, top_px AS y_min, left_px + width_px AS x_max, top_px + height_px AS y_max,
    round(conf / 100, 4) AS confidence FROM ocr_rows WHERE {D.strip('text')} <> '' AND conf >= 0"""


@query("A5_classify_scanned", "text_pages", f"SELECT document_id, round(avg_chars, 4) AS avg_chars, is_scanned FROM ({_SCANNED})")
def classify_scanned(spark, d):
    return A.classify_scanned(view(spark, d, "text_pages")).select("document_id", F.round("avg_chars", 4).alias("avg_chars"), "is_scanned")


_CHOSEN = f"""words AS ({_WORDS}),
    ocr AS (SELECT concat('P', page_id) AS page_id, string_agg(text_content, ' ' ORDER BY word_no, text_content) AS ocr_text,
        sum(length(text_content) * confidence) / sum(length(text_content)) AS pc FROM words GROUP BY page_id),
    chosen AS (SELECT p.page_id, p.document_id, p.page_number, p.doc_format,
        CASE WHEN p.doc_format = 'docx' OR (p.doc_format = 'pdf' AND {_STRIPPED} <> '' AND NOT s.is_scanned) THEN embedded_text ELSE coalesce(ocr_text, '') END AS raw_text,
        CASE WHEN p.doc_format = 'docx' OR (p.doc_format = 'pdf' AND {_STRIPPED} <> '' AND NOT s.is_scanned) THEN 0.95 ELSE coalesce(pc, 0.0) END AS page_confidence
        FROM text_pages p LEFT JOIN ({_SCANNED}) s ON p.document_id = s.document_id LEFT JOIN ocr ON ocr.page_id = p.page_id)"""


def ocr_words(spark, d):
    return A.clean_ocr_rows(view(spark, d, "ocr_rows"))


def chosen_pages(spark, d):
    pages = view(spark, d, "text_pages")
    words = ocr_words(spark, d).withColumn("page_id", F.concat(F.lit("P"), F.col("page_id").cast("string")))
    return A.choose_page_text(pages, A.classify_scanned(pages), words)


@query("A6_choose_page_text", "text_pages ocr_rows", f"WITH {_CHOSEN} SELECT page_id, doc_format, raw_text, round(page_confidence, 6) AS page_confidence FROM chosen")
def choose_page_text(spark, d):
    return chosen_pages(spark, d).select("page_id", "doc_format", "raw_text", F.round("page_confidence", 6).alias("page_confidence"))


@query("A7_layout_words")
def layout_words(spark, d):
    pages = view(spark, d, "documents").select(F.col("doc_id").cast("string").alias("page_id"), F.col("text").alias("raw_text"))
    return A.layout_words(pages)


@query(
    "A8_page_confidence",
    "ocr_rows",
    f"WITH w AS ({_WORDS}) SELECT page_id, round(sum(length(text_content) * confidence) / sum(length(text_content)), 6) AS page_confidence FROM w GROUP BY page_id",
)
def page_confidence(spark, d):
    return A.page_confidence(ocr_words(spark, d)).select("page_id", F.round("page_confidence", 6).alias("page_confidence"))


@query("A9_flag_degraded", "text_pages", "SELECT page_id, coalesce(ocr_confidence, 0) < 0.5 AS is_degraded FROM text_pages")
def flag_degraded(spark, d):
    return view(spark, d, "text_pages").select("page_id", A.is_degraded(F.coalesce("ocr_confidence", F.lit(0.0))).alias("is_degraded"))


@query(
    "A10_document_rollup",
    "text_pages ocr_rows",
    f"""WITH {_CHOSEN} SELECT document_id, round(avg(page_confidence), 6) AS avg_ocr_confidence, count(*) AS page_count,
        coalesce(string_agg(page_number, ',' ORDER BY page_number) FILTER (WHERE page_confidence < 0.5), '') AS degraded_pages, 'complete' AS processing_status
        FROM chosen GROUP BY document_id""",
)
def document_rollup(spark, d):
    rows = A.document_rollup(chosen_pages(spark, d))
    return rows.select(
        "document_id", F.round("avg_ocr_confidence", 6).alias("avg_ocr_confidence"), "page_count",
        F.array_join("degraded_pages", ",").alias("degraded_pages"), "processing_status",
    )


@query("A11_drop_bad_words", "ocr_rows", _WORDS)
def drop_bad_words(spark, d):
    return ocr_words(spark, d)


_SPACED = f"translate(string_agg(raw_text, chr(10) ORDER BY page_number, raw_text) FILTER (WHERE raw_text <> ''), '{P.UNICODE_SPACES}', '{" " * len(P.UNICODE_SPACES)}')"
_BID_TEXT = f"""bid_text AS (SELECT document_id, tender_id, bidder_id, doc_type, {_SPACED} AS text,
    avg(ocr_confidence) AS mean_confidence, max(uploaded_at) AS uploaded_at FROM bid_pages GROUP BY ALL)"""
_NIT_TEXT = f"""nit_text AS (SELECT document_id, tender_id, {_SPACED} AS text
    FROM nit_pages GROUP BY ALL)"""


def bid_documents(spark, d, cases=None):
    """The files of all bidders, or with cases those of their bidders and of few others."""
    pages = view(spark, d, "bid_pages")
    return A.assemble_text(pages if cases is None else V.may_have(pages, cases, "bidder_id"), "document_id", "tender_id", "bidder_id", "doc_type")


def nit_documents(spark, d):
    return A.assemble_text(view(spark, d, "nit_pages"), "document_id", "tender_id").select("document_id", "tender_id", "text")


@query("A12_assemble_text", "bid_pages", f"WITH {_BID_TEXT} SELECT document_id, text, round(mean_confidence, 6) AS mean_confidence FROM bid_text")
def assemble_text(spark, d):
    return bid_documents(spark, d).select("document_id", "text", F.round("mean_confidence", 6).alias("mean_confidence"))


@query(
    "A13_flatten_table_rows",
    "bid_table_rows",
    f"""SELECT document_id, row_index, concat({D.strip('cell_1')}, chr(9), {D.strip('cell_2')}, chr(9), {D.strip('cell_3')}) AS line FROM bid_table_rows
    WHERE cell_1 <> '' OR cell_2 <> '' OR cell_3 <> ''""",
)
def flatten_table_rows(spark, d):
    line = A.flatten_table_row(F.array("cell_1", "cell_2", "cell_3"))
    return view(spark, d, "bid_table_rows").select("document_id", "row_index", line.alias("line")).where(F.col("line").isNotNull())


@query(
    "A14_insert_if_absent",
    "debarment_list precedents",
    "SELECT precedent_id, criterion_text FROM precedents WHERE criterion_text NOT IN (SELECT text FROM documents)",
)
def insert_if_absent(spark, d):
    stored = view(spark, d, "documents").select(F.col("text").alias("criterion_text"))
    return A.insert_if_absent(view(spark, d, "precedents").select("precedent_id", "criterion_text"), stored, "criterion_text")


@query(
    "A16_register_bidders",
    "bidders transition_requests tenders",
    """SELECT r.request_id, r.tender_id, 'pending' AS status, 'clear' AS debarment_status,
        CASE WHEN t.tender_id IS NULL THEN 'TENDER_NOT_FOUND' END AS code FROM transition_requests r LEFT JOIN tenders t ON r.tender_id = t.tender_id""",
)
def register_bidders(spark, d):
    batch = view(spark, d, "transition_requests").select("request_id", "tender_id")
    return A.register_rows(batch, view(spark, d, "tenders"), {"status": "pending", "debarment_status": "clear"})


@query(
    "A17_reprocess_documents",
    "uploads",
    f"""SELECT upload_id, uploaded_at, doc_type, {_FORMAT} AS doc_format, CASE WHEN {_FORMAT} = 'unknown' THEN 'error' ELSE 'complete' END AS processing_status,
        {_FORMAT} = 'unknown' AND doc_type <> 'corrigendum' AS fatal FROM uploads WHERE processing_status IN ('pending', 'processing') ORDER BY uploaded_at, upload_id""",
)
def reprocess_documents(spark, d):
    rows = A.reprocess_documents(view(spark, d, "uploads"))
    return rows.select("upload_id", "uploaded_at", "doc_type", "doc_format", "processing_status", "fatal").orderBy("uploaded_at", "upload_id")


@query(
    "B8_page_words",
    "ocr_rows",
    f"""WITH w AS ({_WORDS}) SELECT page_id, text_content, x_min, y_min, row_number() OVER (PARTITION BY page_id ORDER BY y_min, x_min, word_no) AS reading_order FROM w""",
)
def page_words(spark, d):
    rows = B.page_words(ocr_words(spark, d))
    return rows.select("page_id", "text_content", "bbox.x_min", "bbox.y_min", "reading_order")


@query(
    "L7_page_word_counts",
    "text_pages ocr_rows",
    f"""WITH w AS ({_WORDS}) SELECT p.document_id, p.page_id, p.page_number, p.ocr_confidence, count(w.page_id) AS word_count
    FROM text_pages p LEFT JOIN w ON concat('P', w.page_id) = p.page_id GROUP BY ALL""",
)
def page_word_counts(spark, d):
    words = ocr_words(spark, d).select(F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("page_id"))
    return R.page_word_counts(view(spark, d, "text_pages"), words)


# --- C: criteria from text ---------------------------------------------------------------

_MARK = D.q(P.CLAUSE_MARKER)
_CLAUSES = _NIT_TEXT + f""",
    marked AS (SELECT document_id, tender_id, text, regexp_extract_all(text, {_MARK}, 1) AS refs, regexp_split_to_array(text, {_MARK}) AS parts FROM nit_text WHERE trim(text) <> ''),
    numbered AS (SELECT document_id, tender_id, i, {D.strip('refs[i]')} AS clause_ref, {D.strip('parts[i + 1]')} AS body
        FROM (SELECT *, unnest(range(1, len(refs) + 1)) AS i FROM marked) WHERE {D.strip('parts[i + 1]')} <> ''),
    rest AS (SELECT document_id, tender_id, text, list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda z: {D.strip('z')}), lambda z: z <> '') AS paras,
        list_filter(list_transform(string_split(regexp_replace(text, {D.q(P.SENTENCE_GAP)}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda z: {D.strip('z')}), lambda z: z <> '') AS sents
        FROM marked WHERE document_id NOT IN (SELECT document_id FROM numbered)),
    plain AS (SELECT document_id, tender_id, CASE WHEN len(paras) > 1 THEN paras ELSE sents END AS bodies FROM rest),
    clauses AS (SELECT document_id, tender_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS ord, clause_ref, body FROM numbered
        UNION ALL SELECT document_id, tender_id, i - 1, '', bodies[i] FROM (SELECT *, unnest(range(1, len(bodies) + 1)) AS i FROM plain))"""


def nit_clauses(spark, d):
    return X.split_clauses(nit_documents(spark, d))


@query("C1_split_clauses", "nit_pages", f"WITH {_CLAUSES} SELECT document_id, ord, clause_ref, body FROM clauses")
def split_clauses(spark, d):
    return nit_clauses(spark, d).select("document_id", "ord", "clause_ref", "body")


def _period(body: str) -> str:
    n = D.group(body, P.MEASUREMENT_PERIOD, 1)
    return f"CASE WHEN {n} <> '' THEN concat({n}, ' ', lower({D.group(body, P.MEASUREMENT_PERIOD, 2)})) END"


def _word_int(x: str) -> str:
    words = {w: i for i, w in enumerate(P.NUMBER_WORDS, start=1)}
    return f"CASE WHEN regexp_matches(trim({x}), '^\\d+$') THEN cast(trim({x}) AS bigint) ELSE {D.case(f'lower(trim({x}))', words, '0')} END"


_NUM_ROWS = " UNION ALL ".join(
    f"""SELECT document_id, ord, clause_ref, body, {p} * 1000 + i AS pos, trim(l[i]) AS label, coalesce(try_cast(replace(v[i], ',', '') AS double), 0.0) AS value, lower(u[i]) AS unit
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {D.all_groups('body', pat, 1)} AS l, {D.all_groups('body', pat, 2)} AS v, {D.all_groups('body', pat, 3)} AS u FROM clauses))"""
    for p, pat in enumerate(P.NUMERIC_PATTERNS)
)
_A, _B = P.TEMPORAL_COUNT_PATTERN, P.TEMPORAL_EXPERIENCE_PATTERN
_TMP_ROWS = f"""SELECT document_id, ord, clause_ref, body, 10000 + i AS pos, {_word_int('n[i]')} AS cnt, trim(w[i]) AS what, cast(p[i] AS bigint) AS period, lower(u[i]) AS period_unit
    FROM (SELECT *, unnest(range(1, len(n) + 1)) AS i FROM (SELECT *, {D.all_groups('body', _A, 1)} AS n, {D.all_groups('body', _A, 2)} AS w, {D.all_groups('body', _A, 3)} AS p, {D.all_groups('body', _A, 4)} AS u FROM clauses))
    UNION ALL SELECT document_id, ord, clause_ref, body, 11000 + i, 0, trim(w[i]), cast(p[i] AS bigint), lower(u[i])
    FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT *, {D.all_groups('body', _B, 1)} AS w, {D.all_groups('body', _B, 2)} AS p, {D.all_groups('body', _B, 3)} AS u FROM clauses))"""
# Word boundaries of RE2 know ASCII only: accented letters are replaced by a letter first.
_ASCII = "regexp_replace(body, '[\\x{00C0}-\\x{024F}]', 'x', 'g')"


def _doc_key(x: str) -> str:
    t = D.collapse(f"regexp_replace(lower({x}), '\\b(?:valid|registration|certificate|card|number)\\b', '', 'g')")
    whens = " ".join(f"WHEN {D.contains_any(t, forms)} THEN '{key}'" for key, forms in P.DOC_KEY_ALIASES)
    return f"CASE {whens} ELSE {t} END"


_CAT_ALL = " UNION ALL ".join(
    f"""SELECT document_id, ord, clause_ref, body, {20 + p} * 1000 + i AS pos, trim(l[i]) AS document
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (SELECT *, {D.all_groups(_ASCII, pat, 1)} AS l FROM clauses))"""
    for p, pat in enumerate(P.CATEGORICAL_PATTERNS)
)
_CAT_ROWS = f"SELECT *, {_doc_key('document')} AS doc_key FROM ({_CAT_ALL}) QUALIFY row_number() OVER (PARTITION BY document_id, ord, doc_key ORDER BY pos) = 1"
_QUAL_HIT = "coalesce(" + ", ".join(f"nullif({D.group('body', p, 0)}, '')" for p in P.QUALITATIVE_PATTERNS) + ")"
_MATCHED = _CLAUSES + f""",
    num AS ({_NUM_ROWS}), tmp AS ({_TMP_ROWS}), cat AS ({_CAT_ROWS}),
    strong AS (SELECT document_id, ord FROM num UNION SELECT document_id, ord FROM tmp UNION SELECT document_id, ord FROM cat),
    qual AS (SELECT * FROM (SELECT document_id, ord, clause_ref, body, trim({_QUAL_HIT}) AS assessment_text FROM clauses c
        WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.document_id = c.document_id AND s.ord = c.ord)) WHERE assessment_text IS NOT NULL)"""


def clause_matches(spark, d):
    return X.match_clauses(nit_clauses(spark, d))


def _of_type(spark, d, kind):
    return clause_matches(spark, d).where(F.col("criterion_type") == kind)


@query(
    "C2_match_numeric",
    "nit_pages",
    f"WITH {_MATCHED} SELECT document_id, ord, clause_ref, label, value, unit, {D.to_rupees('value', 'unit')} AS rupees, {_period('body')} AS measurement_period FROM num",
)
def match_numeric(spark, d):
    return _of_type(spark, d, "numeric_threshold").select("document_id", "ord", "clause_ref", "label", "value", "unit", "rupees", "measurement_period")


@query(
    "C3_match_temporal",
    "nit_pages",
    f"WITH {_MATCHED} SELECT document_id, ord, clause_ref, cnt AS \"count\", what, period, period_unit, concat(period, ' ', period_unit) AS measurement_period FROM tmp",
)
def match_temporal(spark, d):
    return _of_type(spark, d, "temporal_recency").select("document_id", "ord", "clause_ref", "count", "what", "period", "period_unit", "measurement_period")


@query("C4_match_categorical", "nit_pages", f"WITH {_MATCHED} SELECT document_id, ord, clause_ref, document, doc_key FROM cat")
def match_categorical(spark, d):
    return _of_type(spark, d, "categorical_presence").select("document_id", "ord", "clause_ref", "document", "doc_key")


@query("C5_match_qualitative", "nit_pages", f"WITH {_MATCHED} SELECT document_id, ord, clause_ref, assessment_text FROM qual")
def match_qualitative(spark, d):
    return _of_type(spark, d, "qualitative_assessment").select("document_id", "ord", "clause_ref", "assessment_text")


def _any(ps, x="lower(body)"):
    return "(" + " OR ".join(f"regexp_matches({x}, {D.q(p)})" for p in ps) + ")"


_CLASS = f"""CASE WHEN {_any(P.NUMERIC_PATTERNS)} THEN 'numeric_threshold' WHEN {_any([_A, _B])} THEN 'temporal_recency'
    WHEN {_any(P.CATEGORICAL_PATTERNS, f'lower({_ASCII})')} THEN 'categorical_presence' ELSE 'qualitative_assessment' END"""


@query("C6_classify_type", "nit_pages", f"WITH {_CLAUSES} SELECT document_id, ord, {_CLASS} AS criterion_type FROM clauses")
def classify_type(spark, d):
    return nit_clauses(spark, d).select("document_id", "ord", C.classify_type(F.col("body")).alias("criterion_type"))


_CITED = f"nullif({D.group('lower(body)', P.RULE_CITATION, 1)}, '')"
_KEYRULE = "CASE " + " ".join(f"WHEN contains(lower(body), '{k}') THEN '{r}'" for k, r in P.MANDATORY_KEYWORDS) + " END"
_STRONGTYPE = "criterion_type IN ('numeric_threshold', 'categorical_presence')"
_MAND = f"(contains(lower(body), 'mandatory') OR contains(lower(body), 'pre-qualification') OR ({_STRONGTYPE} AND ({_KEYRULE}) IS NOT NULL))"
_RULE = f"coalesce('GFR Rule ' || {_CITED}, CASE WHEN {_STRONGTYPE} THEN {_KEYRULE} END)"


@query(
    "C7_gfr_mandatory",
    "nit_pages",
    f"WITH {_CLAUSES}, typed AS (SELECT *, {_CLASS} AS criterion_type FROM clauses) SELECT document_id, ord, {_MAND} AS is_mandatory, {_RULE} AS gfr_rule_number FROM typed",
)
def gfr_mandatory(spark, d):
    rows = nit_clauses(spark, d).withColumn("criterion_type", C.classify_type(F.col("body")))
    b, k = F.col("body"), F.col("criterion_type")
    return rows.select("document_id", "ord", C.is_rule_mandatory(b, k).alias("is_mandatory"), C.rule_number(b, k).alias("gfr_rule_number"))


@query(
    "C8_to_rupees",
    "",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + D.to_rupees("l_quantity / 8", "CASE l_linenumber WHEN 1 THEN 'Crore' WHEN 2 THEN 'lac' WHEN 3 THEN 'L.' WHEN 4 THEN 'mn' WHEN 5 THEN 'k' ELSE 'each' END") + " AS rupees FROM lineitem",
)
def rupees(spark, d):
    unit = F.expr("CASE l_linenumber WHEN 1 THEN 'Crore' WHEN 2 THEN 'lac' WHEN 3 THEN 'L.' WHEN 4 THEN 'mn' WHEN 5 THEN 'k' ELSE 'each' END")
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", to_rupees(F.col("l_quantity") / 8, unit).alias("rupees"))


@query("C10_normalise_doc_key", "nit_pages", f"WITH {_CLAUSES}, every AS ({_CAT_ALL}) SELECT document, {_doc_key('document')} AS doc_key, count(*) AS n FROM every GROUP BY ALL")
def normalise_doc_key(spark, d):
    mentions = F.explode(F.concat(*[F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in P.CATEGORICAL_PATTERNS]))
    rows = nit_clauses(spark, d).select(mentions.alias("document")).withColumn("document", F.trim("document"))
    rows = rows.groupBy("document").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("document", C.normalise_doc_key(F.col("document")).alias("doc_key"), "n")


_KINDS = """CASE WHEN contains(lower(label), 'turnover') OR contains(lower(label), 'net worth') THEN 'ca_certificate,audited_balance_sheet'
    WHEN contains(lower(label), 'emd') OR contains(lower(label), 'earnest') OR contains(lower(label), 'bid security') THEN 'emd_receipt,bank_guarantee'
    WHEN contains(lower(label), 'work') OR contains(lower(label), 'contract') OR contains(lower(label), 'project') THEN 'work_order,completion_certificate' ELSE '' END"""


@query("C11_evidence_types", "nit_pages", f"WITH {_MATCHED} SELECT label, {_KINDS} AS evidence_types, count(*) AS n FROM num GROUP BY ALL")
def evidence_types(spark, d):
    rows = _of_type(spark, d, "numeric_threshold").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("label", F.array_join(C.evidence_types(F.col("label")), ",").alias("evidence_types"), "n")


@query("C12_measurement_period", "nit_pages", f"WITH {_CLAUSES} SELECT document_id, ord, {_period('body')} AS measurement_period FROM clauses")
def measurement_period(spark, d):
    return nit_clauses(spark, d).select("document_id", "ord", C.measurement_period(F.col("body")).alias("measurement_period"))


_TRIMMED = f"CASE WHEN length({D.collapse('body')}) <= 400 THEN {D.collapse('body')} ELSE concat(rtrim(substr({D.collapse('body')}, 1, 399)), '…') END"


@query("C13_trim_sentence", "nit_pages", f"WITH {_CLAUSES} SELECT document_id, ord, {_TRIMMED} AS criterion_text FROM clauses")
def trim_sentence(spark, d):
    return nit_clauses(spark, d).select("document_id", "ord", C.trim_sentence(F.col("body")).alias("criterion_text"))


_NUMBER_WORD = "CASE l_linenumber WHEN 1 THEN 'One' WHEN 2 THEN ' ten ' WHEN 3 THEN 'eleven' WHEN 4 THEN '' ELSE cast(l_partkey AS string) END"


@query("C14_word_to_int", "", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_word_int('(' + _NUMBER_WORD + ')')} AS n FROM lineitem")
def to_int(spark, d):
    return view(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", word_to_int(F.expr(_NUMBER_WORD)).alias("n"))


def _hits(x, phrases):
    listed = "[" + ", ".join(D.q(p) for p in phrases) + "]"
    return f"array_to_string(list_filter({listed}, lambda p: contains(lower({x}), p)), ',')"


@query(
    "C15_amendment_indicators",
    "nit_pages",
    f"WITH {_NIT_TEXT} SELECT document_id, {_hits('text', P.AMENDMENT_INDICATORS)} AS indicators, {_hits('text', P.BUILDER_AMENDMENT_INDICATORS)} AS builder_indicators FROM nit_text",
)
def amendment_indicators(spark, d):
    t = F.col("text")
    return nit_documents(spark, d).select(
        "document_id", F.array_join(C.amendment_indicators(t), ",").alias("indicators"),
        F.array_join(C.amendment_indicators(t, P.BUILDER_AMENDMENT_INDICATORS), ",").alias("builder_indicators"),
    )


@query(
    "C16_missing_corrigenda",
    "nit_pages amendments",
    f"WITH {_NIT_TEXT}, i AS (SELECT document_id, tender_id, {_hits('text', P.BUILDER_AMENDMENT_INDICATORS)} AS indicators FROM nit_text) SELECT * FROM i WHERE indicators <> '' AND tender_id NOT IN (SELECT tender_id FROM amendments)",
)
def missing_corrigenda(spark, d):
    rows = X.missing_corrigenda(nit_documents(spark, d), view(spark, d, "amendments"))
    return rows.select("document_id", "tender_id", F.array_join("indicators", ",").alias("indicators"))


_EVERY = f"""every AS (
    SELECT document_id, ord, pos, clause_ref, body, 'numeric_threshold' AS criterion_type, concat('num:', label, ':', {D.to_rupees('value', 'unit')}) AS signature, {D.to_rupees('value', 'unit')} AS rupees, {_KINDS} AS kinds, {_period('body')} AS measurement_period FROM num
    UNION ALL SELECT document_id, ord, pos, clause_ref, body, 'temporal_recency', concat('tmp:', cnt, ':', period, ':', period_unit), NULL, 'completion_certificate,work_order', concat(period, ' ', period_unit) FROM tmp
    UNION ALL SELECT document_id, ord, pos, clause_ref, body, 'categorical_presence', concat('doc:', lower(document)), NULL, 'certificate', NULL FROM cat
    UNION ALL SELECT document_id, ord, 0, clause_ref, body, 'qualitative_assessment', concat('qual:', assessment_text), NULL, '', NULL FROM qual),
    kept AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY document_id, criterion_type, signature, clause_ref ORDER BY ord, pos) = 1)"""


@query("C9_dedupe_criteria", "nit_pages", f"WITH {_MATCHED}, {_EVERY} SELECT document_id, criterion_type, signature, clause_ref, ord FROM kept")
def dedupe_criteria(spark, d):
    return X.dedupe_criteria(clause_matches(spark, d)).select("document_id", "criterion_type", "signature", "clause_ref", "ord")


@query(
    "C17_extract_criteria",
    "nit_pages",
    f"""WITH {_MATCHED}, {_EVERY} SELECT document_id, ord, clause_ref, criterion_type, signature, rupees, {D.collapse('body')} AS criterion_text, {_TRIMMED} AS criterion_display, {_MAND} AS is_mandatory,
        NOT {_MAND} AS gfr_override_permitted, {_RULE} AS gfr_rule_number, kinds AS evidence_types, measurement_period, 'extracted' AS status FROM kept""",
)
def extract_criteria(spark, d):
    rows = X.extract_criteria(nit_documents(spark, d))
    return rows.select(
        "document_id", "ord", "clause_ref", "criterion_type", "signature", "rupees", "criterion_text", "criterion_display", "is_mandatory", "gfr_override_permitted",
        "gfr_rule_number", F.array_join("acceptable_evidence_types", ",").alias("evidence_types"), "measurement_period", "status",
    )


@query(
    "C17_extraction_confidence",
    "nit_pages",
    f"""WITH {_MATCHED}, {_EVERY} SELECT n.document_id, count(k.document_id) AS n, CASE WHEN count(k.document_id) = 0 THEN 0.3 ELSE round(least(0.4 + 0.1 * count(k.document_id), 0.95), 6) END AS confidence
    FROM nit_text n LEFT JOIN kept k ON n.document_id = k.document_id GROUP BY n.document_id""",
)
def extraction_confidence(spark, d):
    docs = nit_documents(spark, d)
    return X.extraction_confidence(docs, X.extract_criteria(docs))


# --- D: amendments ------------------------------------------------------------------------

_HISTORY = """k AS (SELECT tender_id, source_clause_ref, list(DISTINCT criterion_type) AS kinds FROM criteria GROUP BY ALL),
    m AS (SELECT c.tender_id, c.criterion_id, a.uploaded_at, a.ord, a.corrigendum_id, a.reason,
        struct_pack(r := c.threshold_rupees, d := c.threshold_document, n := cast(c.threshold_count AS bigint), p := c.threshold_period) AS own,
        CASE WHEN coalesce(cast(a.amended_rupees AS varchar), a.amended_document, cast(a.amended_count AS varchar), a.amended_period) IS NOT NULL
            THEN struct_pack(r := a.amended_rupees, d := a.amended_document, n := cast(a.amended_count AS bigint), p := a.amended_period) END AS given
        FROM criteria c JOIN amendments a ON a.tender_id = c.tender_id AND a.clause_ref = c.source_clause_ref
        JOIN k ON k.tender_id = c.tender_id AND k.source_clause_ref = c.source_clause_ref WHERE a.criterion_type = c.criterion_type OR NOT list_contains(k.kinds, a.criterion_type)),
    s AS (SELECT *, row_number() OVER (PARTITION BY criterion_id ORDER BY uploaded_at, ord) AS seq,
        coalesce(last_value(given IGNORE NULLS) OVER (PARTITION BY criterion_id ORDER BY uploaded_at, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), own) AS o FROM m),
    t AS (SELECT *, coalesce(given, o) AS e FROM s),
    h AS (SELECT tender_id, criterion_id, seq, o.r AS original_value, o.d AS original_document, o.n AS original_count, o.p AS original_period,
        e.r AS amended_value, e.d AS amended_document, e.n AS amended_count, e.p AS amended_period,
        concat('Corrigendum doc ', corrigendum_id) AS corrigendum_ref, coalesce(reason, 'Corrigendum amendment') AS amendment_reason FROM t),
    l AS (SELECT criterion_id, arg_min(o, seq) AS o, arg_max(e, seq) AS e, arg_max(concat('Corrigendum doc ', corrigendum_id), seq) AS corrigendum_ref, count(*) AS n FROM t GROUP BY 1)"""


@query("D1_amendment_history", "criteria amendments", f"WITH {_HISTORY} SELECT * FROM h")
def amendment_history(spark, d):
    return M.amendment_history(view(spark, d, "criteria"), view(spark, d, "amendments"))


@query(
    "D1_apply_corrigenda",
    "criteria amendments",
    f"""WITH {_HISTORY} SELECT c.criterion_id, c.tender_id, CASE WHEN n > 0 THEN e.r ELSE threshold_rupees END AS threshold_rupees, CASE WHEN n > 0 THEN e.d ELSE threshold_document END AS threshold_document,
        CASE WHEN n > 0 THEN e.n ELSE threshold_count END AS threshold_count, CASE WHEN n > 0 THEN e.p ELSE threshold_period END AS threshold_period, coalesce(n, 0) AS amendments
    FROM criteria c LEFT JOIN l ON l.criterion_id = c.criterion_id""",
)
def apply_corrigenda(spark, d):
    rows = M.apply_corrigenda(view(spark, d, "criteria"), view(spark, d, "amendments"))
    return rows.select("criterion_id", "tender_id", "threshold_rupees", "threshold_document", "threshold_count", "threshold_period", "amendments")


@query(
    "D2_criterion_diff",
    "criteria amendments",
    f"""WITH {_HISTORY} SELECT c.criterion_id, c.tender_id, CASE WHEN n > 0 THEN o.r ELSE threshold_rupees END AS original, CASE WHEN n > 0 THEN o.d ELSE threshold_document END AS original_document,
        CASE WHEN n > 0 THEN o.n ELSE threshold_count END AS original_count, CASE WHEN n > 0 THEN o.p ELSE threshold_period END AS original_period,
        e.r AS amended, e.d AS amended_document, e.n AS amended_count, e.p AS amended_period, corrigendum_ref, coalesce(n, 0) AS amendments, coalesce(n, 0) > 0 AS has_amendments
    FROM criteria c LEFT JOIN l ON l.criterion_id = c.criterion_id""",
)
def criterion_diff(spark, d):
    c = view(spark, d, "criteria")
    return M.criterion_diff(c, M.amendment_history(c, view(spark, d, "amendments")))


_TARGETS = """t AS (SELECT a.*, EXISTS (SELECT 1 FROM criteria c WHERE c.tender_id = a.tender_id AND c.source_clause_ref = a.clause_ref) AS clause_exists FROM amendments a)"""


@query("D3_validate_amendment_targets", "criteria amendments", f"WITH {_TARGETS} SELECT corrigendum_id, ord, clause_ref, clause_exists FROM t")
def validate_amendment_targets(spark, d):
    rows = M.validate_amendment_targets(view(spark, d, "amendments"), view(spark, d, "criteria"))
    return rows.select("corrigendum_id", "ord", "clause_ref", "clause_exists")


@query(
    "D3_amendment_consensus",
    "criteria amendments",
    f"""WITH {_TARGETS} SELECT corrigendum_id, count(*) AS n, count(*) FILTER (WHERE NOT clause_exists) AS bad, round(1 - count(*) FILTER (WHERE NOT clause_exists) / count(*), 6) AS agreement_score,
        round(avg(confidence) * (1 - count(*) FILTER (WHERE NOT clause_exists) / count(*)), 6) AS consensus,
        CASE WHEN count(*) FILTER (WHERE NOT clause_exists) = 0 THEN 'agree' ELSE 'disagree' END AS agreement FROM t GROUP BY corrigendum_id""",
)
def amendment_consensus(spark, d):
    rows = M.amendment_consensus(M.validate_amendment_targets(view(spark, d, "amendments"), view(spark, d, "criteria")))
    return rows.withColumn("agreement_score", F.round("agreement_score", 6)).withColumn("consensus", F.round("consensus", 6))


_B = lambda c: f"CASE WHEN {c} THEN 'true' ELSE 'false' END"
_S = lambda c: f"CASE WHEN {c} IS NULL THEN 'null' ELSE concat('\"', {c}, '\"') END"
_CRIT_JSON = f"""concat('{{"criterion_text":', {_S('criterion_text')}, ',"criterion_type":', {_S('criterion_type')}, ',"gfr_override_permitted":', {_B('gfr_override_permitted')}, ',"gfr_rule_number":', {_S('gfr_rule_number')},
    ',"id":', criterion_id, ',"is_mandatory":', {_B('is_mandatory')}, ',"source_clause_ref":', {_S('source_clause_ref')}, ',"status":', {_S('status')}, ',"tender_id":', tender_id,
    ',"threshold_rupees":', CASE WHEN threshold_rupees IS NULL THEN 'null' ELSE cast(threshold_rupees AS varchar) END, '}}')"""


@query(
    "D4_ets_version",
    "criteria",
    f"""SELECT tender_id, count(*) AS criteria_count, sha256(concat('[', string_agg({_CRIT_JSON}, ',' ORDER BY source_clause_ref, criterion_id), ']')) AS version_hash FROM criteria GROUP BY tender_id""",
)
def ets_version(spark, d):
    return M.ets_version(view(spark, d, "criteria"))


_APPROVED = """ap AS (SELECT a.*, t.status, coalesce(n, 0) AS criteria_count, CASE WHEN t.status IS NULL THEN 'TENDER_NOT_FOUND' WHEN t.status <> 'SCHEMA_PENDING_REVIEW' THEN 'SCHEMA_NOT_APPROVED'
        WHEN coalesce(n, 0) = 0 THEN 'NO_CRITERIA' END AS code
    FROM approvals a LEFT JOIN tenders t ON a.tender_id = t.tender_id LEFT JOIN (SELECT tender_id, count(*) AS n FROM criteria WHERE status <> 'extracted' GROUP BY 1) c ON c.tender_id = a.tender_id)"""


def approvals(spark, d):
    return M.approve_schema(view(spark, d, "approvals"), view(spark, d, "tenders"), view(spark, d, "criteria").where("status <> 'extracted'"))


@query("D5_approve_schema", "approvals tenders criteria", f"WITH {_APPROVED} SELECT tender_id, officer_id, criteria_count, code, CASE WHEN code IS NULL THEN 'SCHEMA_APPROVED' END AS new_status FROM ap")
def approve_schema(spark, d):
    return approvals(spark, d).select("tender_id", "officer_id", "criteria_count", "code", "new_status")


@query(
    "D5_approved_criteria",
    "approvals tenders criteria",
    f"WITH {_APPROVED} SELECT c.criterion_id, c.tender_id, 'approved' AS status, ap.officer_id AS approved_by, ap.approved_at FROM criteria c JOIN ap ON ap.tender_id = c.tender_id WHERE ap.code IS NULL",
)
def approved_criteria(spark, d):
    rows = M.approved_criteria(view(spark, d, "criteria"), approvals(spark, d))
    return rows.select("criterion_id", "tender_id", "status", "approved_by", "approved_at")


_PATCHED = """pt AS (SELECT e.edit_id, e.criterion_id, c.tender_id, e.officer_id, CASE WHEN c.tender_id IS NULL THEN 'CRITERION_NOT_FOUND' WHEN coalesce(t.status, '') <> 'SCHEMA_PENDING_REVIEW' THEN 'NOT_IN_REVIEW'
        WHEN e.criterion_text IS NULL AND e.criterion_type IS NULL AND e.threshold_rupees IS NULL AND e.is_mandatory IS NULL
            AND e.gfr_override_permitted IS NULL AND e.measurement_period IS NULL THEN 'NO_CHANGES'
        WHEN e.criterion_type NOT IN ('numeric_threshold', 'categorical_presence', 'temporal_recency', 'composite', 'qualitative_assessment') THEN 'INVALID_TYPE' END AS code,
        coalesce(e.criterion_text, c.criterion_text) AS ntext, coalesce(e.criterion_type, c.criterion_type) AS ntype, coalesce(e.threshold_rupees, c.threshold_rupees) AS nrupees,
        coalesce(e.is_mandatory, c.is_mandatory) AS nmand, coalesce(e.gfr_override_permitted, c.gfr_override_permitted) AS ngfr,
        coalesce(e.measurement_period, c.measurement_period) AS nperiod, c.criterion_text AS otext
    FROM edits e LEFT JOIN criteria c ON e.criterion_id = c.criterion_id LEFT JOIN tenders t ON t.tender_id = c.tender_id)"""


def patched(spark, d):
    return M.patch_criteria(view(spark, d, "criteria"), view(spark, d, "edits"), view(spark, d, "tenders"))


@query(
    "D6_patch_criteria",
    "edits criteria tenders",
    f"""WITH {_PATCHED} SELECT edit_id, criterion_id, officer_id, code, CASE WHEN code IS NULL THEN ntext END AS new_criterion_text, CASE WHEN code IS NULL THEN ntype END AS new_criterion_type,
        CASE WHEN code IS NULL THEN nrupees END AS new_threshold_rupees, CASE WHEN code IS NULL THEN nmand END AS new_is_mandatory,
        CASE WHEN code IS NULL THEN ngfr END AS new_gfr_override_permitted, CASE WHEN code IS NULL THEN nperiod END AS new_measurement_period, CASE WHEN code IS NULL THEN 'reviewed' END AS new_status FROM pt""",
)
def patch_criteria(spark, d):
    return patched(spark, d).drop("tender_id", "old_criterion_text")


@query(
    "D7_edits_to_precedents",
    "edits criteria tenders",
    f"""WITH {_PATCHED} SELECT sha256(concat('edit|', edit_id)) AS precedent_id, otext AS criterion_text, ntext AS resolved_interpretation, t.department, t.category AS tender_category, 'PASS' AS verdict,
        'confirmed' AS officer_action, officer_id, pt.tender_id, criterion_id FROM pt JOIN tenders t ON t.tender_id = pt.tender_id WHERE code IS NULL AND ntext <> otext""",
)
def edits_to_precedents(spark, d):
    return M.edits_to_precedents(patched(spark, d), view(spark, d, "tenders"))


@query(
    "D8_is_schema_approved",
    "tenders",
    "SELECT tender_id, status IN (" + ", ".join(f"'{s}'" for s in P.APPROVED_STATES) + ") AS approved FROM tenders",
)
def is_schema_approved(spark, d):
    return view(spark, d, "tenders").select("tender_id", M.is_schema_approved(F.col("status")).alias("approved"))


_STORED = """CASE ord % 3 WHEN 0 THEN concat('[{"original_value":"', ord, '","amended_value":"', amended_rupees, '"}]')
    WHEN 1 THEN concat('{"history":[{"original_value":"1"},{"amended_value":"', amended_rupees, '"}],"_sources":["rules","llm"],"_agreement_similarity":0.75,"needs_review":true}')
    ELSE 'broken' END"""


@query(
    "D9_parse_amendment",
    "amendments",
    """SELECT corrigendum_id, ord, CASE ord % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS entries, CASE ord % 3 WHEN 1 THEN 'rules,llm' ELSE 'rules' END AS sources,
        CASE ord % 3 WHEN 1 THEN 0.75 END AS agreement_similarity, ord % 3 = 1 AS needs_review, CASE WHEN ord % 3 < 2 THEN cast(amended_rupees AS varchar) END AS last_value FROM amendments""",
)
def parse_amendment(spark, d):
    rows = view(spark, d, "amendments").withColumn("_a", M.parse_amendment(F.expr(_STORED)))
    last = F.try_element_at("_a.history", F.lit(-1))
    return rows.select(
        "corrigendum_id", "ord", F.size("_a.history").alias("entries"), F.array_join("_a.sources", ",").alias("sources"),
        F.col("_a.agreement_similarity").alias("agreement_similarity"), F.col("_a.needs_review").alias("needs_review"), last["amended_value"].alias("last_value"),
    )
