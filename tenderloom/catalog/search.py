"""Retrieval, branch validation, repeatability, streaming and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import branches as X
from ..operators import evaluate as E
from ..operators import ledger as L
from ..operators import repro as N
from ..operators import retrieve as I
from ..operators import review as J
from ..operators import report as R
from ..plans import evaluation as plans
from ..sources import files
from ..sources.adapters import view
from ..streaming import streams
from . import duck as D
from . import documents as docs
from . import evaluation as ev
from . import reporting as rp
from .registry import query

_FROM, _TO = I.accent_map()


def _fold(x: str) -> str:
    return f"translate(lower({x}), '{_FROM}', '{_TO}')"


_STOP = "(" + ", ".join(f"'{w}'" for w in P.STOP_WORDS) + ")"


def _tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '{P.WORD}'), lambda w: length(w) > 2 AND w NOT IN {_STOP})"


@query("I1_search_tokens", "precedent_queries", f"SELECT query_id, array_to_string({_tokens('query_text')}, ' ') AS tokens FROM precedent_queries")
def search_tokens(spark, d):
    return view(spark, d, "precedent_queries").select("query_id", F.array_join(I.search_tokens(F.col("query_text")), " ").alias("tokens"))


def _bm25(queries: str, key: str) -> str:
    return f"""doc AS (SELECT precedent_id, department, tender_category, regexp_extract_all({_fold("concat_ws(' ', criterion_text, resolved_interpretation, department, tender_category)")}, '[\\p{{L}}\\p{{N}}]+') AS w FROM precedents),
    stat AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM doc),
    post AS (SELECT precedent_id, department, tender_category, dl, token, count(*) AS f FROM (SELECT precedent_id, department, tender_category, len(w) AS dl, unnest(w) AS token FROM doc) GROUP BY ALL),
    idf AS (SELECT token, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT token, count(*) AS df FROM post GROUP BY 1), stat),
    qt AS (SELECT {key}, department, category, token, count(*) AS qf FROM (SELECT {key}, department, category, {_fold('token')} AS token FROM (SELECT {key}, department, category, unnest({_tokens('query_text')}) AS token FROM {queries})) GROUP BY ALL),
    sc AS (SELECT {key}, precedent_id, round(sum(qf * idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM qt JOIN post ON qt.token = post.token AND qt.department = post.department AND qt.category = post.tender_category JOIN idf ON idf.token = post.token, stat GROUP BY {key}, precedent_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, precedent_id) AS rank FROM sc QUALIFY rank <= 3)"""


@query("I2_bm25_top_k", "precedents precedent_queries", f"WITH {_bm25('precedent_queries', 'query_id')} SELECT query_id, precedent_id, rank, round(score, 3) AS score FROM ranked")
def bm25_top_k(spark, d):
    rows = I.bm25_top_k(view(spark, d, "precedent_queries"), view(spark, d, "precedents"))
    return rows.select("query_id", "precedent_id", "rank", F.round("score", 3).alias("score"))


_COSINE = """sims AS (SELECT q.query_id, p.precedent_id, round(list_dot_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS similarity FROM query_vecs q JOIN precedent_vecs p ON q.scope = p.scope),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, precedent_id) AS rank FROM sims QUALIFY rank <= 3)"""


def cosine(spark, d):
    return I.cosine_top_k(view(spark, d, "query_vecs"), view(spark, d, "precedent_vecs"))


@query("I3_cosine_top_k", "query_vecs precedent_vecs", f"WITH {_COSINE} SELECT query_id, precedent_id, similarity, rank FROM top")
def cosine_top_k(spark, d):
    return cosine(spark, d).select("query_id", "precedent_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(
    "I4_pick_strategy",
    "tenders precedents",
    """SELECT t.department, t.category, coalesce(p.n, 0) AS precedent_count, CASE WHEN coalesce(p.n, 0) < 1000 THEN 'semantic' ELSE 'bm25' END AS strategy
    FROM (SELECT DISTINCT department, category FROM tenders) t LEFT JOIN (SELECT department, tender_category, count(*) AS n FROM precedents GROUP BY ALL) p ON p.department = t.department AND p.tender_category = t.category""",
)
def pick_strategy(spark, d):
    return I.pick_strategy(view(spark, d, "tenders").select("department", "category").distinct(), view(spark, d, "precedents"))


@query(
    "I5_precedent_stats",
    "precedents",
    """SELECT 'total' AS level, 'all' AS name, count(*) AS entries, count(*) >= 50 AS ready FROM precedents
    UNION ALL SELECT 'department', department, count(*), NULL FROM precedents GROUP BY department UNION ALL SELECT 'category', tender_category, count(*), NULL FROM precedents GROUP BY tender_category""",
)
def precedent_stats(spark, d):
    return I.precedent_stats(view(spark, d, "precedents"))


@query(
    "I6_store_precedents",
    "precedents decisions evaluations criteria tenders",
    f"""WITH {rp._DECIDED} SELECT precedent_id, criterion_text, department, tender_category, verdict, officer_action FROM precedents
    UNION ALL SELECT sha256(concat(a.evaluation_id, '|', decision_id)), c.criterion_text, t.department, t.category, verdict, decision
    FROM applied a JOIN criteria c ON a.criterion_id = c.criterion_id JOIN tenders t ON a.tender_id = t.tender_id WHERE new_status = 'resolved'""",
)
def store_precedents(spark, d):
    """Precedents from decisions, appended to the stored ones and read back."""
    path = files.shared_folder(spark) + "/precedents"
    files.store_precedents(view(spark, d, "precedents").drop("resolved_interpretation"), path)
    files.store_precedents(rp.decisions_to_precedents(spark, d).select("precedent_id", "criterion_text", "department", "tender_category", "verdict", "officer_action"), path)
    return spark.read.parquet(path).select("precedent_id", "criterion_text", "department", "tender_category", "verdict", "officer_action")


@query(
    "I7_cosine_pairs",
    "embeddings",
    """SELECT a.vec_id, CASE WHEN a.vec_id % 9 = 0 THEN 0.0 ELSE round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS similarity_score,
        CASE WHEN a.vec_id % 9 = 0 THEN 0.0 ELSE round(least(1.0, abs(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) END AS confidence
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine_pairs(spark, d):
    e = view(spark, d, "embeddings")
    left = F.when(F.col("vec_id") % 9 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    rows = e.select("vec_id", left.alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return I.cosine_pairs(rows, "a", "b").select("vec_id", F.round("similarity_score", 6).alias("similarity_score"), F.round("confidence", 6).alias("confidence"))


@query(
    "I8_semantic_verdict",
    "query_vecs precedent_vecs",
    f"""WITH {_COSINE}, s AS (SELECT query_id, max(similarity) AS p FROM top GROUP BY 1), j AS (SELECT query_id, p, round(abs(sin(query_id)), 6) AS dsim FROM s)
    SELECT query_id, CASE WHEN dsim >= 0.55 AND p >= 0.55 THEN 'PASS' ELSE 'REVIEW' END AS verdict, round(greatest(0.0, least(1.0, 0.5 * dsim + 0.5 * p)), 6) AS confidence FROM j""",
)
def semantic_verdict(spark, d):
    rows = cosine(spark, d).groupBy("query_id").agg(F.max("similarity").alias("p")).withColumn("dsim", F.round(F.abs(F.sin("query_id")), 6))
    v, c = I.semantic_verdict(F.col("dsim"), F.col("p"))
    return rows.select("query_id", v.alias("verdict"), F.round(c, 6).alias("confidence"))


_CQ = """cq AS (SELECT c.criterion_id, c.criterion_text AS query_text, t.department, t.category FROM criteria c JOIN tenders t ON t.tender_id = c.tender_id)"""


def criterion_precedents(spark, d):
    return I.criterion_precedents(view(spark, d, "criteria"), view(spark, d, "tenders"), view(spark, d, "precedents"))


@query("I9_criterion_precedents", "criteria tenders precedents", f"WITH {_CQ}, {_bm25('cq', 'criterion_id')} SELECT criterion_id, precedent_id, rank, round(score, 3) AS score FROM ranked")
def search_precedents(spark, d):
    return criterion_precedents(spark, d).select("criterion_id", "precedent_id", "rank", F.round("score", 3).alias("score"))


@query(
    "J2_review_card",
    "evaluations criteria bidders tenders precedents",
    f"""WITH {_CQ}, {_bm25('cq', 'criterion_id')}, pr AS (SELECT criterion_id, string_agg(precedent_id, ',' ORDER BY rank) AS ids FROM ranked GROUP BY 1)
    SELECT e.evaluation_id, c.criterion_text, c.criterion_type, coalesce(c.is_mandatory, false) AS is_mandatory, b.company_name, e.verdict, e.route, true AS can_confirm,
        coalesce(gfr_override_permitted, true) OR verdict <> 'FAIL' AS can_override, coalesce(gfr_override_permitted, true) AND coalesce(is_mandatory, false) AND verdict = 'FAIL' AS requires_second_officer,
        coalesce(pr.ids, '') AS precedents
    FROM evaluations e LEFT JOIN criteria c ON c.criterion_id = e.criterion_id LEFT JOIN bidders b ON b.bidder_id = e.bidder_id LEFT JOIN pr ON pr.criterion_id = e.criterion_id""",
)
def review_card(spark, d):
    rows = J.review_card(view(spark, d, "evaluations"), view(spark, d, "criteria"), view(spark, d, "bidders"), criterion_precedents(spark, d))
    return rows.select(
        "evaluation_id", "criterion_text", "criterion_type", "is_mandatory", "company_name", "verdict", "route", "can_confirm", "can_override",
        "requires_second_officer", F.coalesce(F.array_join(F.col("precedents.precedent_id"), ","), F.lit("")).alias("precedents"),
    )


# --- E: two branches ------------------------------------------------------------------------

_SIDES = """rs AS (SELECT label AS document_id, vec_id AS item_no, embedding FROM embeddings WHERE vec_id % 2 = 0), ms AS (SELECT label AS document_id, vec_id AS item_no, embedding FROM embeddings WHERE vec_id % 2 = 1)"""


def branch_items(spark, d):
    """Rule and model items per document: vectors of a label, with texts and thresholds."""
    e = view(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("item_no"), "embedding")
    text = F.concat(F.lit("criterion "), F.col("item_no").cast("string"))
    items = e.withColumn("criterion_text", text).withColumn("rupees", F.when(F.col("item_no") % 3 == 0, F.col("item_no") * 1000))
    items = items.withColumn("source_clause_ref", F.when(F.col("item_no") % 4 == 0, F.lit("4.1")).otherwise(F.lit("")))
    return items.where("item_no % 2 = 0"), items.where("item_no % 2 = 1")


THRESHOLD = 0.1  # test vectors are nearly orthogonal


@query(
    "E1_similar_pairs",
    "embeddings",
    f"""WITH {_SIDES} SELECT rs.document_id, rs.item_no AS rule_no, ms.item_no AS model_no, round(list_dot_product(rs.embedding::DOUBLE[], ms.embedding::DOUBLE[]), 6) AS similarity
    FROM rs JOIN ms ON rs.document_id = ms.document_id WHERE list_dot_product(rs.embedding::DOUBLE[], ms.embedding::DOUBLE[]) >= {THRESHOLD}""",
)
def similar_pairs(spark, d):
    return X.similar_pairs(*branch_items(spark, d), THRESHOLD).withColumn("similarity", F.round("similarity", 6))


@query("E1_merge_branches")
def merge_branches(spark, d):
    rows = X.merge_branches(*branch_items(spark, d), THRESHOLD)
    return rows.withColumn("sources", F.array_join("sources", ",")).withColumn("agreement_similarity", F.round("agreement_similarity", 6))


@query("E14_criteria_union")
def criteria_union(spark, d):
    rules, model = branch_items(spark, d)
    documents = view(spark, d, "part").select(F.col("p_size").alias("document_id")).distinct()
    rows = X.criteria_union(documents, X.merge_branches(rules, model, THRESHOLD))
    return rows.withColumn("agreement_score", F.round("agreement_score", 6))


@query(
    "E2_agreement_label",
    "evaluations",
    """WITH c AS (SELECT bidder_id, count_if(route = 'auto_commit') AS r, count_if(route = 'hitl_review') AS m, count_if(route = 'auto_commit' AND verdict = 'PASS') AS a FROM evaluations GROUP BY 1),
    k AS (SELECT *, least(a, m) AS g FROM c), s AS (SELECT *, CASE WHEN r = 0 AND m = 0 THEN 0.0 WHEN r = 0 OR m = 0 THEN 0.5 ELSE g / (r + m - g) END AS s FROM k)
    SELECT bidder_id, CASE WHEN r = 0 AND m = 0 THEN 'neither' WHEN m = 0 THEN 'rules_only' WHEN r = 0 THEN 'llm_only' WHEN s >= 0.6 THEN 'agree' WHEN s < 0.3 THEN 'disagree' ELSE 'partial' END AS label, round(s, 6) AS score FROM s""",
)
def agreement_label(spark, d):
    rows = view(spark, d, "evaluations").groupBy("bidder_id").agg(
        F.count_if(F.col("route") == "auto_commit").alias("r"), F.count_if(F.col("route") == "hitl_review").alias("m"),
        F.count_if((F.col("route") == "auto_commit") & (F.col("verdict") == "PASS")).alias("a"),
    )
    label, score = X.agreement_label(F.col("r"), F.col("m"), F.least("a", "m"))
    return rows.select("bidder_id", label.alias("label"), F.round(score, 6).alias("score"))


@query(
    "E3_L8_branch_counts",
    "embeddings",
    """WITH s AS (SELECT label AS document_id, vec_id % 3 AS k FROM embeddings) SELECT document_id, count_if(k = 0) AS rules_only, count_if(k = 1) AS llm_only, count_if(k = 2) AS both FROM s GROUP BY 1""",
)
def branch_counts(spark, d):
    k = F.col("vec_id") % 3
    sources = F.when(k == 0, F.array(F.lit("rules"))).when(k == 1, F.array(F.lit("llm"))).otherwise(F.array(F.lit("rules"), F.lit("llm")))
    return R.branch_counts(view(spark, d, "embeddings").select(F.col("label").alias("document_id"), sources.alias("sources")))


_RAW = """CASE vec_id % 4 WHEN 0 THEN concat('{"criterion_text":" item ', vec_id, ' ","criterion_type":"numeric_threshold","threshold_value":{"rupees":', vec_id, '},"is_mandatory":true}')
    WHEN 1 THEN '{"criterion_text":""}' WHEN 2 THEN concat('{"criterion_text":"item ', vec_id, '","gfr_override_permitted":false,"source_clause_ref":"4.2"}') ELSE 'no json' END"""


@query(
    "E4_normalise_model_criterion",
    "embeddings",
    """SELECT vec_id, concat('item ', vec_id) AS criterion_text, CASE WHEN vec_id % 4 = 0 THEN 'numeric_threshold' ELSE 'qualitative_assessment' END AS criterion_type, vec_id % 4 = 0 AS gfr_override_permitted,
        vec_id % 4 = 0 AS is_mandatory, CASE WHEN vec_id % 4 = 2 THEN '4.2' ELSE '' END AS source_clause_ref, CASE WHEN vec_id % 4 = 0 THEN vec_id END AS threshold_rupees, false AS needs_review FROM embeddings WHERE vec_id % 4 IN (0, 2)""",
)
def normalise_model_criterion(spark, d):
    return X.normalise_model_criterion(view(spark, d, "embeddings").select("vec_id", F.expr(_RAW).alias("raw")))


@query(
    "E5_E6_E7_confidences",
    "evidence",
    """WITH n AS (SELECT evaluation_id, project_count - 1 AS n, found AS ref, amount IS NULL AS failed, agreement, rules_verdict AS v FROM evidence),
    c AS (SELECT *, CASE WHEN n = 0 THEN 0.3 ELSE round(CASE WHEN ref THEN least(1.0, 0.5 + least(0.08 * n, 0.4) + 0.05) ELSE 0.5 + least(0.08 * n, 0.4) END, 3) END AS rc,
        CASE WHEN failed THEN 0.0 WHEN n = 0 THEN 0.3 ELSE round(0.6 + least(0.05 * n, 0.3), 3) END AS mc, CASE WHEN n % 3 = 0 THEN 'agree' WHEN n % 3 = 1 THEN 'disagree' ELSE 'partial' END AS ag FROM n)
    SELECT evaluation_id, rc AS rules_confidence, mc AS model_confidence, CASE WHEN mc = 0 THEN rc WHEN ag = 'agree' THEN round(least(1.0, sqrt(rc * mc) + 0.1), 3) WHEN ag = 'disagree' THEN round(least(rc, mc) * 0.7, 3) ELSE round((rc + mc) / 2, 3) END AS consensus FROM c""",
)
def confidences(spark, d):
    n = F.col("project_count") - 1
    rows = view(spark, d, "evidence").select(
        "evaluation_id", X.rules_confidence(n, F.col("found")).alias("rules_confidence"), X.model_confidence(n, F.col("amount").isNull()).alias("model_confidence"),
        F.when(n % 3 == 0, "agree").when(n % 3 == 1, "disagree").otherwise("partial").alias("ag"),
    )
    return rows.select("evaluation_id", "rules_confidence", "model_confidence", X.consensus_confidence(F.col("rules_confidence"), F.col("model_confidence"), F.col("ag")).alias("consensus"))


_AGREE = "CASE WHEN rules_verdict = model_verdict THEN 'agree' WHEN rules_verdict = 'REVIEW' OR model_verdict = 'REVIEW' THEN 'partial' ELSE 'disagree' END"
_CONSENSUS = "CASE WHEN rules_verdict = 'FAIL' OR model_verdict = 'FAIL' THEN 'REVIEW' WHEN rules_verdict = 'PASS' AND model_verdict = 'PASS' THEN 'PASS' WHEN rules_verdict = model_verdict THEN model_verdict ELSE 'REVIEW' END"


@query(
    "E8_E9_verdict_consensus",
    "evidence",
    f"SELECT evaluation_id, {_AGREE} AS agreement, CASE {_AGREE} WHEN 'agree' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END AS score, {_CONSENSUS} AS verdict FROM evidence",
)
def verdict_consensus(spark, d):
    label, score = X.verdict_agreement(F.col("rules_verdict"), F.col("model_verdict"))
    verdict = X.consensus_verdict(F.col("rules_verdict"), F.col("model_verdict"))
    return view(spark, d, "evidence").select("evaluation_id", label.alias("agreement"), score.alias("score"), verdict.alias("verdict"))


@query(
    "E10_replay_responses",
    "prompts response_log",
    """WITH l AS (SELECT prompt_hash, max_by(response, logged_at) AS response, max_by(model_version, logged_at) AS model_version FROM response_log GROUP BY 1)
    SELECT p.conv_id, p.turn, p.prompt_hash, l.response, l.model_version, l.response IS NOT NULL AS cache_hit FROM prompts p LEFT JOIN l ON l.prompt_hash = p.prompt_hash""",
)
def replay_responses(spark, d):
    rows = X.replay_responses(view(spark, d, "prompts"), view(spark, d, "response_log"))
    return rows.select("conv_id", "turn", "prompt_hash", "response", "model_version", "cache_hit")


_PLAIN = "regexp_replace(text, '[^A-Za-z ]', '', 'g')"


@query("E11_prompt_hash", "conversations", f"SELECT conv_id, turn, sha256(concat('{{\"prompt_type\":\"qualitative\",\"text\":\"', {_PLAIN}, '\"}}')) AS prompt_hash FROM conversations")
def prompt_hash(spark, d):
    plain = F.regexp_replace("text", "[^A-Za-z ]", "")
    return view(spark, d, "conversations").select("conv_id", "turn", X.prompt_hash(F.lit("qualitative"), plain).alias("prompt_hash"))


_WRAPPED = """CASE event_id % 5 WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 1 THEN concat('Here it is: ', props, ' as asked.') WHEN 2 THEN concat('[', event_id, ', 2]')
    WHEN 3 THEN concat('list [', event_id, '] end') ELSE 'nothing here' END"""


@query(
    "E12_repair_json",
    "events",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN replace(props, ': ', ':') WHEN 1 THEN replace(props, ': ', ':') WHEN 2 THEN concat('[', event_id, ',2]') WHEN 3 THEN concat('[', event_id, ']') END AS repaired FROM events""",
)
def repair_json(spark, d):
    return view(spark, d, "events").select("event_id", X.repair_json(F.expr(_WRAPPED)).alias("repaired"))


@query(
    "E13_E16_log_responses",
    "conversations",
    """SELECT conv_id AS tender_id, t.prompt_type, text AS prompt, role AS response, 'model-a' AS model_version, t.logged_at, 64 AS hash_digits
    FROM conversations, (VALUES ('qualitative_evaluation', '2024-05-01T00:00:00Z'), ('entity_disambiguation', '2024-05-02T00:00:00Z')) AS t(prompt_type, logged_at)""",
)
def log_responses(spark, d):
    """Qualitative and entity responses appended to the log and read back."""
    path = files.shared_folder(spark) + "/responses"
    rows = view(spark, d, "conversations").select(F.col("conv_id").alias("tender_id"), F.col("text").alias("prompt"), F.col("role").alias("response"))
    files.log_responses(X.response_log_rows(rows, "qualitative_evaluation", "model-a", "2024-05-01T00:00:00Z"), path)
    files.log_responses(X.response_log_rows(rows, "entity_disambiguation", "model-a", "2024-05-02T00:00:00Z"), path)
    return spark.read.parquet(path).select(
        "tender_id", "prompt_type", F.get_json_object("prompt_content", "$.text").alias("prompt"), "response", "model_version", "logged_at",
        F.length("prompt_hash").alias("hash_digits"),
    )


@query(
    "E15_qualitative_union",
    "evidence",
    f"""WITH q AS (SELECT evaluation_id, rules_verdict, extraction_confidence AS rc, CASE WHEN bidder_id % 4 = 0 THEN NULL ELSE model_verdict END AS mv, CASE WHEN bidder_id % 4 = 0 THEN 0.0 ELSE model_confidence END AS mc FROM evidence),
    k AS (SELECT *, coalesce(mv, 'REVIEW') AS model_verdict FROM q), a AS (SELECT *, {_AGREE} AS agreement, {_CONSENSUS} AS verdict FROM k)
    SELECT evaluation_id, verdict, agreement, CASE WHEN mc = 0 THEN rc WHEN agreement = 'agree' THEN round(least(1.0, sqrt(rc * mc) + 0.1), 3) WHEN agreement = 'disagree' THEN round(least(rc, mc) * 0.7, 3) ELSE round((rc + mc) / 2, 3) END AS confidence,
        concat('Semantic analysis: no specific factors identified. Rules-LLM ', agreement, '. Routing to officer review.') AS reasoning, CASE WHEN mv IS NULL THEN 'rules_only' ELSE 'rules+llm' END AS method FROM a""",
)
def qualitative_union(spark, d):
    silent = F.col("bidder_id") % 4 == 0
    rows = view(spark, d, "evidence").select(
        "evaluation_id", "rules_verdict", F.col("extraction_confidence").alias("rules_confidence"), F.when(~silent, F.col("model_verdict")).alias("model_verdict"),
        F.when(~silent, F.col("model_confidence")).alias("model_confidence"), F.lit(None).cast("string").alias("top_factor"), F.lit(None).cast("string").alias("model_reasoning"),
    )
    return X.qualitative_union(rows).select("evaluation_id", "verdict", "agreement", "confidence", "reasoning", "method")


# --- N: repeatability -------------------------------------------------------------------------


@query(
    "N1_diff_runs",
    "evaluations rerun",
    """WITH j AS (SELECT a.evaluation_id, a.verdict AS av, b.verdict AS bv, a.confidence AS ac, b.confidence AS bc, a.route AS ar, b.route AS br, a.source_bbox AS ab, b.source_bbox AS bb FROM evaluations a JOIN rerun b ON a.evaluation_id = b.evaluation_id)
    SELECT evaluation_id, 'verdict' AS field FROM j WHERE av <> bv UNION ALL SELECT evaluation_id, 'confidence' FROM j WHERE abs(ac - bc) > 1e-6
    UNION ALL SELECT evaluation_id, 'route' FROM j WHERE ar <> br UNION ALL SELECT evaluation_id, 'source_bbox' FROM j WHERE bb IS NULL""",
)
def diff_runs(spark, d):
    return N.diff_runs(view(spark, d, "evaluations"), view(spark, d, "rerun")).select("evaluation_id", "field")


_LINE = """concat('{{"bidder_id":', bidder_id, ',"confidence":', cast(confidence AS varchar), ',"criterion_id":', criterion_id, ',"route":"', route, '","source_bbox":', CASE WHEN source_bbox IS NULL THEN 'null' ELSE concat('"', replace(source_bbox, '"', '\\"'), '"') END,
    ',"source_document_id":"', source_document_id, '","source_page_number":', source_page_number, ',"verdict":"', verdict, '"}}')""".replace("{{", "{").replace("}}", "}")


@query("N2_run_hash", "evaluations", f"""WITH h AS (SELECT tender_id, sha256({_LINE}) AS h FROM evaluations),
    p AS (SELECT tender_id, substr(h, 1, 3) AS part, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM h GROUP BY 1, 2)
    SELECT tender_id, sum(n)::BIGINT AS n, sha256(string_agg(digest, '' ORDER BY part)) AS run_hash FROM p GROUP BY tender_id""")
def run_hash(spark, d):
    return N.run_hash(view(spark, d, "evaluations"))


_STORED = """s AS (SELECT upload_id AS document_id, tender_ref AS tender_id, CASE WHEN doc_key % 13 = 0 THEN NULL WHEN doc_key % 17 = 0 THEN repeat('f', 64) ELSE sha256(text) END AS stored_hash,
    CASE WHEN doc_key % 19 = 0 THEN NULL ELSE sha256(text) END AS actual FROM uploads),
    v AS (SELECT *, CASE WHEN stored_hash IS NULL THEN concat('Document ', document_id, ': no SHA-256 hash stored') WHEN actual <> stored_hash THEN concat('Document ', document_id, ': hash mismatch — stored=', substr(stored_hash, 1, 16), '..., actual=', substr(actual, 1, 16), '...') END AS issue FROM s)"""


def document_hash_checks(spark, d):
    rows = docs.hashed_uploads(spark, d)
    key = F.col("doc_key")
    stored = rows.select(F.col("upload_id").alias("document_id"), F.col("tender_ref").alias("tender_id"), F.when(key % 13 == 0, None).when(key % 17 == 0, F.lit("f" * 64)).otherwise(F.col("sha256_hash")).alias("stored_hash"))
    present = rows.where(key % 19 != 0).select(F.col("upload_id").alias("document_id"), "sha256_hash")
    return N.verify_document_hashes(stored, present)


@query("N3_verify_document_hashes", "uploads", f"WITH {_STORED} SELECT document_id, tender_id, issue FROM v")
def verify_document_hashes(spark, d):
    return document_hash_checks(spark, d).select("document_id", "tender_id", "issue")


@query("N3_document_integrity", "uploads", f"WITH {_STORED} SELECT tender_id, count(*) AS total_documents, count(*) - count(issue) AS verified_count, count(issue) = 0 AS passed FROM v GROUP BY tender_id")
def document_integrity(spark, d):
    return N.document_integrity(document_hash_checks(spark, d))


@query(
    "N4_model_version_consistency",
    "response_log",
    "SELECT tender_id, string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS versions, count(*) AS invocation_count, count(DISTINCT model_version) <= 1 AS passed FROM response_log GROUP BY tender_id",
)
def model_version_consistency(spark, d):
    return N.model_version_consistency(view(spark, d, "response_log")).withColumn("versions", F.array_join("versions", ","))


_INPUTS = """dc AS (SELECT tender_id, count_if(bidder_id % 29 = 0) AS u FROM bidders GROUP BY 1), cc AS (SELECT tender_id, count(*) AS n FROM criteria WHERE status <> 'extracted' GROUP BY 1),
    ec AS (SELECT tender_id, count(*) AS n, count_if(status = 'resolved' AND officer_decision IS NULL) AS x FROM evaluations GROUP BY 1),
    inputs AS (SELECT t.tender_id, coalesce(cc.n, 0) AS criteria_count, coalesce(ec.n, 0) AS evaluation_count, concat_ws('; ', CASE WHEN coalesce(u, 0) > 0 THEN concat(u, ' document(s) missing SHA-256 hash') END,
        CASE WHEN coalesce(cc.n, 0) = 0 THEN 'No criteria (ETS) stored for this tender' END, CASE WHEN coalesce(ec.n, 0) = 0 THEN 'No evaluations stored for this tender' END,
        CASE WHEN coalesce(x, 0) > 0 THEN concat(x, ' resolved evaluation(s) missing officer decision record') END) AS issues
    FROM tenders t LEFT JOIN dc ON dc.tender_id = t.tender_id LEFT JOIN cc ON cc.tender_id = t.tender_id LEFT JOIN ec ON ec.tender_id = t.tender_id)"""


@query("N5_stored_input_issues", "tenders bidders criteria evaluations", f"WITH {_INPUTS} SELECT * FROM inputs")
def stored_input_issues(spark, d):
    rows = input_issues(spark, d)
    return rows.select("tender_id", "criteria_count", "evaluation_count", F.array_join("issues", "; ").alias("issues"))


def input_issues(spark, d):
    documents = view(spark, d, "bidders").select("tender_id", F.when(F.col("bidder_id") % 29 == 0, "").otherwise("hash").alias("sha256_hash"))
    return N.stored_input_issues(view(spark, d, "tenders"), documents, view(spark, d, "criteria").where("status <> 'extracted'"), view(spark, d, "evaluations"))


def rerun_of(spark, d):
    keys = view(spark, d, "evaluations").select("evaluation_id", "tender_id")
    return N.with_line_hash(view(spark, d, "rerun")).join(keys, "evaluation_id")


def reproduced(spark, d):
    return plans.reproduce(view(spark, d, "evaluations"), rerun_of(spark, d))


_RERUN = """j AS (SELECT a.tender_id, a.evaluation_id, (a.verdict <> b.verdict)::INT + (abs(a.confidence - b.confidence) > 1e-6)::INT + (a.route <> b.route)::INT + (b.source_bbox IS NULL)::INT AS n FROM evaluations a JOIN rerun b ON a.evaluation_id = b.evaluation_id),
    again AS (SELECT tender_id, count(*) AS total, count_if(n = 0) AS matches, sum(n)::BIGINT AS differences, sum(n) = 0 AS match, sum(n) = 0 AS identical FROM j GROUP BY tender_id)"""


@query("N6_reproduce", "evaluations rerun", f"WITH {_RERUN} SELECT * FROM again")
def reproduce(spark, d):
    return reproduced(spark, d).select("tender_id", "total", "matches", "differences", "match", "identical")


@query(
    "N6_verify_reproducibility",
    "tenders bidders criteria evaluations rerun uploads response_log ledger_events",
    f"""WITH RECURSIVE {rp._CHAIN}, {_INPUTS}, {_RERUN}, {_STORED},
    led AS (SELECT tender_id, count_if(NOT json_valid(event_data)) = 0 AS ok FROM chained GROUP BY 1),
    docs_ok AS (SELECT try_cast(regexp_extract(tender_id, '(\\d+)', 1) AS BIGINT) AS tender_id, count(issue) = 0 AS ok FROM v GROUP BY tender_id),
    ver AS (SELECT tender_id, count(DISTINCT model_version) <= 1 AS ok FROM response_log GROUP BY 1),
    parts AS (SELECT i.tender_id, i.issues = '' AS inputs_ok, i.issues, coalesce(a.identical, true) AS rerun_ok, coalesce(led.ok, true) AS ledger_ok, coalesce(docs_ok.ok, true) AS documents_ok, coalesce(ver.ok, true) AS versions_ok
        FROM inputs i LEFT JOIN again a ON a.tender_id = i.tender_id LEFT JOIN led ON led.tender_id = i.tender_id LEFT JOIN docs_ok ON docs_ok.tender_id = i.tender_id LEFT JOIN ver ON ver.tender_id = i.tender_id)
    SELECT *, inputs_ok AND rerun_ok AND ledger_ok AND documents_ok AND versions_ok AS match FROM parts""",
)
def verify_reproducibility(spark, d):
    as_long = lambda rows: rows.withColumn("tender_id", F.regexp_extract(F.col("tender_id"), r"(\d+)", 1).try_cast("bigint"))
    integrity = as_long(N.document_integrity(document_hash_checks(spark, d))).where(F.col("tender_id").isNotNull())
    rows = plans.verify_reproducibility(
        reproduced(spark, d), N.ledger_check(rp.chained_ledger(spark, d)), integrity,
        N.model_version_consistency(view(spark, d, "response_log")), input_issues(spark, d),
    )
    return rows.withColumn("issues", F.array_join("issues", "; "))


@query(
    "N7_ledger_check",
    "ledger_events",
    f"""WITH RECURSIVE {rp._CHAIN} SELECT tender_id, 'audit_chain_integrity' AS "check", count_if(NOT json_valid(event_data)) = 0 AS passed,
        CASE WHEN count_if(NOT json_valid(event_data)) = 0 THEN concat('Hash chain intact across ', count(*), ' events')
        ELSE concat('Hash chain broken: Event ', min(event_id) FILTER (WHERE NOT json_valid(event_data)), ': event_data is not valid JSON') END AS message FROM chained GROUP BY tender_id""",
)
def ledger_check(spark, d):
    return N.ledger_check(rp.chained_ledger(spark, d))


# --- A15, L9: files ---------------------------------------------------------------------------


@query(
    "A15_L9_write_and_load_reports",
    "evaluations",
    f"""SELECT tender_id, count(*) AS total, count_if(status = 'auto_committed') AS auto_committed, count_if(status IN {rp._PEND}) AS pending,
        count_if(status = 'resolved') AS completed, sha256(concat('report|', tender_id)) AS report_id FROM evaluations GROUP BY tender_id""",
)
def write_and_load_reports(spark, d):
    folder = files.shared_folder(spark)
    files.write_table(view(spark, d, "evaluations"), f"{folder}/evaluations", buckets=4)
    summary = R.tender_summary(spark.read.parquet(f"{folder}/evaluations"))
    files.write_reports(summary, f"{folder}/reports")
    schema = "tender_id bigint, total bigint, auto_committed bigint, pending bigint, completed bigint, report_id string"
    return files.load_reports(spark, f"{folder}/reports", schema)


@query(
    "L9_officer_reason",
    "decisions",
    """SELECT decision_id, CASE WHEN officer_id = 'officer-1' THEN 'free words' ELSE reason END AS reason, CASE WHEN officer_id = 'officer-1' OR reason IS NULL THEN NULL ELSE 'note' END AS text FROM decisions""",
)
def officer_reason(spark, d):
    wrapped = F.to_json(F.struct("reason", F.lit("note").alias("text")))
    stored = F.when(F.col("officer_id") == "officer-1", F.lit("free words")).when(F.col("reason").isNotNull(), wrapped)
    reason, text = R.officer_reason(F.col("stored"))
    return view(spark, d, "decisions").withColumn("stored", stored).select("decision_id", reason.alias("reason"), text.alias("text"))


# --- R: streams -------------------------------------------------------------------------------


def stream_of(spark, d, table):
    """A provided table as a stream, whether it is one file or a folder of files."""
    # As a pattern, since a plain path of a stream must be a folder.
    return spark.readStream.schema(view(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]")


def _drain(spark, rows, name):
    folder = f"{files.shared_folder(spark)}/{name}"
    q = rows.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(
    "R1_ingest_stream",
    "uploads",
    f"""SELECT tender_ref, sha256(text) AS sha256_hash FROM uploads WHERE {docs._EXT} IN {docs._OK_EXT} AND doc_type IN ('nit','corrigendum','bidder_submission','certificate') GROUP BY ALL""",
)
def ingest_stream(spark, d):
    from ..sources.adapters import VIEWS

    uploads = spark.sql(VIEWS["uploads"], documents=stream_of(spark, d, "documents"))
    return _drain(spark, streams.ingest_stream(uploads, "400 days"), "ingest").select("tender_ref", "sha256_hash")


@query("R2_ledger_stream", "ledger_events", f"WITH RECURSIVE {rp._CHAIN} SELECT tender_id, event_id, prev_hash, entry_hash FROM chained")
def ledger_stream(spark, d):
    from ..sources.adapters import VIEWS

    folder = files.shared_folder(spark) + "/ledger-stream"
    events = spark.sql(VIEWS["ledger_events"], events=stream_of(spark, d, "events"))
    streams.ledger_stream(events, folder, f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/ledger").select("tender_id", "event_id", "prev_hash", "entry_hash")


@query(
    "R3_route_stream",
    "evidence criteria precedents",
    f"WITH {ev._JUDGED} SELECT evaluation_id, verdict, round(confidence, 6) AS confidence, route, CASE WHEN route = 'auto_commit' THEN 'auto_committed' ELSE 'pending_review' END AS status FROM routed",
)
def route_stream(spark, d):
    from ..sources.adapters import VIEWS

    rows = spark.sql(VIEWS["evidence"], lineitem=stream_of(spark, d, "lineitem"))
    criteria = view(spark, d, "criteria").select(*ev._CRITERION_COLUMNS)
    routed = streams.route_stream(rows, criteria, E.thresholds_from(view(spark, d, "precedents")))
    out = _drain(spark, routed.select("evaluation_id", "verdict", "confidence", "route", "status"), "route")
    return out.withColumn("confidence", F.round("confidence", 6))
