"""Verdicts, routing and explanations: row-local expressions over evidence rows.

Nothing here shuffles except ``evaluation_pairs`` and ``error_evaluations``; the
verdict, route and explanation columns run unchanged on a stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.common import format_rupees, lookup, to_rupees, two

DETERMINISTIC_TYPES = ["numeric_threshold", "categorical_presence", "temporal_recency"]


def evaluation_pairs(bidders: DataFrame, criteria: DataFrame, debarred: DataFrame | None = None) -> DataFrame:
    """Open bidders with the approved criteria of their tender."""
    open_bidders = bidders.where(F.col("status") != "excluded")
    if debarred is not None:
        open_bidders = open_bidders.join(debarred.select("bidder_id"), "bidder_id", "left_anti")
    approved = criteria.where(F.col("status") == "approved").drop("status")
    return open_bidders.select("tender_id", "bidder_id", "company_name").join(approved, "tender_id")


def numeric_threshold_rupees() -> Column:
    """The stored rupee threshold, else value times unit; 0 when undefined."""
    stored = F.col("threshold_rupees").cast("bigint")
    derived = to_rupees(F.col("threshold_value").cast("double"), F.col("threshold_unit"))
    return F.coalesce(F.when(stored != 0, stored), derived, F.lit(0).cast("bigint"))


def eval_numeric() -> Column:
    threshold, conf = numeric_threshold_rupees(), F.col("extraction_confidence")
    missing = ~F.col("has_value") | F.col("amount").isNull()
    return (
        F.when(missing, _verdict("REVIEW", F.lit(0.0)))
        .when(threshold <= 0, _verdict("REVIEW", conf))
        .when(F.col("amount") >= threshold, _verdict("PASS", conf))
        .otherwise(_verdict("FAIL", conf))
    )


def eval_categorical() -> Column:
    conf, valid = F.col("extraction_confidence"), F.col("is_valid")
    return (
        F.when(~F.col("has_value"), _verdict("REVIEW", F.lit(0.0)))
        .when(~F.coalesce(F.col("found"), F.lit(False)), _verdict("FAIL", conf))
        .when(valid.isNull(), _verdict("REVIEW", conf * F.lit(0.7)))
        .when(valid, _verdict("PASS", conf))
        .otherwise(_verdict("FAIL", conf))
    )


def eval_temporal() -> Column:
    conf = F.col("extraction_confidence")
    enough = F.coalesce(F.col("project_count"), F.lit(0)) >= F.coalesce(F.col("threshold_count"), F.lit(2))
    return (
        F.when(~F.col("has_value"), _verdict("REVIEW", F.lit(0.0)))
        .when(enough, _verdict("PASS", conf))
        .otherwise(_verdict("FAIL", conf))
    )


def eval_qualitative() -> Column:
    conf = F.least(F.col("extraction_confidence"), F.coalesce(F.col("model_confidence"), F.lit(0.5)))
    return F.when(~F.col("has_value"), _verdict("REVIEW", F.lit(0.0), "llm_stub")).otherwise(
        _verdict(F.coalesce(F.col("model_verdict"), F.lit("REVIEW")), conf, "llm_stub")
    )


def _verdict(verdict: Column | str, confidence: Column, method: str = "deterministic") -> Column:
    v = verdict if isinstance(verdict, Column) else F.lit(verdict)
    return F.struct(
        v.alias("verdict"), confidence.cast("double").alias("confidence"), F.lit(method).alias("evaluation_method")
    )


def evaluate_by_type() -> Column:
    """Struct of verdict, confidence and method; other types go to review."""
    kind = F.col("criterion_type")
    return (
        F.when(kind == "numeric_threshold", eval_numeric())
        .when(kind == "categorical_presence", eval_categorical())
        .when(kind == "temporal_recency", eval_temporal())
        .when(kind == "qualitative_assessment", eval_qualitative())
        .otherwise(_verdict("REVIEW", F.lit(0.0), "unknown"))
    )


def precedent_thresholds(precedent_count: Column, standard_from: int = P.PRECEDENTS_FOR_STANDARD_THRESHOLDS) -> tuple[Column, Column]:
    """(auto-commit threshold, review floor): the rule that sets them stricter while precedents are few.

    Routing takes the pair as an argument; this is one way for a caller to choose it.
    """
    few = precedent_count < standard_from
    pick = lambda i: F.when(few, P.CONSERVATIVE_THRESHOLDS[i]).otherwise(P.STANDARD_THRESHOLDS[i])
    return pick(0), pick(1)


def thresholds_from(precedents: DataFrame) -> tuple[Column, Column]:
    """Thresholds for a memory of precedents; its size enters as a scalar subquery, computed once."""
    return precedent_thresholds(precedents.agg(F.count(F.lit(1))).scalar())


def compute_route(
    verdict: Column, confidence: Column, criterion_type: Column, flags: Column, is_mandatory: Column, thresholds: tuple[Column, Column]
) -> Column:
    """Struct of route and reason by six ordered rules and a default.

    ``thresholds`` is the pair (auto-commit threshold, review floor).
    """
    auto, floor = thresholds

    def routed(route: str, *reason: Column | str) -> Column:
        text = F.concat(*[r if isinstance(r, Column) else F.lit(r) for r in reason])
        return F.struct(F.lit(route).alias("route"), text.alias("route_reason"))

    return (
        F.when(is_mandatory & (verdict == "FAIL"), routed("mandatory_review", "Mandatory criterion FAIL requires officer confirmation"))
        .when(F.size(flags) > 0, routed("mandatory_review", "Flags present: ", F.array_join(flags, ", ")))
        .when(confidence < floor, routed("mandatory_review", "Confidence ", two(confidence), " below mandatory floor ", two(floor)))
        .when((criterion_type == "qualitative_assessment") & (verdict == "FAIL"), routed("hitl_review", "LLM-based FAIL verdict requires officer review"))
        .when(confidence < auto, routed("hitl_review", "Confidence ", two(confidence), " below auto-commit threshold ", two(auto)))
        .when(criterion_type.isin(*DETERMINISTIC_TYPES), routed("auto_commit", "High confidence deterministic evaluation"))
        .otherwise(routed("hitl_review", "Qualitative assessment requires review"))
    )


def case_flags() -> Column:
    return F.when(F.col("entity_match_flag"), F.array(F.lit("entity_mismatch"))).otherwise(F.array().cast("array<string>"))


def status_from_route(route: Column) -> Column:
    return F.when(route == "auto_commit", "auto_committed").otherwise("pending_review")


def with_verdicts(evidence: DataFrame, thresholds: tuple[Column, Column]) -> DataFrame:
    """Evidence rows plus verdict, confidence, method, route, reason and status."""
    judged = evidence.withColumn("_v", evaluate_by_type()).withColumn("_auto", thresholds[0]).withColumn("_floor", thresholds[1])
    routed = judged.select(
        *[c for c in evidence.columns if c not in ("evaluation_method",)],
        *( [F.col("evaluation_method").alias("evidence_method")] if "evaluation_method" in evidence.columns else []),
        "_v.*",
        "_auto",
        "_floor",
    ).withColumn(
        "_r",
        compute_route(
            F.col("verdict"), F.col("confidence"), F.col("criterion_type"), case_flags(), F.col("is_mandatory"), (F.col("_auto"), F.col("_floor"))
        ),
    )
    return routed.select("*", "_r.*").drop("_r", "_auto", "_floor").withColumn("status", status_from_route(F.col("route")))


def error_evaluations(requested: DataFrame, criteria: DataFrame) -> DataFrame:
    """Requested cases whose criterion is unknown, as review rows."""
    missing = requested.join(criteria.select("criterion_id"), "criterion_id", "left_anti")
    return missing.select(
        "tender_id",
        "bidder_id",
        "criterion_id",
        F.lit("REVIEW").alias("verdict"),
        F.lit(0.0).alias("confidence"),
        F.lit("error").alias("evaluation_method"),
        F.lit("mandatory_review").alias("route"),
        F.lit("Error: criterion_not_found").alias("routing_reason"),
        F.lit("pending_review").alias("status"),
    )


# --- explanations -------------------------------------------------------------------


def float_text(value: Column) -> Column:
    """A double with at least one decimal and no exponent."""
    plain = F.regexp_replace(value.cast("decimal(30,6)").cast("string"), "0+$", "")
    return F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)


def _clause(default: str) -> Column:
    ref = F.col("source_clause_ref")
    return F.when(F.length(ref) > 0, ref).otherwise(F.lit(default))


def _facts(*facts: Column) -> Column:
    """Facts in order; null facts are left out."""
    return F.filter(F.array(*facts), lambda f: f.isNotNull())


def _threshold_text() -> Column:
    rupees = F.col("threshold_rupees")
    stored = F.concat_ws(" ", F.coalesce(float_text(F.col("threshold_value").cast("double")), F.lit("unknown")), F.col("threshold_unit"))
    return F.when(F.coalesce(rupees, F.lit(0)) != 0, format_rupees(rupees)).otherwise(F.trim(stored))


def numeric_explanation() -> tuple[Column, Column]:
    v, clause, threshold = F.col("verdict"), _clause("the relevant clause"), _threshold_text()
    extracted, year = format_rupees(F.col("amount")), F.col("fiscal_year")
    phrase = F.coalesce(F.concat(F.lit(" (FY "), year, F.lit(")")), F.lit(""))
    line = lambda words: F.concat(extracted, phrase, F.lit(words), threshold, F.lit(" threshold set by "), clause, F.lit("."))
    headline = (
        F.when(v == "PASS", line(" meets the "))
        .when(v == "FAIL", line(" falls short of the "))
        .otherwise(F.concat(F.lit("Numeric value for "), clause, F.lit(" could not be determined with sufficient confidence.")))
    )
    has_rupees = F.coalesce(F.col("threshold_rupees"), F.lit(0)) != 0
    raw = F.when(F.length("unit") > 0, F.concat(F.lit("Raw extraction: "), float_text(F.col("raw_value")), F.lit(" "), F.col("unit")))
    facts = _facts(
        F.concat(F.lit("Extracted figure: "), extracted),
        F.when(F.col("amount").isNotNull(), raw),
        F.concat(F.lit("Fiscal year on record: "), year),
        F.when(has_rupees, F.concat(F.lit("Required threshold: "), threshold)).when(
            F.col("threshold_value").isNotNull(), F.concat(F.lit("Threshold data: "), threshold)
        ),
    )
    return headline, facts


def categorical_explanation() -> tuple[Column, Column]:
    v, clause, valid = F.col("verdict"), _clause("the relevant clause"), F.col("is_valid")
    kind = F.coalesce(F.upper(F.col("certificate_type")), F.lit("certificate"))
    number = F.coalesce(F.col("registration_number"), F.lit("not located"))
    headline = (
        F.when(
            v == "PASS",
            F.concat(kind, F.lit(" certificate found"), F.when(valid, F.lit(" and valid")).otherwise(F.lit("")), F.lit("; satisfies "), clause, F.lit(".")),
        )
        .when((v == "FAIL") & ~F.col("found"), F.concat(F.lit("Required "), kind, F.lit(" certificate not found in bidder submission; "), clause, F.lit(" not satisfied.")))
        .when(v == "FAIL", F.concat(kind, F.lit(" certificate found but does not satisfy validity requirements of "), clause, F.lit(".")))
        .otherwise(F.concat(kind, F.lit(" certificate status could not be determined with confidence; needs officer review.")))
    )
    facts = _facts(
        F.concat(F.lit("Certificate type: "), kind),
        F.concat(F.lit("Registration number: "), number),
        F.concat(F.lit("Validity date on document: "), F.col("validity_date")),
        F.when(valid, F.lit("Currently valid (expiry after today)")).when(~valid, F.lit("Expired as of today")),
    )
    return headline, facts


def temporal_explanation(projects: Column | None = None) -> tuple[Column, Column]:
    v, clause = F.col("verdict"), _clause("the relevant clause")
    count = F.coalesce(F.col("project_count"), F.lit(0)).cast("string")
    required = F.coalesce(F.col("threshold_count"), F.lit(2)).cast("string")
    period = F.coalesce(F.col("threshold_period"), F.lit("the required window"))
    headline = (
        F.when(v == "PASS", F.concat(F.lit("Bidder documented "), count, F.lit(" similar projects within "), period, F.lit(" — meets the minimum of "), required, F.lit(" required by "), clause, F.lit(".")))
        .when(v == "FAIL", F.concat(F.lit("Only "), count, F.lit(" similar projects found within "), period, F.lit("; "), clause, F.lit(" requires at least "), required, F.lit(".")))
        .otherwise(F.concat(F.lit("Could not reliably count similar projects within "), period, F.lit("; officer review required.")))
    )
    facts = _facts(F.concat(F.lit("Projects located: "), count), F.concat(F.lit("Required minimum: "), required))
    if projects is not None:
        listed = F.transform(
            F.slice(F.coalesce(projects, F.array().cast(_PROJECTS)), 1, 3),
            lambda p: F.concat(
                F.lit("• "), F.substring(p["description"], 1, 80), F.lit(" — completed "), F.coalesce(p["completion_date"], F.lit("date unknown"))
            ),
        )
        # The list holds what is printed; how many there are is counted apart.
        rest = F.col("project_count") - F.size(listed)
        more = F.when((rest > 0) & (F.size(listed) > 0), F.concat(F.lit("… and "), rest.cast("string"), F.lit(" more")))
        facts = F.concat(facts, listed, _facts(more))
    return headline, facts


_PROJECTS = "array<struct<description:string,amount:bigint,completion_date:string,confidence:double>>"


def qualitative_explanation(columns: list[str]) -> tuple[Column, Column]:
    v, clause = F.col("verdict"), _clause("the clause")
    got = lambda c: F.col(c) if c in columns else F.lit(None).cast("string")
    subject = F.concat(F.lit("Bidder's submission against "), clause)
    headline = (
        F.when(v == "PASS", F.concat(subject, F.lit(" satisfies the qualitative requirements; consensus verdict PASS.")))
        .when(v == "FAIL", F.concat(subject, F.lit(" does not satisfy the qualitative requirements; consensus verdict FAIL.")))
        .otherwise(F.concat(F.lit("Qualitative assessment for "), clause, F.lit(" is inconclusive; officer judgment required.")))
    )
    consensus, reasoning, quote = got("consensus_verdict"), got("reasoning"), got("key_quote")
    facts = _facts(
        F.concat(F.lit("Rules branch (semantic): "), got("rules_verdict")),
        F.concat(F.lit("LLM branch: "), got("branch_verdict")),
        F.concat(F.lit("Branch agreement: "), got("agreement")),
        F.when(consensus != v, F.concat(F.lit("Consensus verdict recorded: "), consensus)),
        F.when(F.length(reasoning) > 0, F.concat(F.lit("LLM reasoning: "), F.substring(reasoning, 1, 220))),
        F.when(F.length(quote) > 0, F.concat(F.lit('Key passage: "'), F.substring(quote, 1, 220), F.lit('"'))),
    )
    return headline, facts


def _flag_facts() -> Column:
    mismatch = F.coalesce(F.col("mismatch_type"), F.lit("mismatch"))
    return _facts(
        F.when(
            F.col("entity_match_flag"),
            F.concat(
                F.lit("⚠ Entity mismatch: registered '"), F.coalesce(F.col("registered_name"), F.lit("registered bidder name")),
                F.lit("' vs. extracted '"), F.coalesce(F.col("extracted_name"), F.lit("name on documents")),
                F.lit("' (type: "), mismatch, F.lit(")."),
            ),
        )
    )


def source_reference() -> Column:
    name = F.coalesce(F.col("source_filename"), F.lit("bidder submission"))
    page = F.col("source_page_number").cast("string")
    first = F.coalesce(F.concat(F.lit("Page "), page, F.lit(" of "), name), name)
    ref = F.col("source_clause_ref")
    return F.concat_ws(", ", first, F.when(F.length(ref) > 0, F.concat(F.lit("clause "), ref)))


def confidence_note() -> Column:
    method = F.coalesce(F.col("evidence_method"), F.lit("deterministic"))
    phrase = lookup(
        method,
        {
            "deterministic": "via regex / table extraction",
            "union_rules+llm": "via rules+LLM cross-validation",
            "llm_stub": "via LLM qualitative reasoning",
            "none": "with no evidence captured",
            "error": "after an extraction error",
        },
        F.concat(F.lit("via "), method),
    )
    kind = F.col("criterion_type")
    parts = F.concat_ws(
        ", ",
        F.concat(F.lit("Extracted "), phrase),
        F.concat(F.lit("at "), two(F.col("extraction_confidence")), F.lit(" extraction confidence")),
        F.concat(F.lit("(page OCR confidence "), two(F.col("ocr_confidence")), F.lit(")")),
        F.when(F.length(kind) > 0, F.concat(F.lit("for "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" criterion"))),
    )
    return F.concat(parts, F.lit("."))


def next_action(route: Column) -> Column:
    return lookup(
        route,
        {
            "auto_commit": "Auto-committed — no officer action required.",
            "hitl_review": "Officer confirmation required.",
            "mandatory_review": "Mandatory officer review required. Auto-commit blocked by rule.",
        },
        "Routing decision pending.",
    )


def with_explanation(cases: DataFrame) -> DataFrame:
    """Cases with verdicts plus headline, facts, references and the officer narrative."""
    columns = cases.columns
    for optional in ("mismatch_type",):
        if optional not in columns:
            cases = cases.withColumn(optional, F.lit(None).cast("string"))
    projects = F.col("projects") if "projects" in columns else None
    kinds = {
        "numeric_threshold": numeric_explanation(),
        "categorical_presence": categorical_explanation(),
        "temporal_recency": temporal_explanation(projects),
        "qualitative_assessment": qualitative_explanation(columns),
    }
    headline = facts = None
    for kind, (h, f) in kinds.items():
        hit = F.col("criterion_type") == kind
        headline = F.when(hit, h) if headline is None else headline.when(hit, h)
        facts = F.when(hit, f) if facts is None else facts.when(hit, f)
    text = F.coalesce(F.col("criterion_text"), F.lit("criterion"))
    headline = headline.otherwise(F.concat(F.lit("Verdict "), F.col("verdict"), F.lit(" recorded for "), text, F.lit(".")))
    facts = F.concat(facts.otherwise(F.array().cast("array<string>")), _flag_facts())
    out = (
        cases.withColumn("headline", headline)
        .withColumn("facts", facts)
        .withColumn("source_reference", source_reference())
        .withColumn("confidence_note", confidence_note())
        .withColumn("next_action", next_action(F.col("route")))
    )
    v, route = F.col("verdict"), F.col("route")
    why = (
        F.when(
            F.col("is_mandatory") & (v == "FAIL"),
            " This is a mandatory criterion, so the FAIL verdict cannot be auto-committed and must be reviewed by the officer.",
        )
        .when(
            F.col("entity_match_flag"),
            " A potential entity-match issue was flagged, which triggers mandatory officer review regardless of verdict.",
        )
        .otherwise("")
    )
    step = (
        F.when(route == "auto_commit", F.lit("Auto-committed — no officer action required."))
        .when(route == "mandatory_review", F.concat(F.lit("Officer confirmation required."), why))
        .otherwise(F.lit("Routed for officer review before this verdict is finalised."))
    )
    rule = F.coalesce(F.col("gfr_rule_number"), F.lit("the applicable GFR rule"))
    caveat = F.when((v == "FAIL") & ~F.col("gfr_override_permitted"), F.concat(F.lit("Override is not permitted under "), rule, F.lit(".")))
    return out.withColumn("detail", F.concat_ws(" ", F.col("headline"), F.col("confidence_note"), step, caveat))


def wrap_value(value: Column, explanation: Column) -> Column:
    """Stored form of an extracted value: the value and its explanation in one JSON text."""
    return F.to_json(F.struct(value.alias("__value__"), explanation.alias("__explanation__")), {"ignoreNullFields": "false"})


def unwrap_value(stored: Column) -> tuple[Column, Column]:
    """(value, explanation) texts; a bare stored value is returned as it is."""
    parsed = F.try_parse_json(stored)
    wrapped = F.get_json_object(stored, "$.__explanation__")
    value = F.when(wrapped.isNotNull(), F.get_json_object(stored, "$.__value__")).otherwise(stored)
    return F.when(F.length(stored) > 0, value), F.when(parsed.isNotNull(), wrapped)
