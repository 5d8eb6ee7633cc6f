"""Criteria from tender text: clause rows, requirement matches, de-duplication.

All matching is row-local on the clause; the only shuffle is the one that drops
repeats within a document, and it carries one partial row per repeated criterion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import patterns as P
from ..functions.common import group, let, parse_amount, to_rupees, word_to_int

_MATCH = (
    "struct<criterion_type:string,label:string,value:double,unit:string,rupees:bigint,document:string,doc_key:string,"
    "count:bigint,period:bigint,period_unit:string,what:string,assessment_text:string,measurement_period:string>"
)


def split_clauses(documents: DataFrame) -> DataFrame:
    """(document, ord, clause_ref, body) rows of every document text."""
    rows = documents.where(F.length(F.trim("text")) > 0)
    keys = [c for c in documents.columns if c != "text"]
    return rows.select(*keys, F.posexplode(C.split_clauses(F.col("text"))).alias("ord", "_c")).select(
        *keys, "ord", F.col("_c.clause_ref").alias("clause_ref"), F.col("_c.body").alias("body")
    )


def _match(**fields: Column) -> Column:
    names = [f.split(":")[0] for f in _MATCH[len("struct<") : -1].split(",")]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(_MATCH)


def numeric_matches(body: Column, lowered: Column) -> Column:
    """One entry per amount requirement, family by family."""
    period = C.measurement_period(body)

    def entry(m: Column, pattern: str) -> Column:
        value = F.coalesce(parse_amount(group(m, pattern, 2)), F.lit(0.0))
        unit = F.lower(group(m, pattern, 3))
        return _match(
            criterion_type=F.lit("numeric_threshold"), label=F.trim(group(m, pattern, 1)), value=value, unit=unit,
            rupees=to_rupees(value, unit), measurement_period=period,
        )

    def family(pattern: str) -> Column:
        return F.transform(C.hinted_groups(body, lowered, pattern, 0), lambda m: entry(m, pattern))

    return F.concat(*[family(p) for p in P.NUMERIC_PATTERNS])


def temporal_matches(body: Column, lowered: Column) -> Column:
    """Counted works in a period, and years of experience (count 0)."""

    def entry(count: Column, what: Column, period: Column, unit: Column) -> Column:
        p, u = F.coalesce(period.try_cast("bigint"), F.lit(0)), F.lower(unit)
        return _match(
            criterion_type=F.lit("temporal_recency"), count=count, what=F.trim(what), period=p, period_unit=u,
            measurement_period=F.concat(p.cast("string"), F.lit(" "), u),
        )

    a, b = P.TEMPORAL_COUNT_PATTERN, P.TEMPORAL_EXPERIENCE_PATTERN
    counted = F.transform(C.hinted_groups(body, lowered, a, 0), lambda m: entry(word_to_int(group(m, a, 1)), group(m, a, 2), group(m, a, 3), group(m, a, 4)))
    years = F.transform(C.hinted_groups(body, lowered, b, 0), lambda m: entry(F.lit(0), group(m, b, 1), group(m, b, 2), group(m, b, 3)))
    return F.concat(counted, years)


def categorical_matches(body: Column, lowered: Column) -> Column:
    """Required documents, one entry per canonical key within the clause."""
    found = F.concat(*[C.hinted_groups(body, lowered, p, 1) for p in P.CATEGORICAL_PATTERNS])

    def first_of_key(docs: Column) -> Column:
        return let(
            F.transform(docs, C.normalise_doc_key),
            lambda keys: F.transform(
                F.filter(
                    F.transform(docs, lambda d, i: F.struct(d.alias("d"), F.get(keys, i).alias("k"), i.alias("i"))),
                    lambda e: (F.length(e["k"]) > 0) & (F.array_position(keys, e["k"]) == e["i"] + 1),
                ),
                lambda e: _match(criterion_type=F.lit("categorical_presence"), document=e["d"], doc_key=e["k"]),
            ),
        )

    return let(F.transform(found, F.trim), first_of_key)


def qualitative_match(body: Column) -> Column:
    """The first wording pattern that hits, as an array of at most one entry."""
    hit = F.coalesce(*[F.nullif(group(body, p, 0), F.lit("")) for p in P.QUALITATIVE_PATTERNS])
    return let(
        hit,
        lambda h: F.when(
            h.isNotNull(), F.array(_match(criterion_type=F.lit("qualitative_assessment"), assessment_text=F.trim(h)))
        ).otherwise(F.array().cast(f"array<{_MATCH}>")),
    )


def match_clauses(clauses: DataFrame) -> DataFrame:
    """Every requirement of every clause in emission order; wording only when nothing else hit."""
    body, low = F.col("body"), F.col("_low")
    rows = clauses.withColumn("_low", F.lower(body))
    strong = F.concat(numeric_matches(body, low), temporal_matches(body, low), categorical_matches(body, low))
    rows = rows.withColumn("_strong", strong)
    matches = F.when(F.size("_strong") > 0, F.col("_strong")).otherwise(qualitative_match(body))
    return rows.select(*clauses.columns, F.posexplode(matches).alias("match_no", "_m")).select(*clauses.columns, "match_no", "_m.*")


def threshold_signature() -> Column:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind = F.col("criterion_type")
    return (
        F.when(kind == "numeric_threshold", F.concat(F.lit("num:"), text("label"), F.lit(":"), text("rupees")))
        .when(kind == "categorical_presence", F.concat(F.lit("doc:"), F.lower(F.col("document"))))
        .when(kind == "temporal_recency", F.concat(F.lit("tmp:"), text("count"), F.lit(":"), text("period"), F.lit(":"), text("period_unit")))
        .otherwise(F.concat(F.lit("qual:"), F.col("assessment_text")))
    )


def dedupe_criteria(matches: DataFrame) -> DataFrame:
    """First occurrence of (type, signature, clause) in a document, in emission order."""
    keys = ["document_id", "criterion_type", "signature", "clause_ref"]
    rows = matches.withColumn("signature", threshold_signature())
    rest = [c for c in rows.columns if c not in (*keys, "ord", "match_no")]
    first = F.min_by(F.struct("ord", "match_no", *rest), F.struct("ord", "match_no")).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, "_first.*")


def extract_criteria(documents: DataFrame) -> DataFrame:
    """Criteria of every tender document with rule citation, mandatory flag and evidence kinds."""
    rows = dedupe_criteria(match_clauses(split_clauses(documents)))
    body, kind = F.col("body"), F.col("criterion_type")
    mandatory = C.is_rule_mandatory(body, kind)
    kinds = (
        F.when(kind == "numeric_threshold", C.evidence_types(F.col("label")))
        .when(kind == "temporal_recency", F.array(F.lit("completion_certificate"), F.lit("work_order")))
        .when(kind == "categorical_presence", F.array(F.lit("certificate")))
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        rows.withColumn("criterion_text", C.collapse(body))
        .withColumn("criterion_display", C.trim_sentence(body))
        .withColumn("is_mandatory", mandatory)
        .withColumn("gfr_override_permitted", ~mandatory)
        .withColumn("gfr_rule_number", C.rule_number(body, kind))
        .withColumn("acceptable_evidence_types", kinds)
        .withColumn("status", F.lit("extracted"))
        .withColumn("criterion_id", F.sha2(F.concat_ws("|", "document_id", "clause_ref", "criterion_type", "signature"), 256))
        .drop("body", "doc_key")
    )


def extraction_confidence(documents: DataFrame, criteria: DataFrame) -> DataFrame:
    """0.3 without criteria, else 0.4 plus 0.1 per criterion, at most 0.95."""
    counts = criteria.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return documents.select("document_id").join(counts, "document_id", "left").na.fill(0, ["n"]).withColumn(
        "confidence", F.when(n == 0, 0.3).otherwise(F.round(F.least(0.4 + 0.1 * n, F.lit(0.95)), 6))
    )


def missing_corrigenda(documents: DataFrame, corrigenda: DataFrame) -> DataFrame:
    """Documents that mention an amendment while their tender has no corrigendum."""
    phrases = C.amendment_indicators(F.col("text"), P.BUILDER_AMENDMENT_INDICATORS)
    rows = documents.withColumn("indicators", phrases).where(F.size("indicators") > 0)
    return rows.join(corrigenda.select("tender_id"), "tender_id", "left_anti")
