"""Column functions over tender text: clauses, requirement types, rule citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .common import collapse, contains_any, group, groups, let, lookup, null_if_empty, strip

_MARK = "\x01"


def split_clauses(text: Column) -> Column:
    """``ARRAY<STRUCT<clause_ref, body>>``: numbered clauses, else paragraphs, else sentences."""

    def numbered(refs: Column) -> Column:
        # The text before the first marker is dropped.
        bodies = F.slice(F.split(text, P.CLAUSE_MARKER, -1), F.lit(2), F.greatest(F.size(refs), F.lit(1)))
        return F.filter(
            F.zip_with(refs, bodies, lambda r, b: F.struct(strip(r).alias("clause_ref"), strip(b).alias("body"))),
            lambda c: F.length(c["body"]) > 0,
        )

    def plain(parts: Column) -> Column:
        kept = F.filter(F.transform(parts, strip), lambda p: F.length(p) > 0)
        return F.transform(kept, lambda p: F.struct(F.lit("").alias("clause_ref"), p.alias("body")))

    # No lookaround: mark each sentence gap first, then split on the mark.
    sentences = plain(F.split(F.regexp_replace(text, P.SENTENCE_GAP, f"$1{_MARK}$2"), _MARK, -1))
    unnumbered = let(
        plain(F.split(text, P.PARAGRAPH_GAP, -1)),
        lambda paragraphs: F.when(F.size(paragraphs) > 1, paragraphs).otherwise(sentences),
    )
    return let(
        let(groups(text, P.CLAUSE_MARKER, 1), numbered),
        lambda clauses: F.when(F.size(clauses) > 0, clauses).otherwise(unnumbered),
    )


# Literals without which a pattern cannot match: a cheap test in front of each regex.
_HINTS = {
    **dict(zip(P.NUMERIC_PATTERNS, [["turnover"], ["worth"], ["emd", "earnest", "security"], ["work", "contract", "project"]])),
    **dict(
        zip(
            P.CATEGORICAL_PATTERNS,
            [
                ["gst", "goods"], ["pan", "account"], ["iso"], ["msme", "udyam", "ssi", "aadhaar"], ["cin", "corporate"],
                ["tan", "deduction"], ["epf", "provident", "esi"], ["shop"], ["fssai", "food"], ["drug", "20b"],
                ["certificate"], ["pollution", "pcc"],
            ],
        )
    ),
    P.TEMPORAL_COUNT_PATTERN: ["last", "preceding", "previous"],
    P.TEMPORAL_EXPERIENCE_PATTERN: ["experience"],
}


def hinted_groups(text: Column, lowered: Column, pattern: str, index: int) -> Column:
    """``groups`` behind the literal test of the pattern; the result is the same."""
    hit = contains_any(lowered, _HINTS[pattern])
    return F.when(hit, groups(text, pattern, index)).otherwise(F.array().cast("array<string>"))


def classify_type(text: Column) -> Column:
    """Requirement type by the first pattern family that hits."""
    t = F.lower(text)

    def hit(ps: list[str]) -> Column:
        return reduce(lambda a, b: a | b, [contains_any(t, _HINTS[p]) & t.rlike(p) for p in ps])

    return (
        F.when(hit(P.NUMERIC_PATTERNS), "numeric_threshold")
        .when(hit([P.TEMPORAL_COUNT_PATTERN, P.TEMPORAL_EXPERIENCE_PATTERN]), "temporal_recency")
        .when(hit(P.CATEGORICAL_PATTERNS), "categorical_presence")
        .otherwise("qualitative_assessment")
    )


def _explicitly_mandatory(lowered: Column) -> Column:
    return F.contains(lowered, F.lit("mandatory")) | F.contains(lowered, F.lit("pre-qualification"))


def is_rule_mandatory(text: Column, criterion_type: Column) -> Column:
    t = F.lower(text)
    keyword = contains_any(t, [k for k, _ in P.MANDATORY_KEYWORDS])
    return _explicitly_mandatory(t) | (criterion_type.isin("numeric_threshold", "categorical_presence") & keyword)


def rule_number(text: Column, criterion_type: Column) -> Column:
    """The cited rule, else the rule of the first keyword (amount and document types only)."""
    t = F.lower(text)
    cited = null_if_empty(group(t, P.RULE_CITATION, 1))
    keyword = None
    for word, rule in P.MANDATORY_KEYWORDS:
        hit = F.contains(t, F.lit(word))
        keyword = F.when(hit, rule) if keyword is None else keyword.when(hit, rule)
    return F.coalesce(
        F.concat(F.lit("GFR Rule "), cited),
        F.when(criterion_type.isin("numeric_threshold", "categorical_presence"), keyword),
    )


def normalise_doc_key(document: Column) -> Column:
    """One key per required document, whatever its wording."""
    t = collapse(F.regexp_replace(F.lower(strip(document)), P.DOC_KEY_QUALIFIERS, ""))
    expr = None
    for key, forms in P.DOC_KEY_ALIASES:
        hit = contains_any(t, forms)
        expr = F.when(hit, key) if expr is None else expr.when(hit, key)
    return expr.otherwise(t)


def evidence_types(label: Column) -> Column:
    """Documents that can prove an amount requirement."""
    t = F.lower(F.coalesce(label, F.lit("")))
    pair = lambda a, b: F.array(F.lit(a), F.lit(b))
    return (
        F.when(contains_any(t, ["turnover", "net worth"]), pair("ca_certificate", "audited_balance_sheet"))
        .when(contains_any(t, ["emd", "earnest", "bid security"]), pair("emd_receipt", "bank_guarantee"))
        .when(contains_any(t, ["work", "contract", "project"]), pair("work_order", "completion_certificate"))
        .otherwise(F.array().cast("array<string>"))
    )


def measurement_period(text: Column) -> Column:
    n = group(text, P.MEASUREMENT_PERIOD, 1)
    return F.when(F.length(n) > 0, F.concat(n, F.lit(" "), F.lower(group(text, P.MEASUREMENT_PERIOD, 2))))


def trim_sentence(text: Column, limit: int = 400) -> Column:
    t = collapse(text)
    return F.when(F.length(t) <= limit, t).otherwise(
        F.concat(F.rtrim(F.substring(t, 1, limit - 1)), F.lit("…"))
    )


def amendment_indicators(text: Column, phrases: list[str] | None = None) -> Column:
    """Amendment phrases present in the text, in list order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    listed = F.array(*[F.lit(p) for p in (phrases or P.AMENDMENT_INDICATORS)])
    return F.filter(listed, lambda p: F.contains(t, p))


def event_progress(status: Column) -> Column:
    """Share of the tender workflow that is done, in percent."""
    return lookup(status, P.PROGRESS_PCT, 0)
