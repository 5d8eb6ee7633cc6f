"""Evidence from bid documents for every (bidder, criterion) pair.

The unit of text is the file.  Each file is read once; what it offers is reduced per
bidder with partial aggregates (first or best by a fixed order), so a bidder with any
number of files is never gathered in one place, and the text is not scanned again for
every criterion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bidtext as B
from ..functions import patterns as P
from ..functions.common import let, lookup

_DOC_ORDER = ["uploaded_at", "document_id"]


def document_facts(documents: DataFrame) -> DataFrame:
    """Everything one file offers: amount, identifiers, dates, name, projects."""
    t = F.col("text")
    numbers = B.registration_numbers(t)
    keep = [c for c in documents.columns if c != "text"]
    return documents.select(
        *keep,
        B.numeric_value(t).alias("numeric"),
        *[v.alias(f"reg_{k}") for k, v in numbers.items()],
        F.when(t.rlike(P.VALIDITY_CUE), F.struct(F.regexp_extract(t, P.VALIDITY_CUE, 1).alias("region"))).alias("cue"),
        *[m.alias(f"date_{i}") for i, m in enumerate(B.date_matches(t))],
        B.company_name_candidate(t).alias("company"),
        B.prose_projects(t).alias("projects"),
    )


def bidder_profile(facts: DataFrame, as_of: str) -> DataFrame:
    """One row per bidder: the first or best of what its files offer, in upload order."""
    order = F.struct(*_DOC_ORDER)

    def first(column: str) -> Column:
        c = F.col(column)
        return F.min_by(c, F.when(c.isNotNull(), order))

    best = F.min_by(F.col("numeric"), F.when(F.col("numeric").isNotNull(), F.struct((-F.col("numeric.quality")).alias("q"), *_DOC_ORDER)))
    name = F.min_by(F.col("company"), F.when(F.col("company").isNotNull(), F.struct(F.col("company.rank"), *_DOC_ORDER)))

    def source(kind: str) -> Column:
        return F.min_by("document_id", F.struct((F.col("doc_type") != kind).alias("other"), *_DOC_ORDER))

    rich = F.filter("projects", lambda p: p["amount"].isNotNull() & p["completion_date"].isNotNull())
    rows = facts.groupBy("tender_id", "bidder_id").agg(
        best.alias("numeric"),
        *[first(f"reg_{k}").alias(f"reg_{k}") for k in P.REGISTRATION_PATTERNS],
        first("cue").alias("cue"),
        *[first(f"date_{i}").alias(f"date_{i}") for i in range(4)],
        name["name"].alias("found_name"),
        F.sum(F.size("projects")).alias("prose_projects"),
        F.sum(F.size(rich)).alias("prose_rich"),
        F.when(F.sum("confidence_pages") > 0, F.sum("confidence_sum") / F.sum("confidence_pages")).otherwise(0.0).alias("mean_confidence"),
        source("bidder_submission").alias("submission_id"),
        source("certificate").alias("certificate_id"),
    )
    any_date = F.coalesce(*[B.date_of_match(i, F.col(f"date_{i}")) for i in range(4)])
    rows = rows.withColumn("validity_date", F.coalesce(B.first_iso_date(F.col("cue.region")), any_date))
    return rows.withColumn("is_valid", F.col("validity_date") > F.lit(as_of)).drop(*[f"date_{i}" for i in range(4)], "cue")


_KEY_BITS = 1 << 26


def may_have(rows: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be among the chosen ones, found without a shuffle of the rows.

    Keys are compared by the bits of a hash, 64 to a word, so that at most a million words are broadcast for any number
    of keys. No chosen key is lost; others that share a bit stay, so a join has to follow.
    """
    if rows.schema[key].dataType != chosen.schema[key].dataType:
        return rows
    at = F.pmod(F.xxhash64(key), F.lit(_KEY_BITS))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = chosen.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    return rows.join(F.broadcast(words), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), "left_semi")


# --- amounts --------------------------------------------------------------------------


def criterion_terms(criteria: DataFrame) -> DataFrame:
    """(tender, criterion, term) rows for amount criteria."""
    numeric = criteria.where(F.col("criterion_type") == "numeric_threshold")
    return numeric.select("tender_id", "criterion_id", F.explode(B.numeric_terms(F.col("threshold_label"), F.col("criterion_text"))).alias("term"))


def _usual() -> Column:
    return F.col("term").isin(*P.NUMERIC_TERMS)


def _with_usual_terms(rows: DataFrame, text: str) -> DataFrame:
    """One row for each usual term that the text holds, with its amount.

    Terms are found and the amount is read inside a row, once and only where there is a term.
    """
    numeric = F.struct(B.numeric_value(F.col(text)).alias("numeric"))
    hits = let(numeric, lambda n: F.transform(B.known_terms(F.col(text)), lambda t: F.struct(t.alias("term"), n["numeric"].alias("numeric"))))
    return rows.select("*", F.inline(F.when(B.has_known_term(F.col(text)), hits)))


def _other_terms(terms: DataFrame) -> DataFrame:
    return terms.where(~_usual()).select("tender_id", "term").distinct()


def _with_other_terms(rows: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """The same for terms in words of a criterion's own; only rows of tenders that have such are looked through."""
    hits = rows.join(_other_terms(terms), "tender_id").where(F.contains(F.lower(text), F.col("term")))
    return hits.select(*rows.columns, F.inline(F.array(F.struct(F.col("term").alias("term"), B.numeric_value(F.col(text)).alias("numeric")))))


def _wanted(hits: DataFrame, terms: DataFrame) -> DataFrame:
    """Hits whose term their tender asks for."""
    return hits.join(terms.where(_usual()).select("tender_id", "term").distinct(), ["tender_id", "term"], "left_semi")


def search_table_rows(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Table rows that hold a term of their tender, with the amount of the row."""
    cells = F.transform("cells", lambda c: F.trim(c))
    keep = [c for c in rows.columns if c != "cells"]
    lines = lambda rows: rows.select(*keep, F.array_join(cells, " ").alias("line"))
    other = lines(may_have(rows, _other_terms(terms), "tender_id"))
    hits = _wanted(_with_usual_terms(lines(rows), "line"), terms).unionByName(_with_other_terms(other, "line", terms))
    return hits.withColumn("confidence", F.when(F.col("numeric").isNotNull(), 0.85).otherwise(0.7)).drop("line")


_SCALE = "struct<stage:int,k1:string,k2:string,low:double,k3:string,k4:string,n1:bigint,n2:bigint,n3:bigint>"


def _rank(stage: int, **keys: Column) -> Column:
    fields = ["k1", "k2", "low", "k3", "k4", "n1", "n2", "n3"]
    return F.struct(F.lit(stage).alias("stage"), *[keys.get(f, F.lit(None)).alias(f) for f in fields]).cast(_SCALE)


def best_table_numeric(matches: DataFrame) -> DataFrame:
    """Per bidder and term: the first file with an amount, in it the surest, then the earliest row."""
    found = matches.where(F.col("numeric").isNotNull())
    rank = _rank(
        0, k1=F.col("uploaded_at"), k2=F.col("document_id"), low=-F.col("numeric.confidence"), n1=F.col("page_number").cast("bigint"),
        n2=F.col("table_index").cast("bigint"), n3=F.col("row_index").cast("bigint"),
    )
    return found.groupBy("bidder_id", "term").agg(
        F.min(F.struct(rank.alias("rank"), "numeric", "document_id", F.col("page_number").cast("bigint").alias("page_number"))).alias("best")
    )


def text_chunks(documents: DataFrame) -> DataFrame:
    """Lines and sentences with a digit."""
    rows = documents.select("tender_id", "bidder_id", *_DOC_ORDER, F.posexplode(B.scope_chunks(F.col("text"))).alias("chunk_no", "chunk"))
    return rows.where(F.col("chunk").rlike("[0-9,]"))


def scoped_numeric(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Per bidder and term: the surest amount in a line or sentence that holds the term.

    Terms are reduced to one row for a bidder before they meet those that its tender asks for.
    """
    chunks, other = text_chunks(documents), text_chunks(may_have(documents, _other_terms(terms), "tender_id"))
    rank = _rank(1, low=-F.col("numeric.confidence"), k3=F.col("uploaded_at"), k4=F.col("document_id"), n1=F.col("chunk_no").cast("bigint"))
    found = F.struct(rank.alias("rank"), "numeric", F.lit(None).cast("string").alias("document_id"), F.lit(None).cast("bigint").alias("page_number"))
    best = lambda hits: hits.where(F.col("numeric").isNotNull()).groupBy("tender_id", "bidder_id", "term").agg(F.min(found).alias("best"))
    every = _wanted(best(_with_usual_terms(chunks, "chunk")), terms).unionByName(best(_with_other_terms(other, "chunk", terms)))
    return every.groupBy("bidder_id", "term").agg(F.min("best").alias("best"))


def _floor(mean: Column) -> Column:
    return F.greatest(mean, F.lit(0.5))


def best_numeric(pairs: DataFrame, documents: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Per amount case the best amount near a term of its criterion: table rows first, then scoped text."""
    mine = pairs.where(F.col("criterion_type") == "numeric_threshold")
    terms = criterion_terms(mine.select("tender_id", "criterion_id", "criterion_type", "threshold_label", "criterion_text").distinct())
    best = scoped_numeric(may_have(documents, mine, "bidder_id"), terms)
    if tables is not None:
        best = best.unionByName(best_table_numeric(search_table_rows(may_have(tables, mine, "bidder_id"), terms)))
        best = best.groupBy("bidder_id", "term").agg(F.min("best").alias("best"))
    return (
        mine.select("tender_id", "bidder_id", "criterion_id")
        .join(terms, ["tender_id", "criterion_id"])
        .join(best, ["bidder_id", "term"])
        .groupBy("bidder_id", "criterion_id")
        .agg(F.min("best").alias("best"))
    )


def _mean() -> Column:
    return F.coalesce("mean_confidence", F.lit(0.0))


# The evidence of each type as columns over a case joined with its bidder's profile.


def _numeric_columns() -> dict[str, Column]:
    value = F.coalesce(F.col("best.numeric"), F.col("numeric"))
    return {
        "has_value": value.isNotNull(),
        **{c: value[c] for c in ("amount", "raw_value", "unit", "fiscal_year")},
        "source_document_id": F.coalesce("best.document_id", "submission_id"),
        "source_page_number": F.col("best.page_number"),
        "ocr_confidence": F.when(value.isNull(), _mean()).otherwise(F.least(value["confidence"], _floor(_mean()))),
        "evaluation_method": F.lit("deterministic"),
    }


def _categorical_columns() -> dict[str, Column]:
    kind = B.infer_cert_type(F.col("threshold_document"), F.col("criterion_text"))
    number = None
    for name in P.REGISTRATION_PATTERNS:
        hit = kind == name
        number = F.when(hit, F.col(f"reg_{name}")) if number is None else number.when(hit, F.col(f"reg_{name}"))
    found = number.isNotNull()
    base = F.when(F.col("validity_date").isNotNull(), 0.9).otherwise(0.6)
    return {
        "has_value": F.lit(True), "found": found, "registration_number": number,
        "validity_date": F.when(found, F.col("validity_date")),
        "is_valid": F.when(found, F.col("is_valid")).otherwise(F.lit(False)), "certificate_type": kind,
        "source_document_id": F.col("certificate_id"),
        "ocr_confidence": F.when(found, F.least(base, _floor(_mean()))).otherwise(_mean()),
        "evaluation_method": F.lit("deterministic"),
    }


def _temporal_columns() -> dict[str, Column]:
    in_table = F.coalesce("table_projects", F.lit(0)) > 0
    count = F.when(in_table, F.col("table_projects")).otherwise(F.coalesce("prose_projects", F.lit(0)))
    rich = F.when(in_table, F.col("table_rich")).otherwise(F.coalesce("prose_rich", F.lit(0)))
    sure = F.when(rich >= F.coalesce("threshold_count", F.lit(2)), 0.9).otherwise(0.7)
    return {
        "has_value": F.lit(True), "project_count": count,
        "projects": F.when(in_table, F.col("table_listed")).otherwise(F.col("prose_listed")),
        "source_document_id": F.col("submission_id"),
        "ocr_confidence": F.when(count > 0, F.least(sure, _floor(_mean()))).otherwise(_mean()),
        "evaluation_method": F.lit("deterministic"),
    }


def _qualitative_columns() -> dict[str, Column]:
    verdict = F.coalesce("_verdict", F.lit("REVIEW"))
    return {
        "has_value": F.lit(True), "model_verdict": verdict, "model_confidence": F.coalesce("_model_confidence", F.lit(0.0)),
        "rules_verdict": F.coalesce("_rules_verdict", F.lit("REVIEW")), "branch_verdict": F.col("_branch_verdict"),
        "agreement": F.coalesce("_agreement", F.lit("agree")), "reasoning": F.col("_reasoning"), "consensus_verdict": verdict,
        "source_document_id": F.col("submission_id"),
        "ocr_confidence": F.least(F.greatest(F.coalesce("_confidence", F.lit(0.0)), F.lit(0.3)), F.greatest(_mean(), F.lit(0.3))),
        "evaluation_method": F.lit("union_rules+llm"),
    }


def _chosen(rows: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    return rows.select(*keep, "found_name", *(c.alias(name) for name, c in columns.items()))


def numeric_evidence(pairs: DataFrame, profile: DataFrame, documents: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Amount evidence: table rows first, then scoped text, then any amount of the bidder."""
    mine = pairs.where(F.col("criterion_type") == "numeric_threshold")
    rows = mine.join(best_numeric(pairs, documents, tables), ["bidder_id", "criterion_id"], "left").join(profile.drop("tender_id"), "bidder_id", "left")
    return _chosen(rows, pairs.columns, _numeric_columns())


def categorical_evidence(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Certificate evidence: an identifier of the wanted kind and a validity date."""
    mine = pairs.where(F.col("criterion_type") == "categorical_presence")
    return _chosen(mine.join(profile.drop("tender_id"), "bidder_id", "left"), pairs.columns, _categorical_columns())


# --- projects -------------------------------------------------------------------------


def projects_from_tables(rows: DataFrame) -> DataFrame:
    """Past projects from tables whose header names a description column."""
    keys = ["document_id", "page_number", "table_index"]
    headers = rows.where(F.col("row_index") == 0).select(
        *keys,
        B.header_position(F.col("cells"), P.PROJECT_DESCRIPTION_HEADERS).alias("_d"),
        B.header_position(F.col("cells"), P.PROJECT_VALUE_HEADERS).alias("_v"),
        B.header_position(F.col("cells"), P.PROJECT_DATE_HEADERS).alias("_t"),
    )
    body = rows.where(F.col("row_index") > 0).join(headers.where(F.col("_d").isNotNull()), keys)
    cell = lambda i: F.trim(F.coalesce(F.get("cells", F.col(i)), F.lit("")))
    out = body.select(
        "tender_id", "bidder_id", "uploaded_at", *keys, "row_index", cell("_d").alias("description"), B.numeric_value(cell("_v")).alias("numeric"),
        B.first_iso_date(cell("_t")).alias("completion_date"),
    ).where((F.length("description") > 0) & ~F.lower("description").isin(*P.PROJECT_DESCRIPTION_HEADERS))
    score = 0.55 + F.when(F.col("numeric").isNotNull(), 0.2).otherwise(0.0) + F.when(F.col("completion_date").isNotNull(), 0.15).otherwise(0.0)
    return out.withColumn("amount", F.col("numeric.amount")).withColumn("confidence", F.round(score, 2)).drop("numeric")


def _leading(rows: DataFrame, order: list[str], printed: int = 3) -> DataFrame:
    """The projects of each bidder that an explanation prints.

    All projects stay in the long form that is the input; counts are taken from it.
    """
    top = rows.withColumn("_n", F.row_number().over(W.partitionBy("bidder_id").orderBy(*order))).where(F.col("_n") <= printed)
    entry = F.struct("_n", "description", "amount", "completion_date", "confidence")
    listed = F.array_sort(F.collect_list(entry))
    return top.groupBy("bidder_id").agg(
        F.transform(listed, lambda p: F.struct(p["description"], p["amount"], p["completion_date"], p["confidence"])).alias("listed")
    )


def prose_project_rows(facts: DataFrame) -> DataFrame:
    return facts.select("bidder_id", *_DOC_ORDER, F.posexplode("projects").alias("project_no", "_p")).select(
        "bidder_id", *_DOC_ORDER, "project_no", "_p.*"
    )


_LISTED = "array<struct<description:string,amount:bigint,completion_date:string,confidence:double>>"


def project_profile(profile: DataFrame, facts: DataFrame, tables: DataFrame | None) -> DataFrame:
    """The profile with the projects of each bidder: counts from tables, and what is printed of both kinds."""
    rows = profile.join(_leading(prose_project_rows(facts), [*_DOC_ORDER, "project_no"]).withColumnRenamed("listed", "prose_listed"), "bidder_id", "left")
    if tables is None:
        none = {"table_projects": "bigint", "table_rich": "bigint", "table_listed": _LISTED}
        return rows.withColumns({name: F.lit(None).cast(kind) for name, kind in none.items()})
    found = projects_from_tables(tables)
    rich = F.col("amount").isNotNull() & F.col("completion_date").isNotNull()
    counts = found.groupBy("bidder_id").agg(F.count(F.lit(1)).alias("table_projects"), F.count_if(rich).alias("table_rich"))
    listed = _leading(found, [*_DOC_ORDER, "page_number", "table_index", "row_index"]).withColumnRenamed("listed", "table_listed")
    return rows.join(counts, "bidder_id", "left").join(listed, "bidder_id", "left")


def temporal_evidence(pairs: DataFrame, profile: DataFrame, facts: DataFrame, tables: DataFrame | None) -> DataFrame:
    """Project counts: from tables when any table lists projects, else from running text.

    The period of the criterion is reported, not enforced.
    """
    mine = pairs.where(F.col("criterion_type") == "temporal_recency")
    rows = mine.join(project_profile(profile, facts, tables).drop("tender_id"), "bidder_id", "left")
    return _chosen(rows, pairs.columns, _temporal_columns())


_ASSESSED = {"verdict": "string", "confidence": "double", "model_confidence": "double", "rules_verdict": "string", "branch_verdict": "string", "agreement": "string", "reasoning": "string"}


def with_assessments(rows: DataFrame, assessments: DataFrame | None) -> DataFrame:
    """Cases with the consensus of both branches, where there is one."""
    if assessments is None:
        return rows.select("*", *[F.lit(None).cast(kind).alias(f"_{c}") for c, kind in _ASSESSED.items()])
    return rows.join(assessments.select("bidder_id", "criterion_id", *[F.col(c).alias(f"_{c}") for c in _ASSESSED]), ["bidder_id", "criterion_id"], "left")


def qualitative_evidence(pairs: DataFrame, profile: DataFrame, assessments: DataFrame | None) -> DataFrame:
    """Consensus of both branches for wording criteria; without an assessment the case is open."""
    mine = pairs.where(F.col("criterion_type") == "qualitative_assessment")
    rows = with_assessments(mine.join(profile.drop("tender_id"), "bidder_id", "left"), assessments)
    return _chosen(rows, pairs.columns, _qualitative_columns())


def extraction_confidence(base: Column, criterion_type: Column, flag: Column) -> Column:
    """Reading confidence damped by an entity flag and by the kind of criterion."""
    damped = base * F.when(flag, 0.5).otherwise(1.0) * lookup(criterion_type, P.TYPE_CONFIDENCE_FACTORS, 1.0)
    return F.when(base <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), damped)))


def extract_evidence(
    pairs: DataFrame, documents: DataFrame, tables: DataFrame | None = None, assessments: DataFrame | None = None, *, as_of: str,
    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Evidence for every pair, whatever its type; unknown types carry no value.

    ``pairs`` are bidders with the criteria of their tender; ``documents`` are the
    assembled files.  The extracted company name is compared with the registered one.
    Files and what they offer are used several times; ``keep`` may write them somewhere and return them read back.
    """
    from .entity import match_entity

    documents = keep(documents)
    facts = keep(document_facts(documents))
    profile = project_profile(bidder_profile(facts, as_of), facts, tables).drop("tender_id")
    # Both names depend on the bidder alone, so they are compared once for each.
    named = pairs.groupBy("bidder_id").agg(F.first("company_name").alias("registered_name")).join(profile, "bidder_id", "left")
    named = named.withColumn("extracted_name", F.when(F.length("found_name") > 0, F.col("found_name")).otherwise(F.col("registered_name")))
    named = match_entity(named, "registered_name", "extracted_name").withColumn("entity_match_flag", F.col("requires_review"))
    rows = pairs.join(named, "bidder_id").join(best_numeric(pairs, documents, tables), ["bidder_id", "criterion_id"], "left")
    rows = with_assessments(rows, assessments)
    kinds = {
        "numeric_threshold": _numeric_columns(), "categorical_presence": _categorical_columns(),
        "temporal_recency": _temporal_columns(), "qualitative_assessment": _qualitative_columns(),
    }
    other = {"has_value": F.lit(False), "ocr_confidence": F.lit(0.0), "evaluation_method": F.lit("none")}
    out: dict[str, Column] = {}
    for name in dict.fromkeys(c for columns in kinds.values() for c in columns):
        value = None
        for kind, columns in kinds.items():
            if name in columns:
                hit = F.col("criterion_type") == kind
                value = F.when(hit, columns[name]) if value is None else value.when(hit, columns[name])
        out[name] = value.otherwise(other[name]) if name in other else value
    entity = ["registered_name", "extracted_name", "similarity_score", "is_match", "mismatch_type", "requires_review", "entity_match_flag"]
    rows = rows.select(*pairs.columns, *entity, *(c.alias(name) for name, c in out.items())).withColumn("source_filename", F.lit(None).cast("string"))
    conf = extraction_confidence(F.col("ocr_confidence"), F.col("criterion_type"), F.col("entity_match_flag"))
    return rows.withColumn("extraction_confidence", conf)
