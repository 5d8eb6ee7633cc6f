"""Column functions over bid text: amounts, fiscal years, dates, identifiers, names."""

from __future__ import annotations

import datetime
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .common import collapse, contains_any, group, let, null_if_empty, parse_amount, strip, to_rupees


def fiscal_year(text: Column) -> Column:
    """``YYYY-YY`` of the first labelled, else the first bare fiscal year."""

    def shape(flat: Column) -> Column:
        start, end = F.substring_index(flat, "-", 1), F.substring_index(flat, "-", -1)
        century = F.when(F.length(start) == 2, F.concat(F.lit("20"), start)).otherwise(start)
        return F.concat(century, F.lit("-"), F.when(F.length(end) == 4, F.substring(end, 3, 2)).otherwise(end))

    # Both forms hold a number, a dash or slash, and a number.
    raw = let(group(text, P.FISCAL_YEAR_PATTERNS[0], 1), lambda y: F.when(F.length(y) > 0, y).otherwise(let(group(text, P.FISCAL_YEAR_PATTERNS[1], 1), null_if_empty)))
    return let(F.when(text.rlike(r"\d\s*[-–/]\s*\d"), F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), "[/–]", "-")), shape)


def _window(text: Column, match: Column, reach: int = 40) -> Column:
    """A match with ``reach`` characters on both sides.

    It is the first of its pattern, and these patterns look at nothing outside a match, so the
    same characters do not stand before it.
    """

    def cut(start: Column) -> Column:
        first = F.greatest(start - reach, F.lit(1))
        return F.substr(text, first, start + F.length(match) + reach - first)

    return let(F.position(match, text), cut)


def _amount(text: Column, match: Column, quality: Column) -> Column:
    """A match as a struct of its amount, unit and fiscal year."""

    def shape(m: Column) -> Column:
        raw, unit, year = m["raw"], m["unit"], m["year"]
        return F.when(
            raw.isNotNull(),
            F.struct(
                F.when(F.length(unit) > 0, to_rupees(raw, unit)).otherwise(F.rint(raw).cast("bigint")).alias("amount"),
                raw.alias("raw_value"),
                F.when(F.length(unit) > 0, unit).otherwise(F.lit("rupees")).alias("unit"),
                year.alias("fiscal_year"),
                F.round(F.when(quality == 2, 0.9).otherwise(0.75) + F.when(year.isNotNull(), F.lit(0.05)).otherwise(F.lit(0.0)), 6).alias("confidence"),
                quality.alias("quality"),
            ),
        )

    return let(
        F.struct(
            parse_amount(group(match, P.AMOUNT_PARTS, 1)).alias("raw"),
            F.lower(group(match, P.AMOUNT_PARTS, 2)).alias("unit"),
            let(_window(text, match), fiscal_year).alias("year"),
        ),
        shape,
    )


def numeric_value(text: Column) -> Column:
    """The preferred amount of a text as a struct, null when there is none.

    A currency amount with a unit wins, then the first currency amount, then the
    first number with a unit; a fiscal year near the match raises the confidence.
    """

    def found(quality: int, pattern: str, rest: Column) -> Column:
        entry = lambda m: F.struct(m.alias("match"), F.lit(quality).alias("quality"))
        return let(group(text, pattern, 0), lambda m: F.when(F.length(m) > 0, entry(m)).otherwise(rest))

    choice = found(2, P.CURRENCY_UNIT_AMOUNT, found(1, P.CURRENCY_AMOUNT, found(0, P.UNIT_AMOUNT, F.lit(None))))
    return let(F.when(text.rlike("[0-9]"), choice), lambda c: F.when(c.isNotNull(), _amount(text, c["match"], c["quality"])))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a calendar date, null when the date does not exist."""
    text = F.concat(
        F.lpad(year, 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0")
    )
    return let(
        F.when(year.try_cast("int") > 0, text),
        lambda t: F.when(F.try_to_date(t, "yyyy-MM-dd").isNotNull(), t),
    )


def _month_number(name: Column) -> Column:
    months = F.array(*[F.lit(m) for m in P.MONTH_NUMBERS])
    return F.array_position(months, F.substring(F.lower(name), 1, 3))


_FAMILIES = [(P.DATE_DMY, 3, 2, 1), (P.DATE_YMD, 1, 2, 3), (P.DATE_DMONY, 3, 2, 1), (P.DATE_MONY, 2, 1, 0)]


def date_matches(text: Column) -> list[Column]:
    """The first matching text of each date family, null when absent."""
    return [null_if_empty(group(text, pattern, 0)) for pattern, *_ in _FAMILIES]


def date_of_match(family: int, match: Column) -> Column:
    """ISO date of a match of one family, null when it is not a calendar date."""
    pattern, year, month, day = _FAMILIES[family]
    named = pattern in (P.DATE_DMONY, P.DATE_MONY)

    def build(m: Column) -> Column:
        month_text = group(m, pattern, month)
        return _iso(
            group(m, pattern, year),
            _month_number(month_text) if named else month_text,
            group(m, pattern, day) if day else F.lit("1"),
        )

    return let(match, build)


def date_by_family(text: Column) -> list[Column]:
    """The date of the first match of each family, null when absent or impossible."""
    return [date_of_match(i, m) for i, m in enumerate(date_matches(text))]


def first_iso_date(text: Column) -> Column:
    """First valid date, tried family by family."""
    return F.coalesce(*date_by_family(text))


def validity(text: Column, as_of: str) -> Column:
    """Validity date after a cue, else any date; valid when later than ``as_of``."""

    def build(cue: Column) -> Column:
        after_cue = F.when(F.length(cue) > 0, first_iso_date(group(cue, P.VALIDITY_CUE, 1)))
        return let(
            F.coalesce(after_cue, first_iso_date(text)),
            lambda date: F.when(
                date.isNotNull(),
                F.struct(
                    date.alias("date"),
                    (date > F.lit(as_of)).alias("is_valid"),
                    F.when(F.length(cue) > 0, F.lit(0.85)).otherwise(F.lit(0.7)).alias("confidence"),
                ),
            ),
        )

    return let(group(text, P.VALIDITY_CUE, 0), build)


def registration_numbers(text: Column) -> dict[str, Column]:
    """One column per identifier kind; a PAN inside a GSTIN does not count as a PAN."""
    upper = F.upper(text)
    out = {}
    for kind, pattern in P.REGISTRATION_PATTERNS.items():
        source = text if kind == "iso" else upper
        if kind == "pan":
            source = F.regexp_replace(upper, P.REGISTRATION_PATTERNS["gst"], " ")
        out[kind] = null_if_empty(F.trim(group(source, pattern, 1)))
    return out


def registration_number(text: Column, cert_type: Column) -> Column:
    """The first identifier of the wanted kind; unknown kinds give null."""
    kind = F.lower(F.trim(cert_type))
    for alias, target in P.REGISTRATION_ALIASES.items():
        kind = F.when(kind == alias, F.lit(target)).otherwise(kind)
    expr = None
    for name, value in registration_numbers(text).items():
        expr = F.when(kind == name, value) if expr is None else expr.when(kind == name, value)
    return expr


def clean_company_name(name: Column) -> Column:
    fillers = "|".join(P.NAME_FILLERS)
    trimmed = F.regexp_replace(collapse(name), "[,;:.]+$", "")
    return F.trim(F.regexp_replace(trimmed, rf"^(?i)(?:(?:{fillers})(?:\s+|$))+", ""))


def company_name_candidate(text: Column) -> Column:
    """Struct of preference (0 best) and cleaned name, null when no pattern hits."""
    bare = F.get(F.split(group(text, P.NAME_AFTER_MS, 1), P.NAME_CUT, 2), F.lit(0))

    def found(rank: int, name: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), clean_company_name(name).alias("name"))

    return (
        F.when(text.rlike(P.NAME_AFTER_MS_LEGAL), found(0, group(text, P.NAME_AFTER_MS_LEGAL, 1)))
        .when(text.rlike(P.NAME_WITH_SUFFIX), found(1, group(text, P.NAME_WITH_SUFFIX, 1)))
        .when(text.rlike(P.NAME_AFTER_MS), found(2, bare))
    )


def company_name(text: Column) -> Column:
    """Name after M/s with a legal suffix, else any suffixed name, else a bare M/s name."""
    return company_name_candidate(text)["name"]


def infer_cert_type(document: Column, criterion_text: Column) -> Column:
    """Identifier kind named by the requirement; substring tests in fixed order."""
    s = F.lower(F.concat_ws(" ", F.coalesce(document, F.lit("")), criterion_text))
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(has("gst"), "gst").when(has("pan"), "pan").when(has("cin"), "cin").when(has("tan"), "tan")
        .when(has("udyam") | has("msme"), "udyam").when(has("iso"), "iso")
    )


def numeric_terms(label: Column, criterion_text: Column) -> Column:
    """Words to look for when an amount requirement is checked against bid text."""
    hint, ct = F.lower(F.coalesce(label, F.lit(""))), F.lower(F.coalesce(criterion_text, F.lit("")))
    has = lambda c, w: F.contains(c, F.lit(w))

    def words(cond: Column, *ws: str) -> Column:
        return F.when(cond, F.array(*[F.lit(w) for w in ws])).otherwise(F.array().cast("array<string>"))

    known = F.array_distinct(
        F.concat(
            words(has(hint, "turnover") | has(ct, "turnover"), *P.TURNOVER_TERMS),
            words(has(hint, "net worth") | has(ct, "net worth"), *P.NET_WORTH_TERMS),
            words(has(hint, "emd") | has(hint, "bid security") | has(ct, "earnest"), *P.DEPOSIT_TERMS),
            words(has(hint, "work") | has(hint, "contract") | has(hint, "project"), *P.ORDER_TERMS),
        )
    )
    fallback = F.array(F.when(F.length(hint) > 0, hint).otherwise(F.lit("turnover")))
    return F.when(F.size(known) > 0, known).otherwise(fallback)


def known_terms(text: Column) -> Column:
    """The usual terms of amount requirements that a text holds."""
    return let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in P.NUMERIC_TERMS])))


def has_known_term(text: Column) -> Column:
    """Whether a text holds a usual term at all."""
    return let(F.lower(text), lambda low: contains_any(low, P.NUMERIC_TERMS))


def scope_chunks(text: Column) -> Column:
    """Lines and sentences, the scopes an amount is looked up in."""
    return F.split(text, r"[\s\x01](?:(?<=\x01)|(?<=[.!?]\s)\s*+|(?<=\n)\n*+)", -1)


_PROJECTS = "array<struct<description:string,amount:{amount},completion_date:string,confidence:double>>"


def _projects_of_texts():
    """The function of ``prose_projects`` over Arrow texts; amounts are whole numbers as doubles."""
    # A local function travels with the job, so executors need not have this package.
    shortest, longest = P.PROJECT_DESCRIPTION_LENGTH
    # As in Java, letters, digits and blanks are those of ASCII.
    longest_tail, shorter_tail = (re.compile(p, re.ASCII).match for p in (P.PROJECT_TAIL_LONGEST, P.PROJECT_TAIL_SHORTER))
    ends = re.compile(r"[\-:–|]").finditer
    blanks, separators = re.compile(r"\s+", re.ASCII), re.compile(r"[-/.]")
    units, months = dict(P.UNIT_MULTIPLIERS), {m: i for i, m in enumerate(P.MONTH_NUMBERS, 1)}

    def rupees(text: str, unit: str | None) -> float | None:
        try:
            value = float(text.replace(",", ""))
        except ValueError:
            return None
        if unit:
            value *= units.get(unit.lower().rstrip("."), 1)
        return value if abs(value) >= 2**53 else float(round(value))

    def iso(text: str) -> str | None:
        parts = separators.split(text)
        if len(parts) < 3:
            parts = text[-4:], months[text[:3].lower()], 1
        elif len(parts[0]) < 4:
            parts = parts[::-1]
        try:
            return datetime.date(*map(int, parts)).isoformat()
        except ValueError:
            return None

    def projects(texts: pa.Array) -> pa.Array:
        offsets, named, amounts, dates, sure = [0], [], [], [], []
        for text in texts.to_pylist():
            # The place after the last project; a line or the end of a project bounds a description.
            done = 0
            for m in ends(text or ""):
                at = m.start()
                if at - done < shortest:
                    continue
                start = max(done, at - longest, text.rfind("\n", done, at) + 1)
                if at - start < shortest or not (tail := longest_tail(text, at) or shorter_tail(text, at)):
                    continue
                done = tail.end()
                amount, unit, date = tail.groups()
                name = blanks.sub(" ", text[start:at]).strip(" -:–|")
                if name:
                    amount, date = rupees(amount, unit), iso(date)
                    named.append(name)
                    amounts.append(amount)
                    dates.append(date)
                    sure.append((0.55 if date is None else 0.65) if amount is None else 0.75 if date is None else 0.85)
            offsets.append(len(named) if text is not None else None)
        # A null stands for its row's start; the end of the row before it is the next known place.
        known, starts = 0, []
        for end in offsets[1:]:
            starts.append(None if end is None else known)
            known = known if end is None else end
        fields = {"description": pa.array(named, pa.string()), "amount": pa.array(amounts, pa.float64()), "completion_date": pa.array(dates, pa.string()), "confidence": pa.array(sure, pa.float64())}
        return pa.ListArray.from_arrays(pa.array([*starts, known], pa.int32()), pa.StructArray.from_arrays(list(fields.values()), names=list(fields)))

    return projects


def prose_projects(text: Column) -> Column:
    """``ARRAY<STRUCT<description, amount, completion_date, confidence>>`` from running text.

    Same matches as the one-piece pattern, without its trial of every description length
    at every character: each place where a tail may start is tried once, and takes the text before it on its
    line, back to the previous project and at most 120 characters.
    """
    found = F.arrow_udf(_projects_of_texts(), _PROJECTS.format(amount="double"))(text)
    return found.cast(_PROJECTS.format(amount="bigint"))


def header_position(headers: Column, candidates: list[str]) -> Column:
    """0-based position of the first header cell that holds a candidate, null when none does."""
    lowered = F.transform(headers, lambda h: F.lower(strip(h)))
    listed = F.array(*[F.lit(c) for c in candidates])
    hits = F.transform(lowered, lambda h: F.exists(listed, lambda c: F.contains(h, c)))
    position = F.array_position(hits, True)
    return F.when(position > 0, (position - 1).cast("int"))


def normalise_company(name: Column) -> Column:
    """Lower case, no punctuation, abbreviations expanded, legal words dropped."""
    gaps = "\t\n\x0b\f\r.,-()&"
    tokens = F.split(F.lower(F.translate(name, gaps, " " * len(gaps))), " ")
    kept = F.filter(tokens, lambda t: ~t.isin("", *P.NAME_DROPPED_TOKENS))
    # Whole words that an abbreviation stands for may be dropped words, so those of dropped ones are dropped above as well.
    expand = F.create_map(*[F.lit(x) for kv in P.NAME_ABBREVIATIONS.items() for x in kv])
    return F.array_join(F.transform(kept, lambda t: F.coalesce(F.element_at(expand, t), t)), " ")
