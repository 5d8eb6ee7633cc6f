"""Expression texts for the DuckDB side of the checks."""

from __future__ import annotations

from ..functions import patterns as P


def q(text: str) -> str:
    """A quoted SQL string."""
    return "'" + text.replace("'", "''") + "'"


def two(x: str) -> str:
    return f"cast(cast(round_even(cast({x} AS decimal(18,6)), 2) AS decimal(18,2)) AS varchar)"


def case(key: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(str(k))} THEN {q(v) if isinstance(v, str) else v}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


def to_rupees(value: str, unit: str) -> str:
    key = f"regexp_replace(trim(lower(coalesce({unit}, ''))), '\\.+$', '')"
    return f"cast(round_even({value} * {case(key, P.UNIT_MULTIPLIERS, '1')}, 0) AS bigint)"


def rupees(a: str) -> str:
    return (
        f"CASE WHEN {a} IS NULL THEN 'unknown amount' WHEN {a} >= 10000000 THEN concat('Rs. ', {two(f'{a} / 10000000.0')}, ' Cr') "
        f"WHEN {a} >= 100000 THEN concat('Rs. ', {two(f'{a} / 100000.0')}, ' Lakh') ELSE concat('Rs. ', format('{{:,}}', {a})) END"
    )


def contains_any(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def num_text(x: str) -> str:
    """A double as text with at least one decimal."""
    plain = f"regexp_replace(cast(cast({x} AS decimal(30,6)) AS varchar), '0+$', '')"
    return f"CASE WHEN ends_with({plain}, '.') THEN concat({plain}, '0') ELSE {plain} END"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def group(x: str, pattern: str, i: int) -> str:
    return f"coalesce(regexp_extract({x}, {q(pattern)}, {i}), '')"


def null_if_empty(x: str) -> str:
    return f"nullif({x}, '')"


def all_groups(x: str, pattern: str, i: int) -> str:
    return f"list_transform(regexp_extract_all({x}, {q(pattern)}, {i}), lambda zz: coalesce(zz, ''))"


def fiscal_year(x: str) -> str:
    raw = "coalesce(" + ", ".join(null_if_empty(group(x, p, 1)) for p in P.FISCAL_YEAR_PATTERNS) + ")"
    flat = f"replace(replace(regexp_replace({raw}, '\\s+', '', 'g'), '/', '-'), '–', '-')"
    s, e = f"split_part({flat}, '-', 1)", f"split_part({flat}, '-', 2)"
    return (
        f"CASE WHEN {raw} IS NULL THEN NULL ELSE concat(CASE WHEN length({s}) = 2 THEN '20' ELSE '' END, {s}, '-', "
        f"CASE WHEN length({e}) = 4 THEN substr({e}, 3) ELSE {e} END) END"
    )


def numeric_value_ctes(source: str, text: str, out: str) -> str:
    """CTEs that add amount, raw_value, unit, fiscal_year and confidence to ``source``."""
    cur, bare = P.CURRENCY_AMOUNT, P.UNIT_AMOUNT
    return f"""
    {out}_m AS (SELECT *, regexp_extract_all({text}, {q(cur)}, 0) AS zw, {all_groups(text, cur, 2)} AS zu,
        regexp_extract_all({text}, {q(bare)}, 0) AS zb FROM {source}),
    {out}_i AS (SELECT *, len(zw) > 0 AS zcur, coalesce(list_position(list_transform(zu, lambda u: u <> ''), true), 0) AS zat FROM {out}_m),
    {out}_p AS (SELECT *, CASE WHEN zcur THEN greatest(zat, 1) ELSE 1 END AS zi,
        CASE WHEN zcur THEN zw ELSE zb END AS zm,
        CASE WHEN zcur THEN regexp_split_to_array({text}, {q(cur)}) ELSE regexp_split_to_array({text}, {q(bare)}) END AS zg FROM {out}_i),
    {out}_s AS (SELECT *, zm[zi] AS zmatch,
        cast(coalesce(list_sum(list_transform(zg[1:zi], lambda g: length(g))), 0) + coalesce(list_sum(list_transform(zm[1:zi-1], lambda g: length(g))), 0) AS bigint) AS zstart FROM {out}_p),
    {out}_w AS (SELECT *, substr({text}, greatest(zstart - 40, 0) + 1, zstart + length(zmatch) + 40 - greatest(zstart - 40, 0)) AS zwin,
        try_cast(replace(CASE WHEN zcur THEN {group('zmatch', cur, 1)} ELSE {group('zmatch', bare, 1)} END, ',', '') AS double) AS zraw,
        lower(CASE WHEN zcur THEN {group('zmatch', cur, 2)} ELSE {group('zmatch', bare, 2)} END) AS zunit FROM {out}_s),
    {out}_y AS (SELECT *, {fiscal_year('zwin')} AS zyear FROM {out}_w),
    {out} AS (SELECT *, CASE WHEN zraw IS NULL THEN NULL WHEN zunit <> '' THEN {to_rupees('zraw', 'zunit')} ELSE cast(round_even(zraw, 0) AS bigint) END AS amount,
        zraw AS raw_value, CASE WHEN zraw IS NULL THEN NULL WHEN zunit <> '' THEN zunit ELSE 'rupees' END AS unit,
        CASE WHEN zraw IS NOT NULL THEN zyear END AS fiscal_year,
        CASE WHEN zraw IS NULL THEN NULL ELSE round(CASE WHEN zcur AND zat > 0 THEN 0.9 ELSE 0.75 END + CASE WHEN zyear IS NULL THEN 0.0 ELSE 0.05 END, 6) END AS num_confidence
        FROM {out}_y)"""


def _iso(y: str, m: str, d: str) -> str:
    t = f"concat(lpad({y}, 4, '0'), '-', lpad({m}, 2, '0'), '-', lpad({d}, 2, '0'))"
    return f"CASE WHEN try_cast({y} AS int) > 0 AND try_cast({t} AS date) IS NOT NULL THEN {t} END"


def date_families(x: str) -> list[str]:
    g = lambda p, i: group(x, p, i)
    months = "[" + ", ".join(q(m) for m in P.MONTH_NUMBERS) + "]"
    mon = lambda p, i: f"cast(list_position({months}, substr(lower({g(p, i)}), 1, 3)) AS varchar)"
    return [
        _iso(g(P.DATE_DMY, 3), g(P.DATE_DMY, 2), g(P.DATE_DMY, 1)),
        _iso(g(P.DATE_YMD, 1), g(P.DATE_YMD, 2), g(P.DATE_YMD, 3)),
        _iso(g(P.DATE_DMONY, 3), mon(P.DATE_DMONY, 2), g(P.DATE_DMONY, 1)),
        _iso(g(P.DATE_MONY, 2), mon(P.DATE_MONY, 1), "'1'"),
    ]


def first_date(x: str) -> str:
    return "coalesce(" + ", ".join(date_families(x)) + ")"


def clean_name(x: str) -> str:
    fillers = "|".join(P.NAME_FILLERS)
    return f"trim(regexp_replace(regexp_replace({collapse(x)}, '[,;:.]+$', ''), '(?i)^(?:(?:{fillers})(?:\\s+|$))+', ''))"


def company_name(x: str) -> str:
    has = lambda p: f"regexp_matches({x}, {q(p)})"
    bare = f"regexp_split_to_array({group(x, P.NAME_AFTER_MS, 1)}, {q(P.NAME_CUT)})[1]"
    return (
        f"CASE WHEN {has(P.NAME_AFTER_MS_LEGAL)} THEN {clean_name(group(x, P.NAME_AFTER_MS_LEGAL, 1))} "
        f"WHEN {has(P.NAME_WITH_SUFFIX)} THEN {clean_name(group(x, P.NAME_WITH_SUFFIX, 1))} "
        f"WHEN {has(P.NAME_AFTER_MS)} THEN {clean_name(bare)} END"
    )


def registration(x: str, kind: str) -> str:
    pat = P.REGISTRATION_PATTERNS[kind]
    src = x if kind == "iso" else f"upper({x})"
    if kind == "pan":
        src = f"regexp_replace(upper({x}), {q(P.REGISTRATION_PATTERNS['gst'])}, ' ', 'g')"
    return null_if_empty(f"trim({group(src, pat, 1)})")


def normalise_company(x: str) -> str:
    cleaned = f"regexp_replace(lower({strip(x)}), '[.,\\-()&]', ' ', 'g')"
    tokens = f"string_split({collapse(cleaned)}, ' ')"
    expanded = f"list_transform({tokens}, lambda t: {case('t', P.NAME_ABBREVIATIONS, 't')})"
    drop = "(" + ", ".join(q(t) for t in P.NAME_DROPPED_TOKENS) + ")"
    return f"array_to_string(list_filter({expanded}, lambda t: t NOT IN {drop}), ' ')"


def cert_type(document: str, criterion_text: str) -> str:
    s = f"lower(concat(coalesce({document}, ''), ' ', {criterion_text}))"
    has = lambda w: f"contains({s}, '{w}')"
    return (
        f"CASE WHEN {has('gst')} THEN 'gst' WHEN {has('pan')} THEN 'pan' WHEN {has('cin')} THEN 'cin' WHEN {has('tan')} THEN 'tan' "
        f"WHEN {has('udyam')} OR {has('msme')} THEN 'udyam' WHEN {has('iso')} THEN 'iso' END"
    )
