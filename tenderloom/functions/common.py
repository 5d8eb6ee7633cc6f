"""Small column helpers: rounding, money, canonical JSON, pattern access."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def group(text: Column, pattern: str, index: int) -> Column:
    """A capture group of the first match, '' when absent."""
    return F.regexp_extract(text, pattern, index)


def let(value: Column, body) -> Column:
    """``body`` over a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def groups(text: Column, pattern: str, index: int) -> Column:
    """The capture group of every match, in order."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(index))


def null_if_empty(text: Column) -> Column:
    return F.when(F.length(text) > 0, text)


def plain_spaces(text: Column) -> Column:
    """Unicode white space outside ASCII as blanks, so that patterns see it; the length stays."""
    blanks = " " * len(P.UNICODE_SPACES)
    return let(text, lambda t: F.when(t.rlike(P.UNICODE_SPACE), F.translate(t, P.UNICODE_SPACES, blanks)).otherwise(t))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def in_list(value: Column, words: list[str]) -> Column:
    return value.isin(*words)


def lookup(key: Column, table: dict, default) -> Column:
    """A literal table as a CASE expression."""
    expr = None
    for k, v in table.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def decimals(value: Column, digits: int) -> Column:
    """Half-even rounding on the decimal value, as text with fixed digits."""
    return F.bround(value.cast("decimal(18,6)"), digits).cast(f"decimal(18,{digits})").cast("string")


def two(value: Column) -> Column:
    return decimals(value, 2)


def to_rupees(value: Column, unit: Column) -> Column:
    """Whole rupees, rounded half to even; an unknown unit multiplies by one."""
    key = F.regexp_replace(F.trim(F.lower(F.coalesce(unit, F.lit("")))), r"\.+$", "")
    return F.rint(value * lookup(key, P.UNIT_MULTIPLIERS, 1)).cast("bigint")


def parse_amount(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def format_rupees(amount: Column) -> Column:
    crore, lakh = 10_000_000, 100_000
    return (
        F.when(amount.isNull(), F.lit("unknown amount"))
        .when(amount >= crore, F.concat(F.lit("Rs. "), two(amount / F.lit(crore)), F.lit(" Cr")))
        .when(amount >= lakh, F.concat(F.lit("Rs. "), two(amount / F.lit(lakh)), F.lit(" Lakh")))
        .otherwise(F.concat(F.lit("Rs. "), F.format_number(amount, 0)))
    )


def word_to_int(text: Column) -> Column:
    """Digits or one..ten; anything else counts as zero."""
    t = F.lower(F.trim(text))
    words = {w: i for i, w in enumerate(P.NUMBER_WORDS, start=1)}
    return F.when(t.rlike(r"^\d+$"), t.try_cast("bigint")).otherwise(lookup(t, words, 0).cast("bigint"))


def ascii_escape(text: Column) -> Column:
    r"""Replace every non-ASCII character by its ``\uXXXX`` form (surrogate pairs above U+FFFF)."""

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escape(c: Column) -> Column:
        code = F.ascii(c).cast("bigint")
        high = F.lit(0xD800) + F.shiftright(code - F.lit(0x10000), 10)
        low = F.lit(0xDC00) + ((code - F.lit(0x10000)) % F.lit(1024))
        return F.when(code < 127, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    return F.when(text.rlike(r"[^\x00-\x7e]"), escaped).otherwise(text)


def json_string(text: Column) -> Column:
    """A quoted JSON string with ASCII escapes; null becomes the literal null."""

    def control(t: Column) -> Column:
        for raw, esc in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            t = F.replace(t, F.lit(raw), F.lit(esc))

        def others(u: Column) -> Column:
            rest = F.transform(
                F.split(u, ""),
                lambda c: F.when(
                    F.ascii(c) < 32, F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(F.ascii(c).cast("bigint"))), 4, "0"))
                ).otherwise(c),
            )
            return F.when(u.rlike(r"[\x01-\x1f]"), F.array_join(rest, "")).otherwise(u)

        return let(t, others)

    plain = text.rlike(r"^[\x20-\x21\x23-\x5b\x5d-\x7e]*$")
    body = F.when(plain, text).otherwise(let(control(text), ascii_escape))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def json_number(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("null"))


def json_bool(value: Column) -> Column:
    return F.when(value, F.lit("true")).when(~value, F.lit("false")).otherwise(F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """A compact JSON object with sorted keys; the values are JSON texts."""
    parts: list[Column] = [F.lit("{")]
    for i, key in enumerate(sorted(fields)):
        parts += [F.lit(("," if i else "") + f'"{key}":'), fields[key]]
    return F.concat(*parts, F.lit("}"))


def json_float(value: Column) -> Column:
    """A double as Python prints it: the shortest digits, an exponent below 1e-4 and from 1e16 on."""

    def shown(v: Column) -> Column:
        text = F.abs(v).cast("string")
        mantissa, power = F.split_part(text, F.lit("E"), F.lit(1)), F.coalesce(F.split_part(text, F.lit("E"), F.lit(2)).try_cast("int"), F.lit(0))
        whole = F.split_part(mantissa, F.lit("."), F.lit(1))
        digits = F.concat(whole, F.split_part(mantissa, F.lit("."), F.lit(2)))
        bare = F.ltrim(digits, F.lit("0"))
        # The value is 0.bare times ten to the place.
        place = F.length(whole) + power - F.length(digits) + F.length(bare)
        parts = let(F.struct(F.rtrim(bare, F.lit("0")).alias("d"), place.alias("p")), lambda x: shortest(v, x))
        body = let(let(parts, lambda x: shortest(v, x)), lambda x: placed(x["d"], x["p"]))
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        return F.when(v.isNull() | F.isnan(v) | text.startswith("I"), v.cast("string")).otherwise(F.concat(sign, F.when(v == 0, "0.0").otherwise(body)))

    def shortest(v: Column, x: Column) -> Column:
        # The runtime may print a digit or two more than needed: try the digits without the last one, rounded as it says first.
        less = F.substring(x["d"], F.lit(1), F.length(x["d"]) - 1)
        rounded = lambda d: F.array(d, (d.try_cast("bigint") + 1).cast("string"))
        both = let(less, lambda d: F.when(F.substring(x["d"], -1, 1) < "5", rounded(d)).otherwise(F.reverse(rounded(d))))
        same = lambda d: F.concat(d, F.lit("E"), (x["p"] - F.length(x["d"]) + 1).cast("string")).try_cast("double") == F.abs(v)
        cut = F.transform(F.filter(both, same), lambda d: F.struct(F.rtrim(d, F.lit("0")).alias("d"), (x["p"] - F.length(x["d"]) + 1 + F.length(d)).alias("p")))
        return F.coalesce(F.get(cut, F.lit(0)), x)

    def placed(d: Column, p: Column) -> Column:
        n = F.length(d)
        plain = (
            F.when(p <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
            .when(n <= p, F.concat(F.rpad(d, p, "0"), F.lit(".0")))
            .otherwise(F.concat(F.substring(d, F.lit(1), p), F.lit("."), F.substring(d, p + 1, n)))
        )
        e = p - 1
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise("")
        power = F.concat(F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
        return F.when((e >= -4) & (e < 16), plain).otherwise(F.concat(F.substring(d, 1, 1), rest, F.lit("e"), power))

    return F.coalesce(let(value.cast("double"), shown), F.lit("null"))


def canonical_json(text: Column) -> Column:
    """Sorted keys, compact, ASCII, numbers as Python prints them; null when the text is not JSON."""
    sort = lambda t: F.to_json(F.try_parse_json(t))

    # Escapes stand for a while as control characters, which JSON has not, so that every quote ends a string.
    hidden = lambda t: F.replace(F.replace(t, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    restored = lambda t: F.replace(F.replace(t, F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))

    def number(t: Column) -> Column:
        return F.when(t.rlike("[.eE]"), json_float(t.try_cast("double"))).otherwise(F.when(t == "-0", "0").otherwise(t))

    def kept_numbers(t: Column) -> Column:
        # Strings get the letter s, numbers become strings with the letter n while keys are sorted.
        tagged = F.transform(
            F.split(hidden(t), '"'), lambda x, i: F.when(i % 2 == 1, F.concat(F.lit("s"), x)).otherwise(F.regexp_replace(x, r"-?[0-9][0-9.eE+-]*", '"n$0"'))
        )
        parts = F.split(hidden(sort(restored(F.array_join(tagged, '"')))), '"')
        read = F.transform(
            parts,
            lambda x, i: F.when(i % 2 == 0, x).when(x.startswith("n"), number(F.substr(x, F.lit(2)))).otherwise(F.concat(F.lit('"'), F.substr(x, F.lit(2)), F.lit('"'))),
        )
        return F.when(F.try_parse_json(t).isNotNull(), restored(F.array_join(read, "")))

    # Sorting alone leaves numbers as they are but these: exponents, zeros at the end of a fraction, minus zero, small and long ones.
    special = text.rlike(r"(?:^|[:,\[])\s*(?:-0(?![0-9.])|-?(?:[0-9.]+[eE]|[0-9]+\.[0-9]*0(?![0-9])|[0-9]+\.0000|[0-9.]{16}))")
    return let(F.when(special, let(text, kept_numbers)).otherwise(sort(text)), ascii_escape)


def natural_id(*columns: str) -> Column:
    """A stable identifier from natural key columns."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]), 256)
