"""Printed financial values, currencies and units, brought to one form.

Every step is a regular expression on the whole string; what several steps use is bound once (:func:`docmetrics.functions.text.let`), so that
the expression stays short.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docmetrics.functions.text import let, strip

# Signs of currencies, words and letters of scales, written names of currencies, canonical units.
SYMBOLS = {"US$": "USD", "CA$": "CAD", "HK$": "HKD", "A$": "AUD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₩": "KRW", "₣": "CHF"}
SCALES = {
    "trillion": 1e12, "trillions": 1e12, "billion": 1e9, "billions": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "millions": 1e6,
    "mn": 1e6, "mm": 1e6, "m": 1e6, "thousand": 1e3, "thousands": 1e3, "k": 1e3,
}
NAMES = {
    "us dollar": "USD", "us dollars": "USD", "dollar": "USD", "dollars": "USD", "euro": "EUR", "euros": "EUR", "pound": "GBP",
    "pounds": "GBP", "yen": "JPY", "rupee": "INR", "rupees": "INR",
}
UNITS = {"millions": "million", "mn": "million", "mm": "million", "billions": "billion", "bn": "billion", "thousands": "thousand", "k": "thousand"}

SYMBOL = r"^(US\$|CA\$|HK\$|A\$|\$|€|£|¥|₹|₩|₣)"
#: A scale word as a whole word at the end, or else one letter there.
SCALE = r"(?i)(?:\b(?:trillions?|billions?|bn|millions?|mn|mm|thousands?)\s*|[kmb])$"
NEGATIVE = r"(?s)^(?:\((.*)\)|-(.*))$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _lookup(values: dict[str, object], key: Column) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), F.lit(v))]
    return F.try_element_at(F.create_map(*pairs), key)


def currency_sign(x: Column) -> Column:
    """ISO code of the sign a text begins with, the longest that fits; null without one."""
    return _lookup(SYMBOLS, F.regexp_extract(strip(x), SYMBOL, 1))


def is_negative(x: Column) -> Column:
    """Whether a text is in brackets or begins with a minus."""
    return strip(x).rlike(NEGATIVE)


def _unsigned(x: Column) -> Column:
    return strip(F.regexp_replace(x, NEGATIVE, "$1$2"))


def scale(x: Column) -> Column:
    """Factor of the scale word or letter at the end of a text, 1 without one.

    A word counts only as a whole word (``500 mm``, not ``500mm``); otherwise the last letter k, m or b does.
    """
    return F.coalesce(_lookup(SCALES, F.lower(strip(F.regexp_extract(x, SCALE, 0)))), F.lit(1.0))


def parse_number(x: Column) -> Column:
    """A plain number without its commas, null if it isn't one (NaN and infinite values aren't)."""
    digits = strip(F.replace(x, F.lit(","), F.lit("")))
    return let(digits, lambda d: let(F.when(d.rlike(NUMBER), d.try_cast("double")), lambda v: F.when(is_valid_value(v), v)))


def is_valid_value(value: Column) -> Column:
    """Whether a number is finite; null for null."""
    return ~F.isnan(value) & (F.abs(value) < float("inf"))


def normalize_value(raw: Column, default_currency: str | Column | None = "USD", base_unit: str | Column = "USD") -> Column:
    """A printed value as a struct (value, unit, currency, original, is_negative, multiplier, error).

    In this order: brackets or a minus make it negative; a currency sign in front is taken off; a scale at the end multiplies; if it
    isn't negative yet, brackets or a minus are looked for again; what remains is the number.  The unit is the scale's name and
    ``base_unit``, whatever the currency.  ``error`` is ``empty_input`` (null or blank), ``empty_number`` or ``not_a_number``; the value
    is null then.
    """
    default = F.lit(default_currency).cast("string") if not isinstance(default_currency, Column) else default_currency
    base = F.lit(base_unit) if isinstance(base_unit, str) else base_unit
    names = {"1.0E12": "trillion ", "1.0E9": "billion ", "1000000.0": "million ", "1000.0": "thousand "}

    def signed(text: Column) -> Column:
        inner = _unsigned(text)
        return let(F.struct(text.alias("text"), text.rlike(NEGATIVE).alias("first"), currency_sign(inner).alias("sign"), strip(F.regexp_replace(inner, SYMBOL, "")).alias("bare")), scaled)

    def scaled(s: Column) -> Column:
        unscaled = strip(F.regexp_replace(s["bare"], SCALE, ""))
        return let(unscaled, lambda u: let(F.when(s["first"], u).otherwise(_unsigned(u)), lambda n: finished(s, n, s["first"] | u.rlike(NEGATIVE))))

    def finished(s: Column, number: Column, negative: Column) -> Column:
        return let(F.struct(parse_number(number).alias("n"), scale(s["bare"]).alias("by"), negative.alias("neg")), lambda r: result(s, number, r))

    def result(s: Column, number: Column, r: Column) -> Column:
        empty = strip(F.replace(number, F.lit(","), F.lit(""))) == ""
        error = F.when(F.coalesce(s["text"], F.lit("")) == "", "empty_input").when(empty, "empty_number").when(r["n"].isNull(), "not_a_number")
        ok = r["n"].isNotNull()
        return F.struct(
            (F.when(r["neg"], -1.0).otherwise(1.0) * r["n"] * r["by"]).alias("value"),
            F.when(ok, strip(F.concat(F.coalesce(_lookup(names, r["by"].cast("string")), F.lit("")), base))).alias("unit"),
            F.when(ok, F.coalesce(s["sign"], default)).alias("currency"),
            raw.alias("original"),
            F.when(ok, r["neg"]).alias("is_negative"),
            F.when(ok, r["by"]).alias("multiplier"),
            error.alias("error"),
        )

    return let(strip(raw), signed)


def currency_code(raw: Column) -> Column:
    """ISO code of a currency: any three letters in upper case, else by sign, else by written name; null if unknown.

    Three letters come first, so that ``yen`` gives YEN.
    """
    x = strip(raw)
    code = F.upper(x)
    return F.when(code.rlike(r"^[A-Z]{3}$"), code).otherwise(F.coalesce(_lookup(SYMBOLS, x), _lookup(NAMES, F.lower(x))))


def unit_name(raw: Column) -> Column:
    """A unit in lower case, abbreviations and plurals of a bare scale replaced by its name; others stay as they are."""
    x = F.lower(strip(raw))
    return F.coalesce(_lookup(UNITS, x), x)
