"""Problem 3: one quantity in many scales, currencies and per-share units, brought to whole US dollars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.functions.text import let
from docmetrics.session import cut

# How currencies and scales are written, the first pattern that applies.
CURRENCIES = [
    ("USD", r"usd|us\$|us dollar"), ("CAD", r"cad|ca\$|c\$|canadian"), ("AUD", r"aud|a\$|australian"), ("EUR", r"eur|€"), ("GBP", r"gbp|£|pound|sterling|pence"),
    ("INR", r"inr|₹|rupee|(?<![a-z])rs(?![a-z])"), ("JPY", r"jpy|¥|yen|円"), ("CHF", r"chf|swiss|franc"), ("USD", r"\$|dollar"),
]
SCALES = [
    (1e8, r"hundreds? of millions?|100 ?millions?|億"), (1e12, r"trillions?|(?<![a-z])tr?n(?![a-z])"), (1e9, r"billions?|milliards?|(?<![a-z])(?:bn|b|mrd)(?![a-z])"),
    (1e6, r"millions?|(?<![a-z])(?:mio|mn|mm|m|mln)(?![a-z])"), (1e7, r"crores?|(?<![a-z])cr(?![a-z])"), (1e5, r"lakhs?|lacs?(?![a-z])"),
    (1e3, r"thousands?|(?<![0-9,.])000 ?s|(?<![0-9])['’]000|\(000\)|(?<![a-z])[kt](?![a-z])"),
]
_CODES = r"usd|eur|gbp|inr|jpy|chf|cad|aud|us\$|ca\$|[$€£¥₹円]"
CENTS = r"(?<![a-z])cents?(?![a-z])|¢|pence|penny|paise"
SPACES = r"[\s\x{a0}\x{2009}\x{202f}\x{2007}'’]"
NUMBER = r"[0-9](?:[0-9.,\s\x{a0}\x{2009}\x{202f}\x{2007}'’]*[0-9])?"


def _first(rules: list[tuple], text: Column, like: Column | None = None) -> Column:
    return F.coalesce(*[F.when(text.rlike(pattern), F.lit(value)) for value, pattern in rules])


def currency_of(text: Column) -> Column:
    """ISO code of the currency that a text names, or null."""
    return let(F.lower(text), lambda t: _first(CURRENCIES, t))


def scale_of(text: Column) -> Column:
    """Factor of the scale that a text states, or null.  Codes and signs of currencies are cut out first, so that kUSD, USDm and TEUR are read."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), _CODES, " "), r"(?<=[0-9])(?=[a-z])", " ")
    return let(bare, lambda t: _first(SCALES, t))


def printed_number(text: Column) -> Column:
    """The number as printed, with its sign.

    A last comma followed by exactly two digits is a decimal comma; otherwise a single point is a decimal point; all other commas,
    points, apostrophes and spaces group digits.  Brackets around the whole, or a minus before or after the digits, make it negative.
    """
    def digits(raw: Column) -> Column:
        comma = F.concat(F.regexp_replace(F.regexp_extract(raw, r"^(.*),[0-9]{2}$", 1), "[.,]", ""), F.lit("."), F.right(raw, F.lit(2)))
        return F.when(raw.rlike(r",[0-9]{2}$"), comma).when(raw.rlike(r"^[0-9,]*\.[0-9]+$"), F.replace(raw, F.lit(","), F.lit(""))).otherwise(F.regexp_replace(raw, "[.,]", ""))

    plain = let(F.regexp_replace(F.regexp_extract(text, NUMBER, 0), SPACES, ""), digits)
    minus = text.rlike(r"^\s*\(.*\)\s*$") | text.rlike(r"^[^0-9]*[-−–][^0-9]*[0-9]") | text.rlike(r"[0-9]\s*[-−–]\s*([a-zA-Z].*)?$")
    return F.when(minus, -1.0).otherwise(1.0) * plain.try_cast("double")


def stated(records: DataFrame) -> DataFrame:
    """Each record once, with what it states: (metric_id, document_id, field_name, pipeline, value, number, currency, scale, scale_stated, scale_known).

    Repeated rows have the same metric_id.  Of several statements the nearest to the number counts: original_value, then unit, then the currency column,
    then source_text.  Earnings per share have no scale but cents.  The scale of a record that states none is 1; it is known to be that where the
    unit names something else only, such as a currency.
    """
    r = records.select("metric_id", "document_id", "field_name", "pipeline", "value", "original_value", "unit", "currency", "source_text").dropDuplicates(["metric_id"])
    number = F.when(F.col("original_value").isNull(), F.col("value")).otherwise(printed_number(F.col("original_value")))
    eps = F.col("field_name") == "eps"
    cents = reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c)).rlike(CENTS), F.lit(False)) for c in ("original_value", "unit", "source_text")])
    scale = F.coalesce(*[scale_of(F.col(c)) for c in ("original_value", "unit", "source_text")])
    scale = F.when(eps, F.when(cents, 0.01)).otherwise(scale)
    currency = F.coalesce(*[currency_of(F.col(c)) for c in ("original_value", "unit", "currency", "source_text")])
    told = scale.isNotNull()
    return r.select("metric_id", "document_id", "field_name", "pipeline", F.when(~F.isnan("value"), F.col("value")).alias("value"), F.when(~F.isnan(number), number).alias("number"), currency.alias("currency"), F.coalesce(scale, F.lit(1.0)).alias("scale"), told.alias("scale_stated"), (told | (F.trim(F.coalesce("unit", F.lit(""))) != "")).alias("scale_known"))


def predictions(base: DataFrame) -> DataFrame:
    """base with currency and probability, predicted_scale and scale_probability: stated ones with probability 1, missing ones from the forests.

    ``base`` is :func:`stated`, rows with a number.  Features are made for the records that miss something and for the bounded sample that trains the forests;
    what is stated passes by.  The forest of the scales is always trained, that of the currencies only where one is missing.  A target that nothing can be
    learnt about, all labels being one class, is predicted with probability 0.
    """
    from docmetrics.operators import unit_model as m

    targets = {"scale": (m.SCALES, F.col("scale_known")), "currency": (m.CURRENCIES, F.col("currency").isNotNull())}
    picked = m.picks(base, targets)
    missing = ~F.col("scale_known") | F.col("currency").isNull()
    rows = base.withColumns({"_missing": missing, "_scale": picked["scale"], "_currency": picked["currency"]}).where("_missing OR _scale OR _currency")
    x = cut(m.features(base, rows))
    open_ = x.where("_missing")
    model = m.train(x.where("_scale"), "scale", m.SCALES)
    if model is None:
        open_ = open_.withColumns({"predicted": F.lit(1.0), "chance": F.lit(0.0)})
    else:
        open_ = model.predict(open_)
    open_ = open_.withColumns({"predicted_scale": F.when(F.col("scale_known"), F.col("scale")).otherwise(F.col("predicted")), "scale_probability": F.when(F.col("scale_known"), 1.0).otherwise(F.col("chance"))}).drop("predicted", "chance")
    told = open_.where("currency IS NOT NULL").withColumn("probability", F.lit(1.0))
    open_ = open_.where("currency IS NULL")
    if open_.isEmpty():
        guessed = None
    elif (model := m.train(x.where("_currency"), "currency", m.CURRENCIES)) is None:
        guessed = open_.withColumn("probability", F.lit(0.0))
    else:
        guessed = model.predict(open_).withColumn("currency", F.col("predicted")).withColumn("probability", F.col("chance"))
    cols = [*base.columns, "probability", "predicted_scale", "scale_probability"]
    out = base.where(~missing).withColumns({"probability": F.lit(1.0), "predicted_scale": F.col("scale"), "scale_probability": F.lit(1.0)}).select(*cols).unionByName(told.select(*cols))
    return out if guessed is None else out.unionByName(guessed.select(*cols))


def quantities(records: DataFrame, filings: DataFrame, rates: DataFrame) -> DataFrame:
    """(metric_id, document_id, field_name, amount, currency, probability, usd, predicted_scale, scale_probability, route) of each record with a number.

    ``amount`` is the printed number times its stated scale; stated nowhere, it is in whole units.  A missing currency is predicted (:mod:`docmetrics.operators.unit_model`);
    an uncertain one gives no dollar amount.  Routes: ``review`` for an uncertain currency, and for a record without unit and scale that the forest isn't
    confident to be in whole units; ``no_rate`` where the filing's fiscal year has no rate for the currency; else ``converted``.  The forest doesn't change an amount: what
    it expects instead is in predicted_scale.  Rates are of the filing's year; US dollars need none.
    """
    from docmetrics.operators.unit_model import CONFIDENT

    base = cut(stated(records)).where("number IS NOT NULL")  # read three times by the features
    years = filings.where("document_id IS NOT NULL").groupBy("document_id").agg(F.max("fiscal_year").alias("fiscal_year"))
    known = rates.groupBy("currency", "fiscal_year").agg(F.max("usd_per_unit").alias("rate"))
    out = predictions(base).join(years, "document_id", "left").join(known, ["currency", "fiscal_year"], "left")
    rate = F.when(F.col("currency") == "USD", 1.0).otherwise(F.col("rate"))
    sure = F.coalesce(F.col("probability") >= CONFIDENT, F.lit(False))
    whole = F.col("scale_known") | (F.col("predicted_scale") == 1) & (F.col("scale_probability") >= CONFIDENT)
    route = F.when(~sure, "review").when(rate.isNull(), "no_rate").when(~whole, "review").otherwise("converted")
    amount = F.col("number") * F.col("scale")
    return out.select("metric_id", "document_id", "field_name", amount.alias("amount"), "currency", "probability", F.when(sure, amount * rate).alias("usd"), "predicted_scale", "scale_probability", route.alias("route"))


def disagreements(q: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(metric_id_a, metric_id_b) of the same document and field whose dollar amounts differ by more than ``tolerance`` of the larger one.

    Amounts are compared between distinct values, so that records which agree exactly aren't compared with one another.  Null documents or fields have no pairs.
    """
    key = ["document_id", "field_name"]
    base = cut(q.where("usd IS NOT NULL").select("metric_id", *key, "usd"))
    values = base.select(*key, "usd").distinct()
    a, b = (values.withColumnRenamed("usd", f"usd_{x}") for x in "ab")
    apart = a.join(b, key).where((F.col("usd_a") < F.col("usd_b")) & (F.col("usd_b") - F.col("usd_a") > tolerance * F.greatest(F.abs("usd_a"), F.abs("usd_b"))))
    left, right = (base.select(*key, F.col("usd").alias(f"usd_{x}"), F.col("metric_id").alias(f"_{x}")) for x in "ab")
    pairs = apart.join(left, [*key, "usd_a"]).join(right, [*key, "usd_b"])
    return pairs.select(F.least("_a", "_b").alias("metric_id_a"), F.greatest("_a", "_b").alias("metric_id_b")).distinct()
