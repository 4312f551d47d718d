"""Model replies: the deterministic stand-in model, and JSON replies made into metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docmetrics.functions.normalize import is_valid_value, normalize_value
from docmetrics.functions.text import clean_json, head, json_object, let, strip, token_estimate
from docmetrics.schemas import MAX_SOURCE_TEXT, METRICS
from docmetrics.session import once

# What the stand-in model looks for, in this order, and how a number may follow.
KEYWORDS = [
    ("Cash and Cash Equivalents", "cash_and_equivalents"), ("Cash and Equivalents", "cash_and_equivalents"), ("Cash & Cash Equivalents", "cash_and_equivalents"),
    ("Earnings Per Share (Diluted)", "eps"), ("Earnings Per Share", "eps"), ("EPS (Diluted)", "eps"), ("Diluted EPS", "eps"),
    ("Operating Income", "operating_income"), ("Income from Operations", "operating_income"), ("Total Assets", "total_assets"),
    ("Total Liabilities", "total_liabilities"), ("Net Income", "net_income"), ("Net Earnings", "net_income"), ("Net Profit", "net_income"),
    ("Total Revenue", "revenue"), ("Net Revenue", "revenue"), ("Revenue", "revenue"), ("Net Sales", "revenue"), ("Total Net Sales", "revenue"),
]
AFTER = r"^(?:[^\n]*\n){0,2}?[\t ]*:?[\t ]*\$?([-(]?[0-9,]+(?:\.[0-9]+)?\)?)"
REACH, UNIT, CURRENCY, CONFIDENCE = 300, "million USD", "USD", 0.70


def mock_scan(contexts: DataFrame, context: str = "context") -> DataFrame:
    """(columns of contexts but the context itself, field_name, value, unit, currency, source_text, confidence): what the stand-in model finds.

    For each keyword, in order, the first place where it stands (any case): a number after it on the same line, the next or the one after that,
    within 300 code points.  The first keyword of a field with a number decides, even if that is a lone comma.  Null contexts have none.
    """
    kept = [c for c in contexts.columns if c != context]
    base = contexts.select(*[F.col(f"`{c}`") for c in kept], F.col(context).alias("_text"), F.lower(context).alias("_low"))
    found: dict[str, list[Column]] = {}
    for word, field in KEYWORDS:
        at = F.instr("_low", F.lit(word.lower()))
        number = F.nullif(F.regexp_extract(F.substr("_text", at + len(word), F.lit(REACH)), AFTER, 1), F.lit(""))
        first = F.greatest(F.lit(1), at - 20)
        source = strip(F.substr("_text", first, at + len(word) + 80 - first))
        found.setdefault(field, []).append(F.when((at > 0) & number.isNotNull(), F.struct(F.lit(field).alias("field_name"), number.alias("value"), source.alias("source_text"))))
    hits = F.array_compact(F.array(*[F.coalesce(*found[m]) for m in METRICS]))
    out = base.select(*[F.col(f"`{c}`") for c in kept], F.inline(hits))
    return out.select(*[F.col(f"`{c}`") for c in kept], "field_name", "value", F.lit(UNIT).alias("unit"), F.lit(CURRENCY).alias("currency"), "source_text", F.lit(CONFIDENCE).alias("confidence"))


def mock_replies(contexts: DataFrame, prompt: str | Column = "") -> DataFrame:
    """contexts with the stand-in model's reply: text (JSON, indented by two), provider, model, input_tokens, output_tokens.

    ``contexts`` has document_id, pipeline and context, one row for each pair.  Every field is in the reply, null where nothing was found.
    Characters outside of ASCII stay in the text, but the token estimate counts their escaped form, six characters each (twelve beyond
    the basic plane).
    """
    keys = ["document_id", "pipeline"]
    found = mock_scan(contexts.select(*keys, "context"))
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("x")))) - 6)
    lines = [("value", quoted("value")), ("unit", quoted("unit")), ("currency", quoted("currency")), ("source_text", quoted("source_text")), ("confidence", F.lit(str(CONFIDENCE)))]
    body = F.concat(F.lit("{\n"), *[x for i, (k, v) in enumerate(lines) for x in (F.lit(f'    "{k}": '), v, F.lit(",\n" if i < 4 else "\n"))], F.lit("  }"))
    bodies = found.select(*keys, "field_name", body.alias("body")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("field_name", "body"))).alias("_b"))
    out = contexts.join(bodies, keys, "left")
    entries = [F.concat(F.lit(f'  "{m}": '), F.coalesce(F.try_element_at("_b", F.lit(m)), F.lit("null"))) for m in METRICS]
    reply = F.concat(F.lit("{\n"), F.concat_ws(",\n", *entries), F.lit("\n}"))
    prompt = F.lit(prompt) if isinstance(prompt, str) else prompt
    out = out.withColumn("text", reply).drop("_b")
    wide = F.length(F.regexp_replace("text", r"[\x00-\x7f]", ""))
    astral = F.length(F.regexp_replace("text", r"[\x00-\x{ffff}]", ""))
    tokens = F.greatest(F.lit(1), F.floor((F.length("text") + 5 * wide + 6 * astral) / 4)).cast("bigint")
    return out.withColumns({"provider": F.lit("mock"), "model": F.lit("mock-model-v1"), "input_tokens": token_estimate(F.concat(prompt, F.coalesce("context", F.lit("")))), "output_tokens": tokens})


def json_metrics(replies: DataFrame, text: str = "text") -> DataFrame:
    """Seven rows per reply that is a JSON object: (columns of replies but the text, field_name, value, original_value, unit, currency, source_text, confidence, error).

    A field may be an object with value, unit, currency, source_text and confidence, a number (a truth value counts as one) or a string;
    strings go through the normaliser.  A missing or null field or value is null without an error.  ``error`` is ``unexpected_type`` (a list),
    ``normalization`` (a string that is no value), ``unit_type`` (a unit that isn't a string) or ``validation`` (no finite value, a confidence outside of
    0 to 1, a source text over 2,000 code points); the metric is null then.  The unit is the stated one unless that is empty or USD, else the
    normaliser's; a currency counts if it is three capitals.  Replies that aren't a JSON object have no rows.
    """
    kept = [c for c in replies.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0).alias("_"))
    objects = once(replies.select(row.alias("_row"), F.col(text).alias("_t")), "_o", F.struct(F.from_json(clean_json(F.col("_t")), "map<string, string>").alias("m"), json_object(F.col("_t")).alias("v"))).where("_o.v IS NOT NULL")
    # numbers as they are written come from the text itself: a variant doesn't keep the zero of 8.0
    entries = F.array(*[F.struct(F.lit(m).alias("field_name"), F.variant_get("_o.v", f"$.{m}", "variant").alias("f"), F.try_element_at("_o.m", F.lit(m)).alias("w")) for m in METRICS])
    x = objects.select("_row", F.inline(entries))
    kind = let(F.coalesce(F.schema_of_variant("f"), F.lit("VOID")), lambda k: F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "list").when(k == "VOID", "null").otherwise("plain"))
    x = once(x, "_k", kind)
    part = lambda k, t: F.when(F.col("_k") == "object", F.try_variant_get("f", f"$.{k}", t))
    value = F.when(F.col("_k") == "object", F.try_variant_get("f", "$.value", "variant")).when(F.col("_k") == "plain", F.col("f")).alias("value")
    unit_kind = F.coalesce(F.schema_of_variant(part("unit", "variant")), F.lit("VOID"))
    x = once(x, "_p", F.struct(value, part("unit", "string").alias("unit"), (~unit_kind.isin("STRING", "VOID")).alias("odd_unit"), part("currency", "string").alias("currency"), strip(part("source_text", "string")).alias("source"), part("confidence", "double").alias("confidence")))
    shape = let(F.coalesce(F.schema_of_variant("_p.value"), F.lit("VOID")), lambda s: F.when(s == "VOID", "none").when(s == "BOOLEAN", "truth").when(s.isin("BIGINT", "DOUBLE") | s.startswith("DECIMAL"), "number").otherwise("text"))
    x = once(x.select("_row", "field_name", "_k", "_p", "w"), "_s", shape)
    number = F.when(F.col("_s") == "truth", F.try_variant_get("_p.value", "$", "boolean").cast("double")).when(F.col("_s") == "number", F.try_variant_get("_p.value", "$", "double"))
    w = F.when(F.col("_k") == "object", F.get_json_object("w", "$.value")).otherwise(F.col("w"))
    written = F.when(F.col("_s") == "text", F.try_variant_get("_p.value", "$", "string")).when(F.col("_s") == "truth", F.initcap(w)).when(F.col("_s") == "number", w)
    hint, money = (F.coalesce(F.nullif(F.col(f"_p.{c}"), F.lit("")), F.lit("USD")) for c in ("unit", "currency"))
    x = once(x, "_q", F.struct(number.alias("number"), written.alias("written"), hint.alias("hint"), money.alias("money")))
    x = x.select("_row", "field_name", "_k", "_s", "_q", F.col("_p.odd_unit").alias("_odd"), F.col("_p.source").alias("_source"), F.col("_p.confidence").alias("_sure"))
    base = F.when(F.col("field_name") == "eps", "USD per share").otherwise("USD")
    x = once(x, "_n", normalize_value(F.when(F.col("_s") == "text", F.col("_q.written")), F.col("_q.money"), base))
    text_value = F.col("_s") == "text"
    value = F.when(text_value, F.col("_n.value")).otherwise(F.col("_q.number"))
    unit = F.when(text_value & (F.col("_q.hint") == "USD"), F.col("_n.unit")).otherwise(F.col("_q.hint"))
    currency = let(strip(F.when(text_value, F.coalesce("_n.currency", "_q.money")).otherwise(F.col("_q.money"))), lambda c: F.when(c.rlike("^[A-Z]{3}$"), c))
    sound = F.coalesce(is_valid_value(value), F.lit(False)) & F.coalesce(F.col("_sure").between(0, 1), F.lit(True)) & (F.coalesce(F.length("_source"), F.lit(0)) <= MAX_SOURCE_TEXT)
    error = F.when(F.col("_k") == "list", "unexpected_type").when(F.col("_s") == "none", None).when(F.col("_odd"), "unit_type").when(text_value & F.col("_n.error").isNotNull(), "normalization").when(~sound, "validation")
    stated = F.col("_s") != "none"
    found = {"value": value, "original_value": F.col("_q.written"), "unit": unit, "currency": currency, "source_text": F.col("_source"), "confidence": F.col("_sure")}
    x = once(x, "_r", F.struct(error.alias("error"), stated.alias("stated"), *[v.alias(k) for k, v in found.items()]))
    ok = F.col("_r.error").isNull() & F.col("_r.stated")
    return x.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "field_name", *[F.when(ok, F.col(f"_r.{k}")).alias(k) for k in found], F.col("_r.error").alias("error"))


def unreadable(replies: DataFrame, text: str = "text") -> DataFrame:
    """The replies that aren't a JSON object, with ``reply_start``, the first 500 code points, for a second request."""
    return replies.where(json_object(F.col(text)).isNull()).withColumn("reply_start", head(F.col(text), 500))


def reports(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """One row per report: (keys, extracted, coverage, status, errors); the metrics are the rows of :func:`json_metrics`.

    A report without any field is ``invalid`` and says so in its errors, with fewer than seven ``partial``, else ``valid``.
    """
    from docmetrics.operators.metrics import status

    n = F.count("value")
    failed = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.concat("field_name", F.lit(": "), "error"))))
    out = metrics.groupBy(*keys).agg(n.alias("extracted"), failed.alias("errors"))
    none = F.when(F.col("extracted") == 0, F.array(F.lit("no field was extracted"))).otherwise(F.array().cast("array<string>"))
    return out.select(*keys, "extracted", (F.col("extracted") / len(METRICS)).alias("coverage"), status(F.col("extracted")).alias("status"), F.concat("errors", none).alias("errors"))
