"""Problem 2: CSV records of which some are damaged, split into typed rows and rejects with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from docmetrics.session import once

# The columns of the ground-truth CSV.
NUMBERS = ["revenue", "net_income", "operating_income", "total_assets", "total_liabilities", "cash_and_equivalents", "eps"]
FIELDS = ["company", "fiscal_year", *NUMBERS, "currency", "unit", "source"]
#: A plain decimal number, thousands commas removed: sign, digits with at most one point, exponent.
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
GROUPED = r"^[+-]?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]*)?([eE][+-]?[0-9]+)?$"
MARK, ESCAPED, BREAK = "\x1f", "\x1f0", "\x1f1"


def _outer(i: Column) -> Column:
    return i % 2 == 0


def _well_quoted(parts: Column) -> Column:
    """``parts``: the record split at its quotes.  Even parts lie outside of quotes: the first must be empty or end at a
    comma, the last be empty or begin with one, any between be empty (a doubled quote) or both.  An even count of parts
    means that a quote was never closed."""
    n = F.size(parts)
    bad = F.transform(
        parts,
        lambda p, i: _outer(i)
        & (p != "")
        & ~(((i == 0) | p.startswith(",")) & ((i == n - 1) | p.endswith(","))),
    )
    return (n % 2 == 1) & ((n == 1) | ~F.exists(bad, lambda b: b))


def _split(parts: Column) -> Column:
    """The fields of a well-quoted record.  Commas outside of quotes become a break that can't occur in the text, as its first character is escaped there."""
    escaped = F.transform(parts, lambda p: F.replace(p, F.lit(MARK), F.lit(ESCAPED)))
    n = F.size(parts)
    joined = F.transform(
        escaped,
        lambda p, i: F.when(_outer(i) & (p == "") & (i > 0) & (i < n - 1), F.lit('"')).when(_outer(i), F.replace(p, F.lit(","), F.lit(BREAK))).otherwise(p),
    )
    return F.transform(F.split(F.array_join(joined, ""), BREAK), lambda f: F.replace(f, F.lit(ESCAPED), F.lit(MARK)))


def _clean(field: Column) -> Column:
    return F.regexp_replace(field, r"(?U)^\s+|\s+$", "")


def number(field: Column) -> Column:
    """The value of a number as the records write it, null if blank or damaged."""
    x = _clean(field)
    value = F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    return F.when((x.rlike(NUMBER) | x.rlike(GROUPED)) & (F.abs(value) < float("inf")), value)


def read_records(df: DataFrame, raw: str = "raw_line") -> DataFrame:
    """Add ``record`` (a struct of the 12 typed fields, null for damaged records) and ``reason`` (null for sound ones).

    The raw text is read permissively under an explicit schema of strings that keeps the corrupt text.  Records the reader
    took, with neither quotes nor line breaks in them, keep its fields; all others are classified again by their quotes and
    count, since the reader also takes stray quotes and ends a record at an unquoted line break.  Then the values are cast.
    Reasons, the first that applies: ``broken_quoting``, ``column_count``, ``invalid_value``.  A null or empty text is one
    empty field: ``column_count``.  No UDF; the pass is narrow, without a shuffle, and reads each text once.  Columns of
    ``df`` named record or reason are replaced.
    """
    schema = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS] + [T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "quote": '"', "escape": '"', "multiLine": "true"}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("record", "reason")]
    x = df.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(raw), F.lit("")).alias("_text"))
    parsed = F.struct(F.from_csv("_text", _ddl(schema), options).alias("read"), F.split("_text", '"').alias("parts"))
    x = once(x, "_a", parsed)
    plain = ~F.col("_text").rlike('["\\r\\n\x1f]') & F.col("_a.read._corrupt").isNull() & (F.col("_text") != "")
    x = once(x, "_b", F.struct(plain.alias("plain"), (plain | _well_quoted(F.col("_a.parts"))).alias("quoted")))
    fields = F.when(F.col("_b.plain"), F.array(*[F.col(f"_a.read.{f}") for f in FIELDS])).when(F.col("_b.quoted"), _split(F.col("_a.parts")))
    x = once(x.select("_row", "_b.quoted", fields.alias("_fields")), "_c", F.struct(*[F.coalesce(F.get(F.col("_fields"), F.lit(i)), F.lit("")).alias(f) for i, f in enumerate(FIELDS)], F.size("_fields").alias("n")))
    year = _clean(F.col("_c.fiscal_year"))
    year = F.when(year.rlike(r"^\+?[0-9]{4}$"), year.try_cast("int"))
    cast = [F.when(year.between(1900, 2100), year).alias("fiscal_year")]
    for f in NUMBERS:
        cast += [number(F.col(f"_c.{f}")).alias(f), (_clean(F.col(f"_c.{f}")) == "").alias(f"{f}_blank")]
    x = once(x.select("_row", "quoted", "_c"), "_d", F.struct(*cast))
    sound = F.col("_d.fiscal_year").isNotNull()
    for f in NUMBERS:
        sound = sound & (F.col(f"_d.{f}_blank") | F.col(f"_d.{f}").isNotNull())
    reason = F.when(~F.col("quoted"), "broken_quoting").when(F.col("_c.n") != len(FIELDS), "column_count").when(~sound, "invalid_value")
    x = once(x, "_e", F.struct(reason.alias("reason")))
    typed = [F.nullif(F.col("_c.company"), F.lit("")).alias("company"), *(F.col(f"_d.{f}") for f in ("fiscal_year", *NUMBERS)), *(F.nullif(F.col(f"_c.{f}"), F.lit("")).alias(f) for f in ("currency", "unit", "source"))]
    return x.select("_row.*", F.when(F.col("_e.reason").isNull(), F.struct(*typed)).alias("record"), F.col("_e.reason").alias("reason"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)


def rejected(df: DataFrame, key: str = "record_id", raw: str = "raw_line") -> DataFrame:
    """(record_id, reason) of every damaged record."""
    return read_records(df.select(key, raw), raw).where("reason IS NOT NULL").select(key, "reason")


def loaded(df: DataFrame, key: str = "record_id", raw: str = "raw_line") -> DataFrame:
    """(record_id, the 12 typed fields) of every sound record."""
    return read_records(df.select(key, raw), raw).where("reason IS NULL").select(key, "record.*")
