import pytest
from pyspark.sql import functions as F

from docmetrics.functions import normalize as n, tables as t, text as x


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def value(spark, raw, **options):
    return one(spark, n.normalize_value(F.lit(raw).cast("string"), **options))


@pytest.mark.parametrize(("raw", "expected", "unit", "currency"), [
    ("$416,161", 416161.0, "USD", "USD"), ("416,161 million", 416161e6, "million USD", "USD"), ("416.161 billion", 416.161e9, "billion USD", "USD"),
    ("(12,500)", -12500.0, "USD", "USD"), ("-12,500", -12500.0, "USD", "USD"), ("(12,500) million", -12500e6, "million USD", "USD"), ("€5 million", 5e6, "million USD", "EUR"),
    ("US$ 7", 7.0, "USD", "USD"), ("HK$7", 7.0, "USD", "HKD"), ("2.5M", 2.5e6, "million USD", "USD"), ("3k", 3e3, "thousand USD", "USD"), ("1.2 trillion", 1.2e12, "trillion USD", "USD"),
    ("500 mm", 5e8, "million USD", "USD"), ("$-500", -500.0, "USD", "USD"), ("$(500)", -500.0, "USD", "USD"), ("  42  ", 42.0, "USD", "USD"), ("1e3", 1000.0, "USD", "USD"), ("5 BILLION", 5e9, "billion USD", "USD"),
])
def test_values(spark, raw, expected, unit, currency):
    got = value(spark, raw)
    assert got.error is None and got.value == pytest.approx(expected) and (got.unit, got.currency) == (unit, currency) and got.original == raw


@pytest.mark.parametrize(("raw", "error"), [(None, "empty_input"), ("  ", "empty_input"), ("$", "empty_number"), (",", "empty_number"), ("n/a", "not_a_number"), ("500mm", "not_a_number"), ("2.5bn", "not_a_number"), ("nan", "not_a_number"), ("1_000", "not_a_number"), ("-$(500)", "not_a_number"), ("()", "empty_number")])
def test_what_isnt_a_value(spark, raw, error):
    got = value(spark, raw)
    assert (got.error, got.value, got.unit) == (error, None, None)


def test_double_negatives(spark):
    """Brackets around a minus: the minus stays with the number."""
    got = value(spark, "(-500)")
    assert (got.value, got.is_negative) == (500.0, True)
    assert value(spark, "--5").value == 5.0


def test_defaults(spark):
    got = value(spark, "5 million", default_currency="EUR", base_unit="USD per share")
    assert (got.unit, got.currency) == ("million USD per share", "EUR")


@pytest.mark.parametrize(("raw", "code"), [("usd", "USD"), ("yen", "YEN"), ("€", "EUR"), ("US Dollars", "USD"), ("rupees", "INR"), ("HK$", "HKD"), ("florins", None), (None, None)])
def test_currency_codes(spark, raw, code):
    assert one(spark, n.currency_code(F.lit(raw).cast("string"))) == code


@pytest.mark.parametrize(("raw", "name"), [("Millions", "million"), ("bn", "billion"), ("K", "thousand"), ("USD millions", "usd millions"), (None, None)])
def test_unit_names(spark, raw, name):
    assert one(spark, n.unit_name(F.lit(raw).cast("string"))) == name


def test_finite_values(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert [r.x for r in df.select(n.is_valid_value(F.col("v")).alias("x")).collect()] == [True, False, False, None]


def test_parts_of_values(spark):
    assert one(spark, n.currency_sign(F.lit("CA$5"))) == "CAD" and one(spark, n.is_negative(F.lit("(5)"))) and one(spark, n.scale(F.lit("5 bn"))) == 1e9


def test_occurrences_overlap_and_keep_case(spark):
    df = spark.createDataFrame([(1, "Aaab aa"), (2, None), (3, ""), (4, "b")], "id int, t string")
    got = {r.id: [(o.position, o.context) for o in r.x] for r in df.select("id", x.occurrences(F.col("t"), "aa", 2).alias("x")).collect()}
    assert got == {1: [(0, "Aaa"), (1, "Aaab"), (5, " aa")], 2: [], 3: [], 4: []}
    assert one(spark, F.size(x.occurrences(F.lit("Aaab aa"), "Aa", case_sensitive=True))) == 1
    assert one(spark, F.size(x.occurrences(F.lit("a.b a.b axb"), "a.b"))) == 2 and one(spark, F.size(x.occurrences(F.lit("abc"), ""))) == 0


def test_occurrences_in_a_long_text(spark):
    assert one(spark, F.size(x.occurrences(F.lit("word net income " * 20000), "net income"))) == 20000


def test_snippets_tokens_and_json(spark):
    assert one(spark, x.snippet(F.lit("x" * 200 + " NEEDLE " + "y" * 200), F.lit("needle"), 5)) == "xxxx NEEDLE yyyy"
    assert one(spark, x.snippet(F.lit("abc"), F.lit("z"))) is None
    assert [one(spark, x.token_estimate(F.lit(s))) for s in ("", "abcdefgh", "é" * 9)] == [1, 2, 2]
    assert one(spark, x.clean_json(F.lit(' ```json\n{"a": 1}\n``` '))) == '{"a": 1}'
    for text, ok in (('{"a": 1}', True), ("[1]", False), ("1", False), ("nothing", False), ("", False)):
        assert one(spark, x.json_object(F.lit(text)).isNotNull()) is ok


def test_tables(spark):
    rows = F.array(F.array(F.lit("Item"), F.lit("2023")), F.array(F.lit("Revenue"), F.lit(None).cast("string")), F.lit(None).cast("array<string>"))
    assert one(spark, t.table_text(rows)) == "| Item | 2023 |\n| Revenue |  |\n|  |"
    assert one(spark, t.table_text(F.lit(None).cast("array<array<string>>"))) == ""
    assert one(spark, t.cell_text(rows)) == "Item 2023 Revenue "


@pytest.mark.parametrize(("cells", "header"), [(["Item", "FY2023", "FY2022"], True), (["Revenue", "5,000", "(4,000)"], False), (["", " ", None], False), (["2023", "2022"], False), (["a", "1"], False), ([], False)])
def test_header_rows(spark, cells, header):
    row = F.array(*[F.lit(c).cast("string") for c in cells]) if cells else F.array().cast("array<string>")
    assert one(spark, t.looks_like_header(row)) is header


@pytest.mark.parametrize(("cell", "numeric"), [("$5,000", True), ("(4,000)", True), ("12%", True), ("-3", True), ("x3", False), ("", False), ("n/a", False), (None, False)])
def test_numeric_cells(spark, cell, numeric):
    assert one(spark, t.is_numeric_cell(F.lit(cell).cast("string"))) is numeric


def test_boxes_are_turned(spark):
    box = F.array(*[F.lit(float(v)) for v in (10, 700, 100, 650)])
    assert one(spark, t.top_left(box, F.lit(792.0))) == [10.0, 92.0, 100.0, 142.0]
    assert one(spark, t.top_left(box, F.lit(None).cast("double"))) == [10.0, 700.0, 100.0, 650.0]
    assert one(spark, t.top_left(F.lit(None).cast("array<double>"), F.lit(792.0))) is None
