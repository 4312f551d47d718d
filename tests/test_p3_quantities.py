import __spark_entry__ as entry

RECORD = "metric_id bigint, document_id string, field_name string, pipeline string, value double, original_value string, unit string, currency string, source_text string"


def write(spark, folder, records):
    spark.createDataFrame(records, RECORD).write.parquet(f"{folder}/metric_records.parquet")
    spark.createDataFrame([("d1", 2022), ("d2", 2023)], "document_id string, fiscal_year int").write.parquet(f"{folder}/filings.parquet")
    spark.createDataFrame([("EUR", 2022, 1.1)], "currency string, fiscal_year int, usd_per_unit double").write.parquet(f"{folder}/fx_rates.parquet")


def test_pairs_and_routes_are_registered(spark, tmp_path):
    write(spark, tmp_path, [
        (1, "d1", "revenue", "hybrid", 5.0, "€5.0 m", None, None, None),
        (2, "d1", "revenue", "text_only", None, "5,500", "thousands", "USD", None),
        (3, "d1", "revenue", "text_only", None, "6.2", "USD millions", None, None),
        (3, "d1", "revenue", "text_only", None, "6.2", "USD millions", None, None),
        (4, "d2", "revenue", "text_only", 7.0, None, None, "EUR", None),
        (5, "d2", "revenue", "text_only", None, None, None, "USD", None),
    ])
    q = entry.queries()
    assert {tuple(r) for r in q["p3_found"](spark, str(tmp_path)).collect()} == {(1, 3), (2, 3)}
    routes = {r.metric_id: (r.route, r.usd and round(r.usd)) for r in q["p3_quantities"](spark, str(tmp_path)).collect()}
    assert routes == {1: ("converted", 5500000), 2: ("converted", 5500000), 3: ("converted", 6200000), 4: ("no_rate", None)}


def test_a_currency_that_only_one_label_teaches(spark, tmp_path):
    """The forest needs two classes; where all labelled records are in one currency it has none to tell apart."""
    records = [(i, f"x{i}", "revenue", "hybrid", 5.0, "5.0", "USD millions", None, None) for i in range(40)]
    write(spark, tmp_path, [*records, (100, "d1", "revenue", "hybrid", 5.0, "5.0", "millions", None, None)])
    out = {r.metric_id: r.route for r in entry.queries()["p3_quantities"](spark, str(tmp_path)).collect()}
    assert len(out) == 41 and out[1] == "converted" and out[100] in ("converted", "review")


def test_scales_of_captions(spark):
    from pyspark.sql import functions as F

    from docmetrics.operators.units import currency_of, printed_number, scale_of

    texts = {"(USD 000s omitted)": 1e3, "in $'000": 1e3, "TEUR": 1e3, "USDm": 1e6, "5bn": 1e9, "crore": 1e7, "in lakhs": 1e5, "100 million": 1e8, "2,000": None, "EUR": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.s for r in df.select(scale_of(F.col("t")).alias("s")).collect()] == list(texts.values())
    numbers = {"1.234,56": 1234.56, "1,234.5": 1234.5, "48'405'350": 48405350.0, "(332,01)": -332.01, "74'365'080-": -74365080.0, "17 393,79": 17393.79, "-$2,014,566": -2014566.0, "n/a": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in numbers], "t string")
    assert [r.x for r in df.select(printed_number(F.col("t")).alias("x")).collect()] == list(numbers.values())
    money = {"CA$5": "CAD", "US$ 5": "USD", "$5": "USD", "€": "EUR", "reported in euros": "EUR", "5": None}
    df = spark.createDataFrame([(t,) for t in money], "t string")
    assert [r.x for r in df.select(currency_of(F.col("t")).alias("x")).collect()] == list(money.values())


def test_nulls_empty_tables_and_clashing_columns(spark):
    from docmetrics.operators import units

    record = RECORD + ", usd double, amount double, scale string, _missing int"
    filings = spark.createDataFrame([("d1", 2022, "x"), (None, 2022, "x")], "document_id string, fiscal_year int, rate string")
    rates = spark.createDataFrame([("EUR", 2022, 1.1), (None, 2022, 1.0)], "currency string, fiscal_year int, usd_per_unit double")
    rows = [(1, None, "revenue", None, 1.0, "5", "USD", None, None), (2, "d1", None, None, 1.0, "5", "USD", None, None), (None, "d1", "revenue", None, 1.0, "5", "USD", None, None), (3, "d1", "revenue", "hybrid", float("nan"), None, "USD", None, None), (4, "d1", "revenue", None, None, None, None, None, None), (5, "d1", "revenue", "hybrid", 5.0, "", "USD", None, None), (6, "d1", "revenue", "hybrid", 9.0, "9", "USD", None, None), (7, "d1", "revenue", "hybrid", 9.0, "8", "EUR", None, "x" * 100000)]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in rows], record)
    q = units.quantities(df, filings, rates)
    assert {r.metric_id for r in q.collect()} == {1, 2, None, 6, 7}
    assert (6, 7) in {tuple(r) for r in units.disagreements(q.where("metric_id IS NOT NULL")).collect()}
    empty = units.quantities(df.where("false"), filings.where("false"), rates.where("false"))
    assert empty.collect() == [] and units.disagreements(empty).collect() == []


def test_hidden_units_are_predicted(spark):
    """Masked hold-out: scales and currencies that a fifth of the documents state, predicted by forests that never saw those documents."""
    import random

    from pyspark.sql import functions as F

    from docmetrics.operators import unit_model as m, units

    rng = random.Random(1)
    rows, i = [], 0
    for doc in range(240):
        size, money = 10 ** rng.uniform(7, 10), rng.choice(["USD", "EUR", "GBP"])
        for field in ("revenue", "net_income", "total_assets", "operating_income"):
            for scale, word in ((1e6, "millions"), (1e3, "thousands"), (1.0, "")):
                i += 1
                rows.append((i, f"d{doc}", field, "hybrid", None, f"{size * rng.uniform(0.5, 2) / scale:.2f}", f"{money} {word}", None, None))
    base = units.stated(spark.createDataFrame(rows, RECORD)).where("number IS NOT NULL")
    x = m.features(base).withColumn("held", F.pmod(F.xxhash64("document_id", F.lit(5)), F.lit(5)) == 0).persist()
    for target, classes in (("scale", m.SCALES), ("currency", m.CURRENCIES)):
        out = m.train(x.where("NOT held"), target, classes).predict(x.where("held"))
        sure = out.where(F.col("chance") >= m.CONFIDENT)
        right = sure.where(F.col("predicted") == F.col(target)).count()
        assert right >= 0.9 * sure.count() > 0.4 * out.count()
    x.unpersist()
