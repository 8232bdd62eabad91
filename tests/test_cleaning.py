import datetime as dt
from decimal import Decimal

import pytest

from tillroll.functions import clean as C
from tillroll.schemas import RAW_SALES_TEXT, SALES_LINES


@pytest.mark.parametrize("text,expected", [
    ("₹1,234.50", Decimal("1234.500000")), ("$5", Decimal("5.000000")), ("abc", None),
    ("", None), (None, None), (" 12 ", Decimal("12.000000")),
])
def test_currency(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.clean_currency("t").alias("v")).first()["v"] == expected


def test_currency_to_double(spark):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("₹1,234.50",)], "t string")
    assert df.select(C.clean_currency("t", T.DoubleType()).alias("v")).first()["v"] == 1234.5


def test_dates_and_drop(spark):
    df = spark.createDataFrame([("2023-02-29",), ("2024-01-05",), ("05-01-2024",), ("junk",)], "t string")
    got = [r[0] for r in df.select(C.parse_date("t").alias("d")).dropna().collect()]
    assert got == [dt.date(2024, 1, 5), dt.date(2024, 1, 5)]


def test_year_month_brand(spark):
    df = spark.createDataFrame([("05-01-2024", "January", None), ("x-y-2023", "Foo", "nan"),
                                (None, None, "RETAIL")], "s string, m string, bu string")
    out = df.select(C.year_from_text("s").alias("y"), C.month_number("m").alias("n"),
                    C.brand("bu").alias("b"), C.brand(None).alias("absent")).collect()
    assert [tuple(r) for r in out] == [("2024", 1, "Other", "Unknown"), ("2023", 0, "Other", "Unknown"),
                                       (None, 0, "RETAIL", "Unknown")]


def test_calendar_parts(spark):
    df = spark.createDataFrame([(dt.date(2024, 3, 1),)], "sale_date date")
    r = C.with_calendar_parts(df).first()
    assert (r["year"], r["month"], r["month_num"]) == ("2024", "March", 3)


def test_normalize_sales_renames_cleans_and_drops(spark):
    raw = spark.createDataFrame(
        [("2024-01-05", "A1", "T NAGAR", "₹1,000.50", "Hair"),
         ("2023-02-29", "A2", "ADYAR", "$5", "Skin"),
         ("2024-01-06", "A3", "ADYAR", "oops", None)],
        "`Sale Date` string, `Invoice No` string, `Center Name` string, "
        "`Sales Collected (Inc.Tax)` string, `Business Unit` string")
    out = C.normalize_sales(raw)
    assert out.columns == [f.name for f in SALES_LINES.fields]
    got = [(r.sale_date, r.invoice_no, r.sales_inc_tax, r.redeemed) for r in out.orderBy("invoice_no").collect()]
    assert got == [(dt.date(2024, 1, 5), "A1", Decimal("1000.500000"), None),
                   (dt.date(2024, 1, 6), "A3", None, None)]
    assert set(RAW_SALES_TEXT.fieldNames()) >= {"Sale Date", "Invoice No"}


def test_database_columns_and_dropped_rows(spark):
    raw = spark.createDataFrame([("2024-01-05T00:00:00+00:00", "A1", "1234567890123.5", "105"), ("junk", "A2", "1", "1")],
                                "sale_date string, invoice_no string, sales_collected_exc_tax string, "
                                "sales_collected_inc_tax string")
    r = C.normalize_sales(raw).collect()
    assert [(x.sales_exc_tax, x.sales_inc_tax) for x in r] == [(Decimal("1234567890123.500000"), Decimal(105))]
    assert [tuple(x) for x in C.invalid_dates(raw).collect()] == [("junk", "A2", "1", "1")]
    with pytest.raises(ValueError):
        C.normalize_sales(raw.select("sale_date", "invoice_no"))


@pytest.mark.parametrize("text,expected", [
    ("2024-01-05T10:30:00", dt.date(2024, 1, 5)), ("2024-01-05 10:30:00", dt.date(2024, 1, 5)),
    ("01/05/2024", dt.date(2024, 1, 5)), ("5-1-2024", dt.date(2024, 1, 5)),
    ("2024-1-5", dt.date(2024, 1, 5)), ("2024/01/05", dt.date(2024, 1, 5)),
    ("2024-01-05T00:00:00+00:00", dt.date(2024, 1, 5)), ("2024-01-05T10:00:00Z", dt.date(2024, 1, 5)),
    ("2024-01-05 10:00:00.123", dt.date(2024, 1, 5)), ("2024-01-05 10:00", dt.date(2024, 1, 5)),
    ("05-01-2024 10:00:00", dt.date(2024, 1, 5)), ("05-Jan-2024", dt.date(2024, 1, 5)),
    ("Jan 5, 2024", dt.date(2024, 1, 5)), ("20240105", dt.date(2024, 1, 5)),
    ("January 5, 2024 9:05 pm", dt.date(2024, 1, 5)), ("5 January 2024", dt.date(2024, 1, 5)),
    ("31/12/2024", None), ("2024-13-01", None),
])
def test_date_layouts(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(C.parse_date("t").alias("d")).first()["d"] == expected
