import pytest
from pyspark.sql import functions as F

from tillroll.functions import money as M
from tillroll.operators.sales import abv


def one(spark, col, value, dtype="double"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value,expected", [
    (0.0, "₹0"), (None, "₹0"), (123.0, "₹123"), (1234.0, "₹1,234"),
    (100000.0, "₹1,00,000"), (12345678.0, "₹1,23,45,678"), (2.5, "₹2"), (3.5, "₹4"),
    (-12345.0, "₹-12,345"), (999.6, "₹1,000"), (-100.0, "₹-100"),
    (float("nan"), "₹0"), (float("inf"), "₹inf"), (float("-inf"), "₹-inf"),
])
def test_money(spark, value, expected):
    assert one(spark, M.money, value) == expected


def test_money_from_decimal(spark):
    from decimal import Decimal
    assert one(spark, M.money, Decimal("1234567.500000"), "decimal(18,6)") == "₹12,34,568"


@pytest.mark.parametrize("value,expected", [(150000.0, "₹1.50 Lakhs"), (0.0, "₹0"),
                                            (None, "₹0"), (123456789.0, "₹1234.57 Lakhs")])
def test_lakhs(spark, value, expected):
    assert one(spark, lambda c: M.money(c, "lakhs"), value) == expected


@pytest.mark.parametrize("value,expected", [(0.125, "0.12%"), (1.005, "1.00%"), (2.675, "2.67%"),
                                            (None, "0%"), (float("nan"), "0%"), (12.3456, "12.35%"), (-3.0, "-3.00%")])
def test_percentage(spark, value, expected):
    assert one(spark, M.percentage, value) == expected


def test_percentage_without_sign(spark):
    assert one(spark, lambda c: M.percentage(c, include_sign=False), 12.3456) == "12.35"


def test_money_plain_and_int(spark):
    assert one(spark, M.money_plain, 1234567.0) == "12,34,567"
    assert one(spark, M.western_int, 1234567.9) == "1,234,567"
    assert one(spark, M.int_text, 41.9) == "41"


@pytest.mark.parametrize("sales,bills,expected", [(100.0, 0, 0.0), (100.0, 4, 25.0)])
def test_average_bill_value(spark, sales, bills, expected):
    df = spark.createDataFrame([(sales, bills)], "s double, b long")
    assert df.select(abv("s", "b").alias("v")).first()["v"] == expected


@pytest.mark.parametrize("prev,cur,pct,text,r2", [
    (100.0, 150.0, 50.0, "50.00%", "50.0%"),
    (None, 150.0, None, "nan%", "nan%"),
    (0.0, 150.0, None, "inf%", "inf%"),
    (0.0, 0.0, None, "nan%", "nan%"),
    (0.0, -5.0, None, "-inf%", "-inf%"),
    (300.0, 100.0, -66.66666666666667, "-66.67%", "-66.67%"),
])
def test_growth(spark, prev, cur, pct, text, r2):
    df = spark.createDataFrame([(prev, cur)], "p double, c double")
    out = df.select(M.growth_pct("c", "p").alias("pct"), M.growth_text("c", "p").alias("t"),
                    M.growth_round2_text("c", "p").alias("r2")).first()
    assert out["pct"] == pct and out["t"] == text and out["r2"] == r2


def test_format_column_custom_and_errors(spark):
    df = spark.createDataFrame([(1234.5,)], "x double")
    out = df.select(M.format_column("x", lambda c: F.concat(F.lit("Rs "), c.cast("string")))
                    .alias("y")).first()["y"]
    assert out == "Rs 1234.5"
    with pytest.raises(ValueError):
        M.format_column("x", "nope")
    with pytest.raises(TypeError):
        M.format_column("x", lambda c: "not a column")


def test_format_money_columns_skips_absent(spark):
    df = spark.createDataFrame([(1234.0, 5.0)], "a double, b double")
    out = M.format_money_columns(df, ["a", "missing"]).first()
    assert out["a"] == "₹1,234" and out["b"] == 5.0


def test_nan_and_very_large_values(spark):
    from tillroll.functions import money as M
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan), (2, inf), (3, 1e40), (4, -1234.9)], "i int, v double")
    out = df.select("i", M.western_int("v").alias("w"), M.int_text("v").alias("t"), M.money("v").alias("m")).orderBy("i").collect()
    assert [(r.w, r.t) for r in out] == [(None, None), (None, None), (None, None), ("-1,234", "-1234")]
    assert out[0].m == "₹0" and out[2].m.replace(",", "") == "₹1" + "0" * 40
    big = spark.createDataFrame([(12345678.9, 100.0), (12000000.0, 1.0)], "c double, p double")
    got = [r[0] for r in big.select(M.growth_round2_text("c", "p")).collect()]
    assert got == ["12345578.9%", "1199999900.0%"]
