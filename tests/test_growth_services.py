from decimal import Decimal

from tillroll.operators.growth import center_growth, outlet_growth, yearly_growth
from tillroll.operators.services import map_outlets


def mart(spark, rows):
    return spark.createDataFrame(
        rows, "year string, month string, outlet_name string, brand string, mtd_sales decimal(18,6)")


def test_growth_needs_two_years(spark):
    one = mart(spark, [("2024", "January", "A", "X", Decimal(10)), ("2024", "March", "A", "X", Decimal(5))])
    assert outlet_growth(one, "A").count() == 0
    assert yearly_growth(one, only="A").count() == 0
    lines = spark.createDataFrame([("A", "2024", Decimal(1))],
                                  "center_name string, year string, sales_inc_tax decimal(18,6)")
    assert center_growth(lines).count() == 0


def test_outlet_growth_columns_and_missing_months(spark):
    two = mart(spark, [("2023", "January", "A", "X", Decimal(100)), ("2024", "January", "A", "X", Decimal(150)),
                       ("2024", "March", "A", "X", Decimal(5)), ("2024", "January", "B", "X", Decimal(7))])
    out = {r.month: r for r in outlet_growth(two, "A").collect()}
    assert set(out) == {"January", "March"}
    jan, mar = out["January"], out["March"]
    assert (jan["2023"], jan["2024"], jan["growth_2023_to_2024"], jan["projected_10pct"]) == \
        ("₹100", "₹150", "50.00%", "₹165")
    assert (mar["2023"], mar["growth_2023_to_2024"]) == ("₹0", "nan%")


def test_yearly_growth_labels(spark):
    m = mart(spark, [("2022", "May", "A", "X", Decimal(0)), ("2023", "May", "A", "X", Decimal(50)),
                     ("2024", "May", "A", "X", Decimal(25))])
    got = sorted((r.year_comparison, r.growth) for r in yearly_growth(m, only="A").collect())
    assert got == [("2022 to 2023", "inf%"), ("2023 to 2024", "-50.00%")]


def test_map_outlets_dict_and_dataframe(spark):
    df = spark.createDataFrame([("T NAGAR",), ("OTHER",), (None,)], "center_name string")
    assert [r[0] for r in map_outlets(df).collect()] == ["T. NAGAR CENTER", "OTHER", None]
    table = spark.createDataFrame([("OTHER", "Mapped")], "outlet string, center string")
    got = sorted((r[0] or "") for r in map_outlets(df, table).collect())
    assert got == ["", "Mapped", "T NAGAR"]


def test_missing_outlet_gives_empty_views(spark, lines):
    from tillroll.operators import sales as S
    m = S.monthly_outlet(lines)
    assert outlet_growth(m, "NO_SUCH_OUTLET").count() == 0
    assert yearly_growth(m, only="NO_SUCH_OUTLET").count() == 0
    assert S.outlet_year_month(m, "NO_SUCH_OUTLET").count() == 0
