import re
"""Plan checks: what runs must be the plan we designed."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_no_python_udf_in_any_plan(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert node not in text, f"{name} runs a Python UDF"


@pytest.mark.parametrize("name", [n for n in sorted(E.queries())
                                  if n.startswith(("q_festival", "q_holiday", "q_center_business"))])
def test_festival_queries_use_equi_joins(spark, name):
    text = plan_text(E.queries()[name](spark, SF))
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text, name


def test_filters_reach_the_scan(spark):
    from tillroll.sources.testbed import sales_lines
    df = sales_lines(spark, SF, items=False).where("center_name = 'NATION_7'")
    text = plan_text(df)
    assert "PushedFilters: [IsNotNull(n_name), EqualTo(n_name,NATION_7)" in text or \
        "EqualTo(n_name,NATION_7)" in text


def test_scan_prunes_columns(spark):
    df = E.queries()["q_monthly_outlet"](spark, SF)
    text = plan_text(df)
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double,l_tax:double>" in text


@pytest.mark.parametrize("name", ["q_monthly_outlet", "q_service_mart", "q_festival_performance_by_center",
                                  "q_festival_traffic", "q_filter_values", "q_column_profile",
                                  "q_upsert_latest", "q_holiday_sales"])
def test_aggregates_combine_before_shuffle(spark, name):
    """Hot keys: every hash exchange feeding an aggregate carries partial
    aggregates (map-side combine), never raw rows of one group."""
    df = E.queries()[name](spark, SF)
    lines = [ln.strip(" :+-") for ln in plan_text(df).splitlines()]
    agg = ("HashAggregate", "ObjectHashAggregate")
    feeding = [i for i, ln in enumerate(lines) if ln.startswith("Exchange hashpartitioning")
               and lines[i - 1].startswith(agg)]
    assert feeding, name
    for i in feeding:
        assert lines[i + 1].startswith(agg), (name, lines[i + 1])


def test_hot_outlet_and_day(spark):
    """A third of all lines on one outlet and one day: results stay whole
    and exact (checked against a plain per-row computation)."""
    import datetime as dt
    from decimal import Decimal

    from pyspark.sql import functions as F

    from tillroll.functions.clean import with_calendar_parts
    from tillroll.operators import holidays as H
    from tillroll.operators.sales import monthly_outlet
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(dt.date(2024, 1, 1)))
         .otherwise(F.date_add(F.lit(dt.date(2023, 12, 1)), (F.col("id") % 60).cast("int"))).alias("sale_date"),
        (F.col("id") % 5000).cast("string").alias("invoice_no"),
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 7).cast("string")).alias("center_name"),
        F.lit("BU").alias("business_unit"),
        F.lit(Decimal("1.000000")).cast("decimal(18,6)").alias("sales_inc_tax"))
    lines = with_calendar_parts(rows).repartition(8)
    mart = monthly_outlet(lines)
    hot = mart.where("outlet_name = 'HOT'").first()
    # ids 0, 3, ..., 29997 -> 10000 lines; 3k mod 5000 covers all 5000 invoices.
    assert (hot.mtd_sales, hot.mtd_bills) == (Decimal(n // 3), 5000)
    assert mart.agg(F.sum("mtd_sales")).first()[0] == Decimal(n)
    cal = spark.createDataFrame([("NY", 1, 1)], "festival string, hol_month int, hol_day int")
    perf = H.festival_performance(H.window_lines(lines, cal)).first()
    in_window = lines.where(F.col("sale_date").between(dt.date(2023, 12, 29), dt.date(2024, 1, 3))).count()
    assert perf.total_window_sales == float(in_window)


def test_year_filter_prunes_the_scan(spark):
    """A year choice becomes a date range that Parquet can use."""
    for name in ("q_kpis_filtered", "q_holiday_sales_selected", "q_mix_filtered"):
        text = plan_text(E.queries()[name](spark, SF))
        assert "GreaterThanOrEqual(o_orderdate," in text and "LessThan(o_orderdate," in text, name


@pytest.mark.parametrize("name", ["q_festival_performance", "q_festival_traffic", "q_holiday_sales"])
def test_holiday_days_filter_the_orders_below_the_line_join(spark, name):
    """Nothing is read while the frame is built, and only orders of window
    days reach the join with the lines."""
    df = E.queries()[name](spark, SF)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    for scan in re.split(r"Relation \[", tree)[1:]:
        assert not scan.startswith("checkpoint")
    assert "LogicalRDD" not in tree.replace("LogicalRDD [festival", "").replace("LogicalRDD [Months", "")
    orders = [x for x in tree.splitlines() if "o_orderdate" in x and "Filter" in x]
    assert orders and all("month(" in x and " IN" in x.upper() for x in orders)


@pytest.mark.parametrize("name", [n for n in sorted(E.queries())
                                  if n.startswith(("q_festival", "q_center_business"))])
def test_festival_queries_read_the_lines_once(spark, name):
    """One scan of the lines: windows without a sale on the day are known from
    the sums, not from a first pass. Sums that are stored on the way are made
    from one scan, and nothing is read after."""
    from tillroll.operators import holidays as H
    from tillroll.plans import catalog as C
    stored, cut = [], H.cut_lineage
    H.cut_lineage = C.cut_lineage = lambda df: stored.append(df) or cut(df)
    try:
        df = E.queries()[name](spark, SF)
    finally:
        H.cut_lineage = C.cut_lineage = cut
    df.collect()
    ran = [plan_text(x).split("== Initial Plan ==")[0] for x in [df, *stored]]
    assert sum(len(re.findall(r"FileScan parquet \[l_orderkey", x)) for x in ran) == 1, ran


def test_gap_filling_orders_no_series_in_one_task(spark):
    from tillroll.operators.holidays import fill_days
    daily = spark.sql("SELECT date'2024-01-01' AS sale_date, 1 AS n")
    text = plan_text(fill_days(daily, [], {"n": 0}))
    windows = re.findall(r"windowspecdefinition\((\w+)", text)
    assert windows and all(not w.startswith("sale_date") for w in windows), text
    assert "No Partition Defined" not in text
