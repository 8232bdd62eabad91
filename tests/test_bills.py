"""Distinct bills from bitmaps against counting the bills themselves."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import bills as B
from tillroll.operators import sales as S
from tillroll.operators.common import apply_filters

SF = "/root/testdata/sf0.001"
SCHEMA = "sale_date date, invoice_no string, center_name string, business_unit string, sales_inc_tax decimal(18,6)"


def random_lines(spark, n, n_bills, seed):
    rng = random.Random(seed)
    rows = [(dt.date(2023, 11, 1) + dt.timedelta(days=rng.randrange(90)),
             None if rng.random() < 0.1 else f"B{rng.randrange(n_bills)}",
             rng.choice(["X", "Y", "Z", None]), rng.choice(["p", "q", None, "nan"]), Decimal(rng.randrange(100)))
            for _ in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


FILTERS = [{}, {"year": "2023"}, {"outlet_name": "X"}, {"brand": ["p", "Other"], "month": "January"},
           {"year": "1999"}, {"outlet_name": ["X", "Y"], "year": ["2023", "2024"]}]


@pytest.mark.parametrize("n,n_bills", [(400, 30), (400, 5000)])
def test_any_filter_counts_every_bill_once(spark, n, n_bills):
    lines = random_lines(spark, n, n_bills, n_bills)
    mart = B.bill_mart(lines).cache()
    plain = S.monthly_outlet(lines)
    assert sorted(map(str, mart.drop("bills").collect())) == sorted(map(str, plain.collect()))
    keyed = lines.where("center_name IS NOT NULL").select(
        F.year("sale_date").cast("string").alias("year"), F.date_format("sale_date", "MMMM").alias("month"),
        F.col("center_name").alias("outlet_name"),
        F.coalesce(F.nullif(F.col("business_unit"), F.lit("nan")), F.lit("Other")).alias("brand"), "invoice_no")
    for f in FILTERS:
        want = apply_filters(keyed, f).agg(F.countDistinct("invoice_no")).first()[0]
        assert B.distinct_bills(mart, filters=f).first()[0] == want
        assert S.kpis(mart, f).first()["distinct_bills"] == want
    want = {r[0]: r[1] for r in keyed.groupBy("brand").agg(F.countDistinct("invoice_no")).collect()}
    assert {r["brand"]: r["distinct_bills"] for r in B.distinct_bills(mart, ["brand"]).collect()} == want
    mart.unpersist()


def test_many_buckets_of_one_home(spark):
    """More bills in one row than a bucket has numbers, some shared with another row."""
    lines = spark.range(100_000).select(
        F.lit(dt.date(2024, 1, 1)).alias("sale_date"), F.col("id").alias("invoice_no"), F.lit("X").alias("center_name"),
        F.lit("p").alias("business_unit"), F.lit(Decimal(1)).cast("decimal(18,6)").alias("sales_inc_tax"))
    both = lines.unionByName(lines.where("invoice_no % 3 = 0").withColumn("center_name", F.lit("Y")))
    mart = B.bill_mart(both).cache()
    assert {r["outlet_name"]: r["mtd_bills"] for r in mart.collect()} == {"X": 100_000, "Y": 33_334}
    assert B.distinct_bills(mart).first()[0] == 100_000
    entries = mart.where("outlet_name = 'X'").selectExpr("explode(bills) e").select("e.*").collect()
    assert len(entries) == 4 and max(len(e["bits"]) for e in entries) == 4096
    assert min(len(e["bits"]) for e in entries) < 4096  # ends with its highest bit
    mart.unpersist()


def test_empty(spark):
    mart = B.bill_mart(random_lines(spark, 1, 1, 0).limit(0))
    assert mart.collect() == [] and B.distinct_bills(mart).first()[0] == 0
    assert S.kpis(mart).first()["distinct_bills"] == 0


def test_lines_without_an_invoice_have_sales_only(spark):
    lines = spark.createDataFrame([(dt.date(2024, 1, 1), None, "X", "p", Decimal(3))] * 3, SCHEMA)
    row = B.bill_mart(lines).first()
    assert (row["mtd_sales"], row["mtd_bills"], row["mtd_abv"]) == (Decimal(9), 0, 0.0)
    assert B.distinct_bills(B.bill_mart(lines)).first()[0] == 0


def test_the_mart_reads_the_lines_once(spark):
    from tillroll.sources.testbed import invoice_lines
    mart = B.bill_mart(invoice_lines(spark, SF), one_row_per_invoice=True)
    text = mart._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[l_orderkey", text)) == 1
