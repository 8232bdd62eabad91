import os
import tempfile

from pyspark.sql import functions as F

from tillroll.functions.clean import with_calendar_parts
from tillroll.jobs import run
from tillroll.operators.sales import as_double, monthly_outlet
from tillroll.plans.catalog import _raw_text_lines
from tillroll.sources.testbed import sales_lines

SF = "/root/testdata/sf0.001"


def test_batch_jobs(spark):
    base = tempfile.mkdtemp(prefix="tillroll-jobs-")
    lines = sales_lines(spark, SF, items=True, calendar_parts=False)
    raw = _raw_text_lines(lines).join(
        lines.select(F.col("invoice_no").cast("string").alias("Invoice No"),
                     F.col("item_name").alias("Item Name"), F.col("item_type").alias("Item Type"),
                     F.col("item_category").alias("Item Category"),
                     F.col("item_subcategory").alias("Item Subcategory")).dropDuplicates(["Invoice No"]),
        "Invoice No")
    src = os.path.join(base, "sales.csv")
    raw.write.option("header", True).csv(src)

    out = os.path.join(base, "monthly")
    assert run(["monthly-mart", "--input", src, "--output", out], spark)["status"] == "processed"
    got = spark.read.parquet(out).withColumn("year", F.col("year").cast("string"))
    want = as_double(monthly_outlet(with_calendar_parts(lines)))
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count()

    mart = os.path.join(base, "service")
    assert run(["service-mart", "--input", src, "--output", mart], spark)["status"] == "processed"
    assert run(["service-mart", "--input", src, "--output", mart], spark)["status"] == "exists"
    assert spark.read.parquet(mart).count() > 0

    sheet = as_double(monthly_outlet(with_calendar_parts(lines))).select(
        F.col("year").alias("Year"), F.col("month").alias("Month"),
        F.col("outlet_name").alias("SALES OUTLET"), F.col("brand").alias("BRAND"),
        F.concat(F.lit("₹"), F.col("mtd_sales").cast("string")).alias("MTD SALES"),
        F.col("mtd_bills").cast("string").alias("MTD BILLS"),
        F.col("mtd_abv").cast("string").alias("MTD ABV"))
    sheet_path = os.path.join(base, "sheet.csv")
    sheet.write.option("header", True).csv(sheet_path)
    processed = os.path.join(base, "processed")
    run(["monthly-sheet", "--input", sheet_path, "--output", processed], spark)
    back = spark.read.parquet(processed)
    assert back.count() == sheet.count()
    assert back.where(F.col("Month_Num").between(1, 12)).count() == back.count()
