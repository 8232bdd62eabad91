"""Batch jobs (spark-submit / ``python -m tillroll.jobs``).

    python -m tillroll.jobs monthly-sheet  --input sheet.csv  --output out/processed_sales
    python -m tillroll.jobs service-mart   --input sales.csv  --output out/service_mart
    python -m tillroll.jobs monthly-mart   --input sales.csv  --output out/monthly_mart

``service-mart`` materialises only when the output is absent (or left
incomplete by a failed run) and reports 'exists' / 'processed'. Both report
how many rows were read and how many of them had no readable date. Inputs are
read by extension (CSV by header name); outputs are Parquet partitioned by
year. The session comes from the cluster (``getOrCreate``).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from .functions.clean import normalize_sales, with_calendar_parts
from .functions.dates import parse_dates_by_source
from .operators.sales import as_double, monthly_outlet
from .operators.services import service_mart
from .schemas import RAW_SALES_TEXT
from .session import ensure_checkpoint_dir
from .sources.files import ensure_mart, preprocess_monthly_sheet, read_table, with_file, write_table

def _sales(spark: SparkSession, path: str, seen: Observation):
    """Normalised lines of the input, dates read in each file's own order.
    ``seen`` counts the rows, and those that go for want of a date, in the same pass."""
    raw = with_file(read_table(spark, path, RAW_SALES_TEXT)).withColumnRenamed("Sale Date", "sale_date")
    dated = parse_dates_by_source(raw, ["sale_date"], "source_file").observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("sale_date").isNull()).alias("invalid_dates"))
    return with_calendar_parts(normalize_sales(dated.drop("source_file")))


def run(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="tillroll.jobs")
    parser.add_argument("job", choices=["monthly-sheet", "service-mart", "monthly-mart"])
    parser.add_argument("--input", required=True)
    parser.add_argument("--output", required=True)
    parser.add_argument("--measure", default="inc_tax", choices=["inc_tax", "exc_tax"])
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"tillroll-{args.job}").getOrCreate()
    ensure_checkpoint_dir(spark)
    if args.job == "monthly-sheet":
        sheet = read_table(spark, args.input, text=True)  # every column of the sheet stays
        write_table(preprocess_monthly_sheet(sheet), args.output, partition_by=["Year"])
        result = {"status": "processed", "file": args.output}
    else:
        seen = Observation("sale lines")
        if args.job == "service-mart":
            result = ensure_mart(spark, args.output,
                                 lambda: as_double(service_mart(_sales(spark, args.input, seen), args.measure)),
                                 partition_by=["year"])
        else:
            mart = as_double(monthly_outlet(_sales(spark, args.input, seen), args.measure))
            write_table(mart, args.output, partition_by=["year"])
            result = {"status": "processed", "file": args.output}
        if result["status"] == "processed":
            result |= seen.get
    print(json.dumps(result))
    return result


if __name__ == "__main__":
    run()
