"""Distinct bills as state that adds up: bitmaps beside the monthly mart.

A bill that has lines in several mart rows (two months, two outlets) counts in
each, so the rows' counts do not add up to a number of distinct bills. Here a
row carries the bills themselves: every bill has a home, the smallest of its
rows' keys, and a number within its home, and a row has a bitmap over these
numbers for each home and bucket of 32,768 numbers. The numbers of a home are
dense, so a row has about a bit a bill. Bitmaps of chosen rows are joined by OR
and counted: exact, for any choice of rows, without the lines.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apply_filters, measure_col, not_null
from .sales import MART_KEYS, abv, keyed_lines


def bill_mart(lines: DataFrame, measure: str = "inc_tax", one_row_per_invoice: bool = False) -> DataFrame:
    """The monthly outlet mart with ``bills``: an array of (home, bucket, bits).

    Lines are summed by row and invoice first; the numbers come from a window
    over the invoices of one home (an outlet's bills of a month and brand).
    Lines without an invoice count in the sales and in no bill; an empty input
    gives an empty mart. ``one_row_per_invoice`` as in ``monthly_outlet``."""
    m = measure_col(measure)
    keyed, keys, labels = keyed_lines(lines)
    rows = keyed.select(*keys, "invoice_no", m).where(not_null(keys))
    if one_row_per_invoice:
        homed, home = rows.withColumn("_home", F.struct(*keys)), keys  # numbered and summed where the rows lie
    else:
        rows = rows.groupBy(*keys, "invoice_no").agg(F.sum(m).alias(m))
        homed = rows.withColumn("_home", F.min(F.struct(*keys)).over(Window.partitionBy("invoice_no")))
        home = ["_home"]
    number = F.dense_rank().over(Window.partitionBy(*home).orderBy("invoice_no")).cast("long")
    at = F.when(F.col("invoice_no").isNotNull(), F.bitmap_bit_position("_number"))
    parts = (homed.withColumn("_number", number)
             .groupBy(*keys, "_home", F.bitmap_bucket_number("_number").alias("_bucket"))
             .agg(F.sum(m).alias("_s"), F.count("invoice_no").alias("_n"),
                  F.bitmap_construct_agg(at).alias("_bits"), F.max(at).alias("_top")))
    # the numbers are dense, so a bitmap ends with its highest bit
    entry = F.when(F.col("_n") > 0, F.struct(
        F.col("_home").alias("home"), F.col("_bucket").alias("bucket"),
        F.expr("substring(_bits, 1, CAST(_top DIV 8 + 1 AS INT))").alias("bits")))
    mart = parts.groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0)).alias("mtd_sales"),
                                    F.sum("_n").alias("mtd_bills"), F.collect_list(entry).alias("bills"))
    return mart.select(*labels, "outlet_name", "brand", "mtd_sales", "mtd_bills",
                       abv("mtd_sales", "mtd_bills").alias("mtd_abv"), "bills")


def distinct_bills(mart: DataFrame, by: list[str] | None = None,
                   filters: Mapping[str, object] | None = None) -> DataFrame:
    """Distinct bills of the chosen rows of a :func:`bill_mart`, in all
    (``distinct_bills``, one row) or by mart columns. The bits of a bucket are
    joined in the tasks before they are dealt out."""
    by = list(by or [])
    entries = apply_filters(mart, filters).where(not_null(by)).select(*by, F.explode("bills").alias("_e"))
    joined = (entries.groupBy(*by, F.col("_e.home").alias("_home"), F.col("_e.bucket").alias("_bucket"))
              .agg(F.bitmap_count(F.bitmap_or_agg("_e.bits")).alias("_n")))
    return joined.groupBy(*by).agg(F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("distinct_bills"))
