"""Sales marts and roll-ups: monthly outlet mart, KPIs, mix, top-k, profile."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import brand_of, month_label, month_number
from ..functions.money import int_text, money_plain
from .common import ALL, apply_filters, dense_sum, measure_col, not_null, ordinal, sum_by

MART_KEYS = ["year", "month", "outlet_name", "brand"]


def as_double(df: DataFrame) -> DataFrame:
    """Cast every DECIMAL column to DOUBLE (done once, at the end)."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema.fields
             if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(casts) if casts else df


def abv(sales: Column | str, bills: Column | str) -> Column:
    """Average bill value: sales / bills, 0 when there are no bills."""
    s = F.col(sales) if isinstance(sales, str) else sales
    b = F.col(bills) if isinstance(bills, str) else bills
    return F.when(b > 0, s.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def keyed_lines(lines: DataFrame) -> tuple[DataFrame, list[str], list[Column]]:
    """The lines with the mart's grouping columns, their names, and the year
    and month labels made from them. Lines with a date are grouped on compact
    integer date parts, and the labels rendered on the aggregated rows."""
    dated = "sale_date" in lines.columns
    year, month = (F.year("sale_date"), F.month("sale_date")) if dated else (F.col("year"), F.col("month"))
    keyed = lines.withColumns({"_y": year, "_m": month, "outlet_name": F.col("center_name"), "brand": brand_of(lines)})
    labels = ([F.col("_y").cast("string").alias("year"), month_label(F.col("_m")).alias("month")] if dated
              else [F.col("_y").alias("year"), F.col("_m").alias("month")])
    return keyed, ["_y", "_m", "outlet_name", "brand"], labels


def monthly_outlet(lines: DataFrame, measure: str = "inc_tax",
                   one_row_per_invoice: bool = False) -> DataFrame:
    """Monthly outlet mart: sales, distinct bills and ABV by year, month,
    outlet and brand. One shuffle: Spark plans the distinct count as a
    partial aggregate on (keys, invoice) then a partial count per key, so a
    hot key never gathers its raw rows in one task. For lines already summed
    by invoice (``one_row_per_invoice``) the distinct count is a plain count."""
    m = measure_col(measure)
    bills = F.count("invoice_no") if one_row_per_invoice else F.countDistinct("invoice_no")
    keyed, keys, labels = keyed_lines(lines)
    mart = (keyed.select(*keys, "invoice_no", m).where(not_null(keys)).groupBy(*keys)
            .agg(F.coalesce(F.sum(m), F.lit(0)).alias("mtd_sales"),
                 bills.alias("mtd_bills")))
    return mart.select(*labels, "outlet_name", "brand", "mtd_sales", "mtd_bills",
                       abv("mtd_sales", "mtd_bills").alias("mtd_abv"))


def kpis(mart: DataFrame, filters: Mapping[str, object] | None = None,
         lines: DataFrame | None = None) -> DataFrame:
    """Headline figures over the (optionally filtered) monthly mart. An
    invoice that spans mart rows counts in each; a mart with the bills
    themselves (``bills.bill_mart``) gives ``distinct_bills`` too, which counts
    every invoice once. So do the sale ``lines``, to which the caller has
    applied the same choices."""
    f = apply_filters(mart, filters)
    out = f.agg(F.coalesce(F.sum("mtd_sales"), F.lit(0)).alias("total_sales"),
                F.coalesce(F.sum("mtd_bills"), F.lit(0)).cast("long").alias("total_bills"),
                F.countDistinct("outlet_name").alias("total_outlets"))
    if "bills" in mart.columns:
        from .bills import distinct_bills
        out = out.withColumn("distinct_bills", distinct_bills(f).scalar())
    elif lines is not None:
        out = out.withColumn("distinct_bills", lines.select(F.countDistinct("invoice_no")).scalar())
    return out.withColumns({
        "avg_bill_value": abv("total_sales", "total_bills"),
        "total_bills_text": int_text("total_bills"),
    })


def outlet_sales(mart: DataFrame, filters=None) -> DataFrame:
    """Sales per outlet, largest first."""
    out = sum_by(apply_filters(mart, filters), ["outlet_name"], "mtd_sales", "mtd_sales")
    return out.orderBy(F.desc_nulls_last("mtd_sales"), "outlet_name")


def _chosen(df: DataFrame, filters) -> Column | None:
    """The filters as one condition, for conditional sums."""
    out = None
    for column, value in (filters or {}).items():
        if value is None or value == ALL:
            continue
        values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        one = df[column].isin(values)
        out = one if out is None else out & one
    return out


def monthly_trend(mart: DataFrame, filters=None, dense: bool = False) -> DataFrame:
    """Month × year sales, in calendar month order; ``dense`` adds zeros for
    the pairs of the unfiltered mart without a row."""
    out = (dense_sum(mart, "month", "year", "mtd_sales", "mtd_sales", _chosen(mart, filters)) if dense
           else sum_by(apply_filters(mart, filters), ["month", "year"], "mtd_sales", "mtd_sales"))
    out = out.withColumn("month_num", month_number("month"))
    return out.orderBy("month_num", "year")


def outlet_year_month(mart: DataFrame, outlet: str) -> DataFrame:
    """One outlet's sales by year and month."""
    out = sum_by(mart.where(F.col("outlet_name") == F.lit(outlet)), ["year", "month"],
                 "mtd_sales", "mtd_sales")
    return out.withColumn("month_num", month_number("month")).orderBy("year", "month_num")


def daily_outlet(lines: DataFrame, measure: str = "inc_tax") -> DataFrame:
    """Monthly mart keyed additionally by day of month (``day_sales``)."""
    m = measure_col(measure)
    keyed = lines.select(F.year("sale_date").alias("_y"), F.month("sale_date").alias("_m"),
                         F.col("center_name").alias("outlet_name"), brand_of(lines).alias("brand"),
                         F.dayofmonth("sale_date").alias("_d"), m)
    keys = ["_y", "_m", "outlet_name", "brand", "_d"]
    daily = (keyed.where(not_null(keys)).groupBy(*keys)
             .agg(F.coalesce(F.sum(m), F.lit(0)).alias("mtd_sales")))
    # Labels rendered on the aggregated rows.
    return daily.select(F.col("_y").cast("string").alias("year"), month_label("_m").alias("month"),
                        "outlet_name", "brand", F.col("_d").cast("string").alias("day_sales"),
                        "mtd_sales")


def daily_average(daily: DataFrame, outlet: str) -> DataFrame:
    """Mean sales by year, month and day for one outlet, skipping empty /
    zero day values."""
    d = F.col("day_sales").cast("string")
    f = daily.where((F.col("outlet_name") == F.lit(outlet)) & d.isNotNull()
                    & (d != F.lit("")) & (d != F.lit("0")))
    return (f.where(not_null(["year", "month", "day_sales"]))
            .groupBy("year", "month", "day_sales")
            .agg((F.sum("mtd_sales").cast("double")
                  / F.count("mtd_sales").cast("double")).alias("mtd_sales")))


def mix(lines: DataFrame, dimension: str, measure: str = "inc_tax", filters=None,
        dense: bool = False) -> DataFrame:
    """Sales by one dimension (item type, category, business unit), largest
    first, with the display amount without currency sign; ``dense`` keeps
    values that the filters leave without a row, at zero."""
    if dense:
        m, chosen = F.col(measure_col(measure)), _chosen(lines, filters)
        out = (lines.where(not_null([dimension])).groupBy(dimension)
               .agg(F.coalesce(F.sum(m if chosen is None else F.when(chosen, m)), F.lit(0))
                    .cast("double").alias("sales")))
    else:
        out = sum_by(apply_filters(lines, filters), [dimension], measure, "sales")
    return (out.withColumn("formatted_sales", money_plain("sales"))
            .orderBy(F.desc_nulls_last("sales"), dimension))


def business_unit_rollup(lines: DataFrame, measure: str = "inc_tax", filters=None) -> DataFrame:
    """Sales per business unit plus the grand total row (``is_total``)."""
    m = measure_col(measure)
    f = apply_filters(lines, filters).where(F.col("business_unit").isNotNull())
    return (f.rollup("business_unit")
            .agg(F.coalesce(F.sum(m), F.lit(0)).cast("double").alias("sales"),
                 F.grouping("business_unit").cast("boolean").alias("is_total")))


def top_pairs(lines: DataFrame, keys: list[str], k: int, measure: str = "inc_tax",
              filters=None) -> DataFrame:
    """Top-k key combinations by sales (ties broken by the keys)."""
    out = sum_by(apply_filters(lines, filters), keys, measure, "sales")
    return out.orderBy(F.desc("sales"), *keys).limit(k)


def rows_per_year(lines: DataFrame) -> DataFrame:
    return (lines.groupBy(F.year("sale_date").cast("long").alias("year"))
            .agg(F.count(F.lit(1)).alias("rows")).orderBy("year"))


def date_range(lines: DataFrame) -> DataFrame:
    return lines.agg(F.min("sale_date").alias("first_date"),
                     F.max("sale_date").alias("last_date"),
                     F.count(F.lit(1)).alias("rows"),
                     F.countDistinct(F.year("sale_date")).alias("years"))


def filter_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Sorted distinct non-NULL values of several columns as one long table
    (dimension, value): one scan, rows unpivoted with ``stack`` and
    de-duplicated map-side before the shuffle."""
    present = [c for c in columns if c in df.columns]
    args = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in present)
    long = df.selectExpr(f"stack({len(present)}, {args}) AS (dimension, value)")
    return (long.where(F.col("value").isNotNull()).distinct()
            .orderBy("dimension", "value"))


def axis_order(df: DataFrame, key: str, measure: str, descending: bool = True) -> DataFrame:
    """Category-axis order: total per key and its 1-based position by total
    (descending by default), ties by key."""
    totals = sum_by(df, [key], measure, "total")
    order = [F.desc("total") if descending else F.asc("total"), F.asc(key)]
    return ordinal(totals, order, "axis_rank")


def column_profile(df: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """Distinct/rows ratio per column and the low-cardinality flag (< 0.5).

    Exact mode is one pass: rows are unpivoted to (column, value) and
    grouped with map-side combining, so the shuffle carries each
    partition's distinct values only (not one copy of every row per column,
    as several DISTINCT aggregates would); the row count is the sum of the
    group sizes. ``exact=False`` uses HyperLogLog sketches instead.
    """
    present = [c for c in columns if c in df.columns]
    if exact:
        args = ", ".join(f"'{c}', CAST(`{c}` AS STRING)" for c in present)
        long = df.selectExpr(f"stack({len(present)}, {args}) AS (column_name, value)")
        groups = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("_n"))
        prof = groups.groupBy("column_name").agg(F.sum("_n").cast("long").alias("rows"),
                                                 F.count("value").alias("distinct_values"))
    else:
        wide = df.agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.approx_count_distinct(c).alias(f"_d_{i}") for i, c in enumerate(present)])
        pairs = ", ".join(f"'{c}', `_d_{i}`" for i, c in enumerate(present))
        prof = wide.selectExpr("_rows AS rows",
                               f"stack({len(present)}, {pairs}) AS (column_name, distinct_values)")
    ratio = F.when(F.col("rows") > 0, F.col("distinct_values") / F.col("rows"))
    return prof.select("rows", "column_name", "distinct_values",
                       ratio.alias("distinct_ratio"),
                       F.coalesce(ratio < F.lit(0.5), F.lit(False)).alias("low_cardinality"))
