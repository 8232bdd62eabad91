"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the whole test tables through ``sources.testbed`` and
composes library operators; nothing is collected except bounded lists
(pivot headers, per-partition counts)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sales as S
from ..functions.classify import category, service_type
from ..functions.clean import (
    brand, clean_currency, month_number, normalize_sales, parse_date, with_calendar_parts,
    year_from_text)
from ..functions.money import (
    format_column, format_money_columns, money, money_plain, percentage, western_int)
from ..operators.bills import bill_mart, distinct_bills
from ..operators.common import apply_filters, dense_sum, sum_by
from ..operators.growth import (
    center_growth, center_projection, outlet_growth, outlet_pivot_table, yearly_growth)
from ..operators.holidays import (
    basic_calendar, breakdown, calendar_source_rows, calendar_summary, center_business_top, daily_traffic,
    default_calendar, festival_daily, festival_lines, festival_performance, holiday_dates, holiday_sales,
    read_calendar,
    select_holiday_rows, service_summary, top_item_counts, top_items)
from ..operators.delta import mart_of, merge_changes, read_state
from ..operators.intervals import long_window_lines
from ..operators.lattice import Lattice, build_lattice
from ..operators.profile import profile_of, read_states, refresh_states
from ..operators.rules import classify_by_rules
from ..operators.services import hierarchy, hierarchy_rollup, map_outlets, service_mart
from ..operators.topk import top_counts, top_sums
from ..schemas import HOLIDAY_CALENDAR, RAW_SALES_TEXT, SERVICE_MART
from ..session import cut_lineage, scratch_path
from ..sources.files import (
    ensure_mart, load_mart, preprocess_monthly_sheet, read_table, upsert, with_file, write_table)
from ..sources.testbed import classified_lines, invoice_lines, sales_lines, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _mart(spark, sf_dir, measure="inc_tax"):
    return S.monthly_outlet(invoice_lines(spark, sf_dir), measure, one_row_per_invoice=True)


@query
def q_monthly_outlet(spark, sf_dir):
    return S.as_double(_mart(spark, sf_dir, "inc_tax"))


@query
def q_monthly_outlet_exc(spark, sf_dir):
    return S.as_double(_mart(spark, sf_dir, "exc_tax"))


# ---- headline figures, outlet and trend views over the monthly mart --------

OUTLET = "NATION_7"


@query
def q_kpis(spark, sf_dir):
    """From the mart with the bills themselves, stored once: the lines are read once."""
    return S.as_double(S.kpis(cut_lineage(bill_mart(invoice_lines(spark, sf_dir), one_row_per_invoice=True))))


KPI_FILTERS = {"year": "1996", "brand": "BUILDING", "month": "All"}


@query
def q_kpis_filtered(spark, sf_dir):
    # The year choice is also applied to the lines, where it becomes a
    # prunable date range on the scan; the mart-level filter stays exact.
    lines = apply_filters(invoice_lines(spark, sf_dir), {"year": KPI_FILTERS["year"]})
    return S.as_double(S.kpis(S.monthly_outlet(lines, one_row_per_invoice=True), KPI_FILTERS))


def _shared_bills(spark, sf_dir):
    """Lines whose bills have lines in several months, outlets and brands:
    eight neighbouring invoices are one bill."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    return lines.withColumn("invoice_no", F.expr("invoice_no DIV 8"))


@query
def q_distinct_bills(spark, sf_dir):
    """Distinct bills by year, outlet and brand and in all, from one stored
    mart: bills that count in many of its rows count once in each result."""
    mart = cut_lineage(bill_mart(_shared_bills(spark, sf_dir)))
    out = distinct_bills(mart).select(F.lit("all").alias("dimension"), F.lit("all").alias("value"), "distinct_bills")
    for by in ("year", "outlet_name", "brand"):
        out = out.unionByName(distinct_bills(mart, [by]).select(F.lit(by).alias("dimension"), F.col(by).alias("value"),
                                                                "distinct_bills"))
    return out


@query
def q_kpis_shared_bills(spark, sf_dir):
    """Filtered headline figures where bills span mart rows."""
    return S.as_double(S.kpis(cut_lineage(bill_mart(_shared_bills(spark, sf_dir))),
                              {"year": ["1996", "1997"], "brand": "BUILDING"}))


@query
def q_outlet_sales(spark, sf_dir):
    return S.outlet_sales(_mart(spark, sf_dir))


@query
def q_monthly_trend(spark, sf_dir):
    return S.monthly_trend(_mart(spark, sf_dir))


TREND_FILTERS = {"brand": "BUILDING", "outlet_name": OUTLET, "year": ["1994", "1996"]}


@query
def q_monthly_trend_dense(spark, sf_dir):
    return S.monthly_trend(_mart(spark, sf_dir), TREND_FILTERS, dense=True)


@query
def q_outlet_year_month(spark, sf_dir):
    return S.outlet_year_month(_mart(spark, sf_dir), OUTLET)


@query
def q_daily_avg(spark, sf_dir):
    daily = S.daily_outlet(sales_lines(spark, sf_dir, items=False))
    return S.daily_average(daily, OUTLET)


# ---- mix, top-k and profile over sale lines ---------------------------------

@query
def q_item_type(spark, sf_dir):
    return S.mix(sales_lines(spark, sf_dir, outlets=False), "item_type")


@query
def q_item_category(spark, sf_dir):
    return S.mix(sales_lines(spark, sf_dir, outlets=False), "item_category")


@query
def q_business_unit(spark, sf_dir):
    return S.mix(sales_lines(spark, sf_dir, items=False), "business_unit")


MIX_FILTERS = {"year": "1997", "center_name": "NATION_3", "item_type": "PROMO",
               "item_category": "All", "business_unit": "AUTOMOBILE",
               "item_subcategory": None}


@query
def q_mix_filtered(spark, sf_dir):
    return S.mix(sales_lines(spark, sf_dir), "item_category", filters=MIX_FILTERS)


@query
def q_mix_dense(spark, sf_dir):
    return S.mix(sales_lines(spark, sf_dir), "item_category", filters={
        "center_name": OUTLET, "item_type": "PROMO", "business_unit": "AUTOMOBILE"}, dense=True)


@query
def q_business_unit_rollup(spark, sf_dir):
    return S.business_unit_rollup(sales_lines(spark, sf_dir, items=False))


@query
def q_top_categories(spark, sf_dir):
    return S.top_pairs(sales_lines(spark, sf_dir), ["item_category", "business_unit"], 15)


@query
def q_top_items_pruned(spark, sf_dir):
    """The best items of all, by pruned sums. Items sell much alike here, so
    the bound fails and all are summed."""
    return top_sums(sales_lines(spark, sf_dir, outlets=False), ["item_name"], 15)


@query
def q_top_keys_skewed(spark, sf_dir):
    """Pruned top k over keys of very unlike weight, some of them null."""
    r = F.pmod(F.col("invoice_no") * 7919, F.lit(100_003))
    key = F.when(r != 17, F.floor(F.lit(1_000_000) / (r + 1)).cast("string"))
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False, outlets=False).withColumn("item_name", key)
    return top_sums(lines, ["item_name"], 15, "exc_tax")


@query
def q_top_counts_skewed(spark, sf_dir):
    """The same keys by number of lines, in the years chosen."""
    r = F.pmod(F.col("invoice_no") * 7919, F.lit(100_003))
    lines = sales_lines(spark, sf_dir, items=False, outlets=False).withColumn(
        "item_name", F.floor(F.lit(1_000_000) / (r + 1)).cast("string"))
    return top_counts(lines, ["item_name", "year"], 20, {"year": ["1996", "1997", "1998"]})


@query
def q_center_year(spark, sf_dir):
    return sum_by(sales_lines(spark, sf_dir, items=False), ["center_name", "year"],
                  "inc_tax", "sales")


@query
def q_center_year_dense(spark, sf_dir):
    lines = sales_lines(spark, sf_dir)
    chosen = (F.col("item_category") == "Brand#1") & (F.col("business_unit") == "AUTOMOBILE")
    return dense_sum(lines, "center_name", "year", "inc_tax", "sales", chosen)


def _lattice(spark, sf_dir) -> Lattice:
    """The stored sums of the tables as they are now. Every query stores its
    own; a dashboard keeps one and opens it with ``open_lattice``."""
    return build_lattice(sales_lines(spark, sf_dir), scratch_path(spark, "lattice"))


@query
def q_lattice_mix_filtered(spark, sf_dir):
    """q_mix_filtered from stored sums."""
    return S.mix(_lattice(spark, sf_dir).lines_for(["item_category"], MIX_FILTERS), "item_category", filters=MIX_FILTERS)


@query
def q_lattice_top_categories(spark, sf_dir):
    """q_top_categories from stored sums."""
    keys = ["item_category", "business_unit"]
    return S.top_pairs(_lattice(spark, sf_dir).lines_for(keys), keys, 15)


@query
def q_lattice_center_year(spark, sf_dir):
    """q_center_year from stored sums."""
    return sum_by(_lattice(spark, sf_dir).lines_for(["center_name", "year"]), ["center_name", "year"], "inc_tax", "sales")


@query
def q_lattice_hierarchy(spark, sf_dir):
    """The hierarchy from stored sums."""
    return hierarchy(_lattice(spark, sf_dir).lines_for(["business_unit", "item_category"]))


@query
def q_rows_per_year(spark, sf_dir):
    return S.rows_per_year(sales_lines(spark, sf_dir, items=False, calendar_parts=False,
                                       outlets=False))


@query
def q_date_range(spark, sf_dir):
    return S.date_range(sales_lines(spark, sf_dir, items=False, calendar_parts=False,
                                    outlets=False))


FILTER_COLUMNS = ["year", "month", "center_name", "item_type", "item_category",
                  "item_subcategory", "business_unit"]


@query
def q_filter_values(spark, sf_dir):
    return S.filter_values(sales_lines(spark, sf_dir), FILTER_COLUMNS)


@query
def q_axis_order(spark, sf_dir):
    return S.axis_order(sales_lines(spark, sf_dir, outlets=False), "item_category", "inc_tax")


PROFILE_COLUMNS = ["center_name", "item_name", "item_type", "item_category",
                   "item_subcategory", "business_unit", "year", "month"]


@query
def q_column_profile(spark, sf_dir):
    return S.column_profile(sales_lines(spark, sf_dir), PROFILE_COLUMNS)


@query
def q_profile_incremental(spark, sf_dir):
    """The profile from states by file: the lines come in two loads, and the
    second refresh reads the files of the second only."""
    lines = sales_lines(spark, sf_dir).select(*PROFILE_COLUMNS)
    base = scratch_path(spark, "profile")
    early = F.col("year") < "1998"
    for load in (lines.where(early), lines.where(~early)):
        load.write.mode("append").parquet(f"{base}/data")
        refresh_states(spark, f"{base}/data", f"{base}/states", PROFILE_COLUMNS)
    return profile_of(read_states(spark, f"{base}/states")).select(
        "column_name", "rows", "nulls", "min_value", "max_value", "low_cardinality")


# ---- display formatting ----------------------------------------------------

@query
def q_format_money(spark, sf_dir):
    out = S.outlet_sales(_mart(spark, sf_dir))
    return out.select("outlet_name", "mtd_sales",
                      money("mtd_sales").alias("sales_text"),
                      money_plain("mtd_sales").alias("sales_plain"),
                      money(F.col("mtd_sales") / F.lit(-1000.0)).alias("negative_text"))


@query
def q_format_lakhs(spark, sf_dir):
    out = S.outlet_sales(_mart(spark, sf_dir))
    return out.select("outlet_name", money("mtd_sales", "lakhs").alias("sales_lakhs"))


@query
def q_format_percentage(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False)
    agg = lines.groupBy("center_name", "year").agg(
        (F.sum("tax_collected").cast("double") / F.sum("sales_exc_tax").cast("double")
         * F.lit(100.0)).alias("tax_rate_pct"))
    return agg.withColumns({"tax_rate_text": percentage("tax_rate_pct"),
                            "tax_rate_plain": percentage("tax_rate_pct", include_sign=False)})


@query
def q_format_columns(spark, sf_dir):
    mart = S.as_double(_mart(spark, sf_dir))
    return format_money_columns(mart, ["mtd_sales", "mtd_abv", "no_such_column"])


@query
def q_format_int(spark, sf_dir):
    out = S.outlet_sales(_mart(spark, sf_dir))
    return out.select("outlet_name", western_int("mtd_sales").alias("sales_int"))


@query
def q_format_column(spark, sf_dir):
    out = S.outlet_sales(_mart(spark, sf_dir))
    custom = (lambda c: F.concat(F.lit("Rs. "), F.format_number(c, 2)))
    return out.select("outlet_name",
                      format_column("mtd_sales", "lakhs").alias("by_name"),
                      format_column("mtd_sales", custom).alias("by_function"))


# ---- cleaning: dirt is created deterministically from the base lines -------
# The invoice number modulo only chooses which kind of dirt a line's text
# gets ('bad', empty, '$', '₹' with a comma); every line stays in the query.

def _dirty_money(lines):
    exc = F.col("sales_exc_tax").cast("string")
    inv = F.col("invoice_no")
    return (F.when(inv % 7 == 0, F.lit("bad"))
            .when(inv % 5 == 0, F.lit(""))
            .when(inv % 3 == 0, F.concat(F.lit("$"), exc))
            .otherwise(F.concat(F.lit("₹"), F.substring(exc, 1, 2), F.lit(","),
                                F.expr("substring(CAST(sales_exc_tax AS STRING), 3)"))))


@query
def q_clean_currency(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False)
    cleaned = lines.select("year", clean_currency(_dirty_money(lines)).alias("amount"))
    return cleaned.groupBy("year").agg(
        F.coalesce(F.sum("amount"), F.lit(0)).cast("double").alias("sales"),
        F.count("amount").alias("parsed"),
        (F.count(F.lit(1)) - F.count("amount")).alias("unparsed"))


@query
def q_clean_dates(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False, outlets=False)
    inv = F.col("invoice_no")
    text = (F.when(inv % 11 == 0, F.lit("2023-02-29"))
            .when(inv % 4 == 0, F.date_format("sale_date", "dd-MM-yyyy"))
            .when(inv % 9 == 0, F.date_format("sale_date", "yyyy-MM-dd'T'10:00:00+00:00"))
            .when(inv % 7 == 0, F.date_format("sale_date", "yyyy-MM-dd 10:00:00.123"))
            .when(inv % 5 == 0, F.date_format("sale_date", "dd-MM-yyyy 10:00"))
            .when(inv % 3 == 0, F.date_format("sale_date", "dd-MMM-yyyy"))
            .when(inv % 13 == 0, F.date_format("sale_date", "MMM d, yyyy"))
            .when(inv % 17 == 0, F.date_format("sale_date", "yyyyMMdd"))
            .otherwise(F.col("sale_date").cast("string")))
    parsed = lines.select(parse_date(text).alias("sale_date")).dropna(subset=["sale_date"])
    return parsed.groupBy(F.year("sale_date").cast("long").alias("year")) \
        .agg(F.count(F.lit(1)).alias("rows"), F.min("sale_date").alias("first_date"))


@query
def q_clean_dates_by_file(spark, sf_dir):
    """Sheets whose dates have the day first or the month first, with slashes
    and with dots, and some with a two-digit year: each file is read in its own
    order, and no row is lost."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    kind = F.pmod(F.xxhash64("center_name"), F.lit(4))
    text = (F.when(kind == 0, F.date_format("sale_date", "dd/MM/yyyy")).when(kind == 1, F.date_format("sale_date", "M/d/yyyy"))
            .when(kind == 2, F.date_format("sale_date", "dd.MM.yy")).otherwise(F.date_format("sale_date", "MM-dd-yyyy 10:00")))
    raw = lines.select(text.alias("Sale Date"), F.col("invoice_no").cast("string").alias("Invoice No"),
                       F.col("center_name").alias("Center Name"),
                       F.col("sales_inc_tax").cast("string").alias("Sales Collected (Inc.Tax)"), kind.alias("sheet"))
    path = scratch_path(spark, "sheets")
    raw.write.partitionBy("sheet").option("header", True).csv(path)
    back = normalize_sales(with_file(read_table(spark, path, RAW_SALES_TEXT, fmt="csv")), "source_file")
    return back.groupBy("center_name", "sale_date").agg(F.count(F.lit(1)).alias("lines"),
                                                        F.sum("sales_inc_tax").cast("double").alias("sales"))


@query
def q_brand_default(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False)
    bu = F.col("business_unit")
    dirty = F.when(bu == "BUILDING", F.lit(None).cast("string")) \
        .when(bu == "MACHINERY", F.lit("nan")).otherwise(bu)
    out = lines.select(brand(dirty).alias("brand"), brand(None).alias("absent_brand"),
                       "sales_inc_tax")
    return out.groupBy("brand", "absent_brand").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("sales_inc_tax").cast("double").alias("sales"))


def _raw_text_lines(lines):
    """Sale lines as a raw source sheet: source headers, every value text."""
    return lines.select(
        F.col("sale_date").cast("string").alias("Sale Date"),
        F.col("invoice_no").cast("string").alias("Invoice No"),
        F.col("center_name").alias("Center Name"),
        F.col("business_unit").alias("Business Unit"),
        F.concat(F.lit("$"), F.col("sales_exc_tax").cast("string")).alias("Sales Collected (Exc.Tax)"),
        F.col("tax_collected").cast("string").alias("Tax Collected"),
        F.concat(F.lit("₹"), F.col("sales_inc_tax").cast("string")).alias("Sales Collected (Inc.Tax)"),
    )


@query
def q_normalize_sales(spark, sf_dir):
    raw = _raw_text_lines(sales_lines(spark, sf_dir, items=False, calendar_parts=False))
    return S.as_double(S.monthly_outlet(with_calendar_parts(normalize_sales(raw))))


@query
def q_normalize_db(spark, sf_dir):
    """Sale lines as a database table has them: its own measure names, time
    stamps with an offset, and amounts beyond 10^12."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    raw = lines.select(
        F.date_format("sale_date", "yyyy-MM-dd'T'00:00:00.000+05:30").alias("sale_date"), "invoice_no", "center_name",
        "business_unit", F.concat(F.lit("7,000,000,"), F.lpad(F.floor("sales_exc_tax").cast("string"), 9, "0"))
        .alias("sales_collected_exc_tax"), F.col("sales_inc_tax").cast("string").alias("sales_collected_inc_tax"))
    clean = normalize_sales(raw)
    return clean.groupBy(F.year("sale_date").cast("long").alias("year"), "center_name").agg(
        F.sum("sales_exc_tax").cast("double").alias("large"), F.sum("sales_inc_tax").cast("double").alias("sales"),
        F.count(F.lit(1)).alias("lines"))


@query
def q_month_num(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False, outlets=False)
    name = F.when(F.col("invoice_no") % 13 == 0, F.lit("Foo")).otherwise(F.col("month"))
    return lines.select(name.alias("month"), month_number(name).alias("month_num")) \
        .groupBy("month", "month_num").agg(F.count(F.lit(1)).alias("lines"))


@query
def q_year_from_text(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False, outlets=False)
    text = F.date_format("sale_date", "dd-MM-yyyy")
    return lines.groupBy(year_from_text(text).alias("year")) \
        .agg(F.count(F.lit(1)).alias("lines"))


# ---- services ---------------------------------------------------------------

# Test keyword lists (data): words that occur in the test part names/brands.
TEST_KEYWORDS = [
    ("Hair", ["#1"], ["ring"], ["red"]),
    ("Skin", ["#2"], ["bolt"], ["blue"]),
    ("SPA", ["#3"], ["gear"], ["hot"]),
]


@query
def q_service_type(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, outlets=False)
    out = lines.select(
        category("item_type", "PROMO").alias("category"),
        service_type(keywords=TEST_KEYWORDS, product_value="PROMO").alias("service_type"),
        service_type().alias("default_service_type"), "sales_inc_tax")
    return out.groupBy("category", "service_type", "default_service_type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("sales_inc_tax").cast("double").alias("sales"))


@query
def q_service_rules(spark, sf_dir):
    """A table of keyword rules, a rule a part: the first that stands in the
    item's name labels the line."""
    rules = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("priority"),
        F.expr("substring(p_name, CAST(1 + p_partkey % 10 AS INT), CAST(2 + p_partkey % 7 AS INT))").alias("keyword"),
        F.format_string("Group %02d", F.col("p_partkey") % 40).alias("label"))
    out = classify_by_rules(sales_lines(spark, sf_dir, outlets=False), "item_name", rules)
    return out.groupBy("service_type").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("item_name").alias("items"),
                                           F.sum("sales_inc_tax").cast("double").alias("sales"))


@query
def q_service_mart(spark, sf_dir):
    lines = classified_lines(spark, sf_dir, keywords=TEST_KEYWORDS, product_value="PROMO").withColumn(
        "sale_date_text", F.date_format("sale_date", "dd-MM-yyyy"))
    return S.as_double(service_mart(lines, date_text="sale_date_text"))


TEST_OUTLET_MAP = {"NATION_1": "CENTRE ONE", "NATION_2": "CENTRE TWO", "T NAGAR": "T. NAGAR CENTER"}


@query
def q_map_outlet(spark, sf_dir):
    mart = S.as_double(_mart(spark, sf_dir))
    return map_outlets(mart, TEST_OUTLET_MAP, "outlet_name")


@query
def q_hierarchy(spark, sf_dir):
    return hierarchy(sales_lines(spark, sf_dir))


@query
def q_hierarchy_rollup(spark, sf_dir):
    return hierarchy_rollup(sales_lines(spark, sf_dir))


# ---- holidays ---------------------------------------------------------------

FESTIVAL = "New Year"
HOLIDAY_YEARS = [1996, 1998, 2000]


def _calendar(spark):
    return default_calendar(spark)


def _window(spark, sf_dir, festivals=None, center=None, items=True, outlets=True):
    lines = sales_lines(spark, sf_dir, items=items, outlets=outlets)
    return festival_lines(lines, _calendar(spark), festivals=festivals, center=center)


@query
def q_calendar(spark, sf_dir):
    """The calendar as a source file: written as CSV, scanned back with the
    file loader (date coercion, bad dates dropped), then matched to sales."""
    path = write_table(calendar_source_rows(spark), scratch_path(spark, "calendar") + ".csv", "csv")
    return calendar_summary(sales_lines(spark, sf_dir, items=False, calendar_parts=False,
                                        outlets=False), read_calendar(spark, path))


@query
def q_holiday_dates(spark, sf_dir):
    return holiday_dates(sales_lines(spark, sf_dir, items=False, calendar_parts=False,
                                     outlets=False), _calendar(spark))


@query
def q_holiday_dates_basic(spark, sf_dir):
    return holiday_dates(sales_lines(spark, sf_dir, items=False, calendar_parts=False,
                                     outlets=False), basic_calendar(spark))


def _holiday_sales(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    return holiday_sales(lines, _calendar(spark))


@query
def q_holiday_sales(spark, sf_dir):
    return _holiday_sales(spark, sf_dir)


@query
def q_holiday_sales_total(spark, sf_dir):
    return select_holiday_rows(_holiday_sales(spark, sf_dir), None, "All Centers")


@query
def q_holiday_sales_selected(spark, sf_dir):
    # Holiday year = sale year here, so the choice also prunes the line scan.
    lines = apply_filters(sales_lines(spark, sf_dir, items=False, calendar_parts=False),
                          {"year": HOLIDAY_YEARS})
    return select_holiday_rows(holiday_sales(lines, _calendar(spark)), HOLIDAY_YEARS, OUTLET)


@query
def q_holiday_fallback(spark, sf_dir):
    """Sales on days of the month that no holiday has: the calendar's own rows
    are the answer."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    held = sorted({int(d[8:]) for _, d, _, _ in HOLIDAY_CALENDAR})
    return holiday_sales(lines.where(~F.dayofmonth("sale_date").isin(held)), _calendar(spark), fallback=True)


@query
def q_festival_daily(spark, sf_dir):
    return festival_daily(_window(spark, sf_dir, items=False, outlets=False))


@query
def q_festival_daily_label(spark, sf_dir):
    return festival_daily(_window(spark, sf_dir, [FESTIVAL], items=False, outlets=False), "exc_tax")


@query
def q_festival_daily_center(spark, sf_dir):
    return festival_daily(_window(spark, sf_dir, center=OUTLET, items=False))


@query
def q_festival_performance(spark, sf_dir):
    return festival_performance(_window(spark, sf_dir, items=False, outlets=False))


@query
def q_festival_performance_by_center(spark, sf_dir):
    return festival_performance(_window(spark, sf_dir, items=False), "exc_tax", by_center=True)


@query
def q_festival_category_year(spark, sf_dir):
    return breakdown(_window(spark, sf_dir, [FESTIVAL], outlets=False), ["item_category", "year"])


@query
def q_festival_category(spark, sf_dir):
    return breakdown(_window(spark, sf_dir, [FESTIVAL], outlets=False), ["item_category"])


@query
def q_festival_bu_year(spark, sf_dir):
    return breakdown(_window(spark, sf_dir, [FESTIVAL], items=False), ["business_unit", "year"])


@query
def q_center_business_top10(spark, sf_dir):
    return center_business_top(_window(spark, sf_dir, [FESTIVAL], items=False), 10)


@query
def q_festival_top_services(spark, sf_dir):
    return top_items(_window(spark, sf_dir, [FESTIVAL], outlets=False), 15)


@query
def q_festival_service_counts(spark, sf_dir):
    return top_item_counts(_window(spark, sf_dir, [FESTIVAL], outlets=False), 15)


@query
def q_festival_service_summary(spark, sf_dir):
    return service_summary(_window(spark, sf_dir, [FESTIVAL]), 20)


@query
def q_festival_traffic(spark, sf_dir):
    return daily_traffic(_window(spark, sf_dir, [FESTIVAL], items=False, outlets=False))


@query
def q_festival_traffic_series(spark, sf_dir):
    """Gap-filled daily traffic of every centre and item category."""
    return daily_traffic(_window(spark, sf_dir, [FESTIVAL]), series=("center_name", "item_category"))


@query
def q_festival_long_windows(spark, sf_dir):
    """Windows of 200 days by centre: sums by centre and day meet the windows
    as intervals, two rows a window whatever its length."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False)
    # stored, since the holidays with sales are found in the same sums
    by_day = cut_lineage(lines.groupBy("sale_date", "center_name").agg(F.sum("sales_inc_tax").alias("sales_inc_tax")))
    return festival_performance(long_window_lines(by_day, _calendar(spark), 100, 99), by_center=True)


# ---- growth -----------------------------------------------------------------

@query
def q_outlet_pivot(spark, sf_dir):
    return outlet_pivot_table(_mart(spark, sf_dir), OUTLET)


@query
def q_outlet_growth(spark, sf_dir):
    return outlet_growth(_mart(spark, sf_dir), OUTLET)


@query
def q_center_growth(spark, sf_dir):
    return center_growth(invoice_lines(spark, sf_dir))


@query
def q_center_projection(spark, sf_dir):
    return center_projection(invoice_lines(spark, sf_dir))


@query
def q_outlet_yearly_growth(spark, sf_dir):
    return yearly_growth(_mart(spark, sf_dir), only=OUTLET)


# ---- sources and sinks ------------------------------------------------------------

@query
def q_scan_csv(spark, sf_dir):
    raw = _raw_text_lines(sales_lines(spark, sf_dir, items=False, calendar_parts=False))
    path = write_table(raw, scratch_path(spark, "sales") + ".csv", "csv")
    back = read_table(spark, path, RAW_SALES_TEXT)
    return S.as_double(S.monthly_outlet(with_calendar_parts(normalize_sales(back))))


@query
def q_scan_csv_quoted(spark, sf_dir):
    """Item names with commas, doubled quotes and backslashes through a CSV."""
    lines = sales_lines(spark, sf_dir, calendar_parts=False, outlets=False)
    name = F.concat(F.lit('12" '), F.col("item_name"), F.lit(', "big" \\'))
    raw = lines.select(name.alias("Item Name"), F.col("sale_date").cast("string").alias("Sale Date"),
                       F.col("sales_inc_tax").cast("string").alias("Sales Collected (Inc.Tax)"))
    path = write_table(raw, scratch_path(spark, "quoted") + ".csv", "csv")
    back = normalize_sales(read_table(spark, path, RAW_SALES_TEXT))
    return sum_by(back, ["item_name"], "inc_tax", "sales")


@query
def q_preprocess_monthly(spark, sf_dir):
    mart = S.as_double(_mart(spark, sf_dir))
    sheet = mart.select(
        F.col("year").alias("Year"), F.col("month").alias("Month"),
        F.col("outlet_name").alias("OUTLET NAMES"), F.col("brand").alias("BRAND"),
        F.concat(F.lit("₹"), F.col("mtd_sales").cast("string")).alias("MTD SALES"),
        F.col("mtd_bills").cast("string").alias("MTD BILLS"),
        F.concat(F.lit("$"), F.col("mtd_abv").cast("string")).alias("MTD ABV"))
    path = write_table(preprocess_monthly_sheet(sheet), scratch_path(spark, "monthly") + ".csv", "csv")
    schema = T.StructType([T.StructField(n, t) for n, t in [
        ("Year", T.StringType()), ("Month", T.StringType()), ("OUTLET NAMES", T.StringType()),
        ("BRAND", T.StringType()), ("MTD SALES", T.DoubleType()), ("MTD BILLS", T.DoubleType()),
        ("MTD ABV", T.DoubleType()), ("Month_Num", T.IntegerType())]])
    back = read_table(spark, path, schema)
    return back.toDF("year", "month", "outlet_name", "brand", "mtd_sales", "mtd_bills",
                     "mtd_abv", "month_num")


@query
def q_mart_roundtrip(spark, sf_dir):
    lines = sales_lines(spark, sf_dir).withColumn(
        "sale_date_text", F.date_format("sale_date", "dd-MM-yyyy"))
    path = scratch_path(spark, "service-mart")

    def build():
        return S.as_double(service_mart(lines, keywords=TEST_KEYWORDS, product_value="PROMO",
                                        date_text="sale_date_text"))
    first = ensure_mart(spark, path, build, partition_by=["year"])
    second = ensure_mart(spark, path, build, partition_by=["year"])
    assert (first["status"], second["status"]) == ("processed", "exists")
    return load_mart(spark, path, SERVICE_MART)


@query
def q_upsert_latest(spark, sf_dir):
    lines = sales_lines(spark, sf_dir, items=False)
    current = S.as_double(S.monthly_outlet(lines, "exc_tax"))
    incoming = S.as_double(S.monthly_outlet(lines.where(F.col("year") == "2000"), "inc_tax"))
    return upsert(current, incoming, S.MART_KEYS)


@query
def q_upsert_partial(spark, sf_dir):
    """Incoming rows carry one stored column and a new one; the rest stays."""
    lines = sales_lines(spark, sf_dir, items=False)
    current = S.as_double(S.monthly_outlet(lines, "exc_tax"))
    incoming = S.as_double(S.monthly_outlet(lines.where(F.col("year") == "2000"), "inc_tax")) \
        .select(*S.MART_KEYS, "mtd_sales", F.lit("late").alias("note"))
    return upsert(current, incoming, S.MART_KEYS)


@query
def q_delta_mart(spark, sf_dir):
    """The mart after three batches of changes: a first load, invoices that
    come later with amounts before tax, and their correction together with
    invoices that are taken back."""
    lines = sales_lines(spark, sf_dir, items=False, calendar_parts=False).select(
        "sale_date", "invoice_no", "center_name", "business_unit", "sales_inc_tax", "sales_exc_tax")
    late, gone = F.col("invoice_no") % 3 == 0, F.col("invoice_no") % 11 == 0
    wrong = lines.where(late).withColumn("sales_inc_tax", F.col("sales_exc_tax"))
    new, back = F.lit(1).alias("sign"), F.lit(-1).alias("sign")
    path = scratch_path(spark, "state")
    merge_changes(spark, path, lines.where(~late).select("*", new), 1)
    merge_changes(spark, path, wrong.select("*", new), 2)
    third = (wrong.select("*", back).unionByName(lines.where(late & ~gone).select("*", new))
             .unionByName(lines.where(~late & gone).select("*", back)))
    merge_changes(spark, path, third, 3)
    merge_changes(spark, path, third, 3)  # once more, as after a failure
    return S.as_double(mart_of(read_state(spark, path)))


# ---- streaming --------------------------------------------------------------

@query
def q_stream_refresh(spark, sf_dir):
    """The monthly mart built incrementally: raw lines arrive as several CSV
    files in date order and are processed a few files per micro-batch; each
    batch recomputes only the months it touched (a month split across
    batches is recomputed from all its stored lines when the later arrives)."""
    from ..streaming.refresh import read_mart, start_mart_refresh
    raw = _raw_text_lines(sales_lines(spark, sf_dir, items=False, calendar_parts=False))
    base = scratch_path(spark, "stream")
    raw.repartitionByRange("Sale Date").write.option("header", True).csv(f"{base}/in")
    q = start_mart_refresh(spark, f"{base}/in", f"{base}/lines", f"{base}/mart",
                           f"{base}/checkpoint", raw_schema=raw.schema, max_files_per_trigger=3)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return read_mart(spark, f"{base}/mart")



SURVEY_IDS = {
    "q_monthly_outlet": "A1, P4, P5, P6, P20, P24",
    "q_monthly_outlet_exc": "A1 (exc-tax measure)",
    "q_kpis": "A3, X7",
    "q_kpis_filtered": "A3, F1",
    "q_distinct_bills": "A1, A3, D-15",
    "q_kpis_shared_bills": "A3, F1, D-15",
    "q_outlet_sales": "A4, T1",
    "q_monthly_trend": "A5, P10, T2",
    "q_monthly_trend_dense": "A5, D-2, J7",
    "q_mix_dense": "A9, D-2, J7",
    "q_normalize_db": "P8, P1, P2, S8",
    "q_scan_csv_quoted": "S1, S5",
    "q_upsert_partial": "S11",
    "q_outlet_year_month": "A6, F3, T2",
    "q_daily_avg": "A7, F4",
    "q_item_type": "A8, X5",
    "q_item_category": "A9, X5",
    "q_business_unit": "A10, X5",
    "q_mix_filtered": "F2, A9",
    "q_business_unit_rollup": "A11",
    "q_top_categories": "A13, T3",
    "q_top_items_pruned": "A23, T3",
    "q_top_keys_skewed": "A13, T3",
    "q_top_counts_skewed": "A23, T3, F5",
    "q_center_year": "A14",
    "q_center_year_dense": "J7, D-2",
    "q_lattice_mix_filtered": "F1, F2, A9",
    "q_lattice_top_categories": "A13, T3",
    "q_lattice_center_year": "A14",
    "q_lattice_hierarchy": "A12, F8",
    "q_rows_per_year": "S10, A24",
    "q_date_range": "A24",
    "q_filter_values": "A27",
    "q_axis_order": "A28",
    "q_column_profile": "P27",
    "q_profile_incremental": "P27, A24",
    "q_format_money": "X1, X5",
    "q_format_lakhs": "X2",
    "q_format_percentage": "X3",
    "q_format_columns": "X4",
    "q_format_int": "X6",
    "q_format_column": "V3, V4",
    "q_clean_currency": "P1, X12",
    "q_clean_dates": "P2, P3",
    "q_clean_dates_by_file": "P2, P3, S3",
    "q_brand_default": "P7",
    "q_normalize_sales": "P8",
    "q_month_num": "P9",
    "q_year_from_text": "P11, X11",
    "q_service_type": "P12, P13, X10, V2",
    "q_service_mart": "A26, U1, P11",
    "q_service_rules": "P13, V2",
    "q_festival_long_windows": "J3, D-5, A19",
    "q_delta_mart": "A1, S11",
    "q_map_outlet": "P25, J5",
    "q_hierarchy": "A12, F8",
    "q_hierarchy_rollup": "A12",
    "q_calendar": "S12",
    "q_holiday_dates": "J1, P15, P16",
    "q_holiday_dates_basic": "S13, J1",
    "q_holiday_sales": "A16, J2, F10, U4",
    "q_holiday_sales_total": "F7, A16",
    "q_holiday_sales_selected": "F5, F6, A16",
    "q_holiday_fallback": "D-16",
    "q_festival_daily": "A17, J3, F11, F12, P17, P19, U2",
    "q_festival_daily_label": "P18, A17",
    "q_festival_daily_center": "F6, A17",
    "q_festival_performance": "A18, P22, F9",
    "q_festival_performance_by_center": "A19",
    "q_festival_category_year": "A20",
    "q_festival_category": "A20",
    "q_festival_bu_year": "A21",
    "q_center_business_top10": "A22, J4, T4",
    "q_festival_top_services": "A23, T3",
    "q_festival_service_counts": "A23, T3",
    "q_festival_service_summary": "A23, P21, T3",
    "q_festival_traffic": "A25, P26, J6",
    "q_festival_traffic_series": "A25, P26",
    "q_outlet_pivot": "W1",
    "q_outlet_growth": "W2, X8, P23",
    "q_center_growth": "W3, X9",
    "q_center_projection": "W4, P23, J8",
    "q_outlet_yearly_growth": "W5, F13",
    "q_scan_csv": "S1, S3, S5",
    "q_preprocess_monthly": "S17",
    "q_mart_roundtrip": "S14, S15",
    "q_upsert_latest": "S11",
    "q_stream_refresh": "streaming refresh (replaces the reload-everything refresh)",
}

for _name, _fn in QUERIES.items():
    _ids = SURVEY_IDS.get(_name)
    if _ids:
        _fn.__doc__ = ((_fn.__doc__ or "").rstrip() + f"\n\nSURVEY §2: {_ids}").lstrip()
