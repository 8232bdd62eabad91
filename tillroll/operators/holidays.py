"""Holiday analysis: calendar, holiday-date sales, festival windows.

Plan shape (no nested loops, no range join, no cross join):

* The calendar is a small dimension keyed by (month, day). Its days of the
  year (at most 366, read from the calendar alone) become a plain predicate
  on the sale date, which Catalyst pushes below the line join to the orders:
  lines of other days are never joined or shuffled on.
* The calendar is matched to the *distinct* sale dates left, which gives every
  holiday date (in every year of the data) that has sales on the day itself.
* Per-date sales join the fact lines to the calendar on (month, day) of the
  sale date: an equi-join with the calendar broadcast behind a row-count
  check; totals and per-centre rows come from one ``GROUPING SETS``.
* A festival window [date-3, date+2] is an equi-join too. ``festival_lines``
  joins on the month and day a sale has on each day of a window, for every
  calendar key, so the candidate windows of all years come from the calendar
  alone and the lines are read once. Which of them count - those with a sale on
  the holiday itself - is known only from the lines: the sums by window carry
  the number of day-0 lines along, and windows without one go afterwards. A
  sale that falls into several festivals' windows is attributed to each.
* ``window_lines`` gives the lines themselves for windows that count; it reads
  the sale dates first, as a second pass.
* Nothing reads the sales while a frame is built, but for breakdowns by keys of
  many values (items), which store their sums by window once.
"""

from __future__ import annotations

import datetime as dt
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import parse_date
from ..schemas import (BASIC_HOLIDAYS, CALENDAR_TEXT, HOLIDAY_CALENDAR, WINDOW_AFTER,
                       WINDOW_BEFORE, WINDOW_DIVISOR)
from ..session import cut_lineage
from .common import apply_filters, measure_col, not_null, row_count_at_most, sum_by

ALL_CENTERS = "All Centers"
# Calendars of up to this many keys (about 60 bytes each, and six window days
# a key and year) are broadcast; larger ones are left to the planner.
CALENDAR_BROADCAST_ROWS = 10_000


# ---- calendars ---------------------------------------------------------------

def _clean_calendar(raw: DataFrame) -> DataFrame:
    return (raw.select(F.col("Months").alias("months"),
                       parse_date("Date").alias("holiday_date"),
                       F.col("Festivals").alias("festival"),
                       F.col("MTD_Sale").try_cast("bigint").alias("mtd_sale"))
            .dropna(subset=["holiday_date"]))


def calendar_source_rows(spark: SparkSession, rows=HOLIDAY_CALENDAR) -> DataFrame:
    """Calendar rows as they appear in a holiday file (all text)."""
    return spark.createDataFrame([(m, d, f, str(s)) for m, d, f, s in rows], CALENDAR_TEXT)


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Holiday calendar file (CSV with header Months, Date, Festivals,
    MTD_Sale; columns matched by header name) -> columns ``months,
    holiday_date, festival, mtd_sale``; rows with a bad date are dropped."""
    from ..sources.files import read_table
    return _clean_calendar(read_table(spark, path, CALENDAR_TEXT, fmt="csv"))


# Calendars built from in-code lists, with their exact row count: a proven
# size bound that needs no counting job.
_FIXED_ROWS: "weakref.WeakKeyDictionary[DataFrame, int]" = weakref.WeakKeyDictionary()


def default_calendar(spark: SparkSession) -> DataFrame:
    """The built-in dated holiday calendar (``schemas.HOLIDAY_CALENDAR``),
    cleaned like a file."""
    df = _clean_calendar(calendar_source_rows(spark))
    _FIXED_ROWS[df] = len(HOLIDAY_CALENDAR)
    return df


def basic_calendar(spark: SparkSession, holidays=BASIC_HOLIDAYS) -> DataFrame:
    """Built-in fixed-date calendar as (festival, hol_month, hol_day)."""
    df = spark.createDataFrame([(f, m, d) for m, d, f in holidays],
                               "festival string, hol_month int, hol_day int")
    _FIXED_ROWS[df] = len(holidays)
    return df


def month_day(calendar: DataFrame) -> DataFrame:
    """Recurring (festival, month, day) keys of a dated calendar."""
    if "hol_month" in calendar.columns:
        return calendar.select("festival", "hol_month", "hol_day").distinct()
    return (calendar.select("festival", F.month("holiday_date").alias("hol_month"),
                            F.dayofmonth("holiday_date").alias("hol_day"))
            .where(not_null(["festival", "hol_month", "hol_day"])).distinct())


def _calendar_keys(calendar: DataFrame) -> DataFrame:
    """(festival, month, day) keys of a calendar, broadcast when their count
    is proven small: from the known length of an in-code calendar, else by
    counting (at most limit+1 rows)."""
    keys = month_day(calendar)
    return F.broadcast(keys) if _is_small(calendar) else keys


def _is_small(calendar: DataFrame) -> bool:
    known = _FIXED_ROWS.get(calendar)
    if known is not None:
        return known <= CALENDAR_BROADCAST_ROWS
    return row_count_at_most(month_day(calendar), CALENDAR_BROADCAST_ROWS)


def on_days(date_col: str, calendar: DataFrame, festivals=None, before: int = 0,
            after: int = 0) -> Column:
    """Predicate on a date: from ``before`` days before to ``after`` days after
    some holiday of the calendar, whatever the year. Reads only the calendar
    (at most 366 days of the year)."""
    md = apply_filters(month_day(calendar), {"festival": festivals})
    days = set()
    for m, d in md.select("hol_month", "hol_day").distinct().collect():
        for year in (2023, 2024):  # without and with a 29 February
            try:
                day = dt.date(year, m, d)
            except ValueError:
                continue
            for o in range(-before, after + 1):
                near = day + dt.timedelta(days=o)
                # 1 March of another year may stand where 29 February does
                days.update({near.month * 100 + near.day} | ({301, 228} if (near.month, near.day) == (2, 29) else set()))
    return (F.month(date_col) * 100 + F.dayofmonth(date_col)).isin(sorted(days)) if days else F.lit(False)


def _on_month_day(date_col: Column) -> Column:
    return (F.month(date_col) == F.col("hol_month")) & (F.dayofmonth(date_col) == F.col("hol_day"))


def holiday_dates(lines: DataFrame, calendar: DataFrame) -> DataFrame:
    """Every (festival, holiday_date, year) whose date has at least one sale.

    Equivalent to building each calendar day in every year of the data and
    keeping those with sales; invalid days (29 February in other years) never
    occur because only real sale dates are matched."""
    md = _calendar_keys(calendar)
    dates = lines.select("sale_date").where(on_days("sale_date", calendar)).distinct()
    return (dates.join(md, _on_month_day(F.col("sale_date")))
            .select("festival", F.col("sale_date").alias("holiday_date"),
                    F.year("sale_date").cast("long").alias("year")))


# ---- sales on the holiday date ------------------------------------------------

def holiday_sales(lines: DataFrame, calendar: DataFrame, measure: str = "inc_tax",
                  fallback: bool = False) -> DataFrame:
    """Per holiday date: the all-centre total (``is_total``) and one row per
    centre with sales that day, from one GROUPING SETS aggregation.

    Rows with a NULL centre count in the total but get no centre row.
    With ``fallback`` and no holiday date matching any sale, the calendar's
    own rows (year of its date, its ``mtd_sale``) are returned instead.
    """
    m = measure_col(measure)
    md = _calendar_keys(calendar)
    if fallback and "mtd_sale" not in calendar.columns:
        raise ValueError("the fallback needs a calendar with dates and sales of its own")
    joined = (lines.where(on_days("sale_date", calendar)).select("sale_date", "center_name", m)
              .join(md, _on_month_day(F.col("sale_date"))))
    keys = ["festival", "year", "holiday_date"]
    agg = (joined.withColumns({"year": F.year("sale_date").cast("long"),
                               "holiday_date": F.col("sale_date")})
           .groupingSets([keys, keys + ["center_name"]], *keys, "center_name")
           .agg(F.coalesce(F.sum(m), F.lit(0)).cast("double").alias("mtd_sale"),
                F.grouping("center_name").cast("boolean").alias("is_total")))
    out = agg.where(F.col("is_total") | F.col("center_name").isNotNull())
    if not fallback:
        return out
    matched = out.select(F.count(F.lit(1))).scalar()
    spare = calendar.where(matched == 0).select(
        "festival", F.year("holiday_date").cast("long").alias("year"), "holiday_date",
        F.lit(None).cast("string").alias("center_name"),
        F.col("mtd_sale").cast("double").alias("mtd_sale"), F.lit(True).alias("is_total"))
    return out.unionByName(spare)


def select_holiday_rows(hs: DataFrame, years=None, center: str | None = None) -> DataFrame:
    """Year list and centre choice on holiday-sales rows: a centre keeps its
    own rows, 'All Centers' (or None) keeps only the total rows."""
    out = apply_filters(hs, {"year": years})
    if center in (None, ALL_CENTERS):
        return out.where(F.col("is_total"))
    return out.where(F.col("center_name") == F.lit(center))


# ---- festival windows -------------------------------------------------------------

def festival_window_days(lines: DataFrame, calendar: DataFrame, festivals=None, years=None,
                         before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER) -> DataFrame:
    """Distinct holiday dates (optionally chosen festivals / holiday years),
    exploded to one row per window day ``sale_date`` in [date-before, date+after].
    Only ``sale_date`` of ``lines`` is read."""
    h = holiday_dates(lines, calendar)
    h = apply_filters(h, {"festival": festivals, "year": years}).distinct()
    offsets = F.sequence(F.lit(-before), F.lit(after))
    return (h.withColumn("_offset", F.explode(offsets))
            .select("festival", "holiday_date", F.col("year").alias("holiday_year"),
                    F.col("_offset").cast("long").alias("days_from_festival"),
                    F.date_add("holiday_date", F.col("_offset")).alias("sale_date")))


def window_days_table(dates: DataFrame, calendar: DataFrame, festivals=None, years=None,
                      before: int = WINDOW_BEFORE, after: int = WINDOW_AFTER) -> DataFrame:
    """The window-day table. It has at most a row per calendar key, year of
    the data and window day, so that of a small calendar is broadcast."""
    days = festival_window_days(dates, calendar, festivals, years, before, after)
    return F.broadcast(days) if _is_small(calendar) else days


def window_lines(lines: DataFrame, calendar: DataFrame, festivals=None, years=None,
                 center: str | None = None, before: int = WINDOW_BEFORE,
                 after: int = WINDOW_AFTER, dates: DataFrame | None = None,
                 days: DataFrame | None = None) -> DataFrame:
    """Sale lines inside each festival window, tagged with festival,
    holiday_date, holiday_year and days_from_festival.

    ``dates`` may name a cheaper source of the same sale dates (for example
    the line table without its dimension joins); it defaults to ``lines``.
    ``days`` passes a window-day table already built by
    :func:`window_days_table` with the same calendar and choices."""
    if days is None:
        days = window_days_table(lines if dates is None else dates, calendar, festivals,
                                 years, before, after)
    src = lines if center in (None, ALL_CENTERS) else \
        lines.where(F.col("center_name") == F.lit(center))
    return (src.where(on_days("sale_date", calendar, festivals, before, after)).join(days, "sale_date")
            .withColumn("window_days", F.lit(before + after + 1)))


def _candidate_days(calendar: DataFrame, festivals, before: int, after: int) -> DataFrame:
    """(festival, hol_month, hol_day, days_from_festival, _md): the month and
    day (as one number) of each day of each key's window. A window that meets
    the end of February has other days in other years, so the keys are laid out
    in years before, in and after a leap year; days outside the calendar (30
    February) fall out."""
    md = apply_filters(month_day(calendar), {"festival": festivals})
    first = F.add_months(F.make_date(F.col("_y"), F.lit(1), F.lit(1)), F.col("hol_month") - 1)
    day = F.date_add(first, F.col("hol_day") - 1)
    return (md.withColumn("_y", F.explode(F.array(*[F.lit(y) for y in (2022, 2023, 2024, 2025)])))
            .withColumn("_day", day).where((F.month("_day") == F.col("hol_month")) & (F.year("_day") == F.col("_y")))
            .withColumn("_o", F.explode(F.sequence(F.lit(-before), F.lit(after))))
            .withColumn("_near", F.date_add("_day", F.col("_o")))
            .select("festival", "hol_month", "hol_day", F.col("_o").cast("long").alias("days_from_festival"),
                    (F.month("_near") * 100 + F.dayofmonth("_near")).alias("_md")).distinct())


def festival_lines(lines: DataFrame, calendar: DataFrame, festivals=None, years=None,
                   center: str | None = None, before: int = WINDOW_BEFORE,
                   after: int = WINDOW_AFTER) -> DataFrame:
    """Sale lines inside candidate windows, in one pass over the lines: all
    columns, plus festival, holiday_date, holiday_year, days_from_festival,
    window_days, ``day0`` (the sale is on the holiday itself) and ``chosen``.

    The operators of this module take these lines like those of
    :func:`window_lines` and leave out windows without a day-0 sale. A centre's
    choice keeps the day-0 sales of the others, which decide about windows, as
    not ``chosen``. Windows of up to a year; longer ones go through
    :func:`tillroll.operators.intervals.interval_join`."""
    if not (0 <= before <= 365 and 0 <= after <= 365):
        raise ValueError("a window has 0 to 365 days before and after the holiday")
    days = _candidate_days(calendar, festivals, before, after)
    if _is_small(calendar):
        days = F.broadcast(days)  # at most a row a key, window day and kind of year
    holiday = F.expr("date_sub(sale_date, CAST(days_from_festival AS INT))")
    out = (lines.where(on_days("sale_date", calendar, festivals, before, after))
           .withColumn("_md", F.month("sale_date") * 100 + F.dayofmonth("sale_date")).join(days, "_md")
           .withColumn("holiday_date", holiday)
           .where((F.month("holiday_date") == F.col("hol_month")) & (F.dayofmonth("holiday_date") == F.col("hol_day")))
           .drop("_md", "hol_month", "hol_day")
           .withColumns({"holiday_year": F.year("holiday_date").cast("long"), "window_days": F.lit(before + after + 1),
                         "day0": F.col("days_from_festival") == 0,
                         "chosen": F.lit(True) if center in (None, ALL_CENTERS) else
                         F.coalesce(F.col("center_name") == F.lit(center), F.lit(False))}))
    if years is not None:
        out = apply_filters(out.withColumnRenamed("holiday_year", "_hy"), {"_hy": years}) \
            .withColumnRenamed("_hy", "holiday_year")
    return out.where(F.col("chosen") | F.col("day0"))


WINDOW_KEYS = ["festival", "holiday_date"]


def _chosen(wl: DataFrame, value) -> Column:
    """A value of the chosen lines, null for the others."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.col("chosen"), value) if "chosen" in wl.columns else value


def _by_window(wl: DataFrame, keys: list[str], many: bool = False, **aggregates: Column) -> DataFrame:
    """Window lines grouped by window and ``keys``. Of candidate windows, those
    with a day-0 line stay: the number of these lines is one more sum of each
    group, added up by window over the grouped rows. ``many`` is for keys whose
    groups outgrow a task a window (items, invoices): the grouped rows are then
    stored once while the frame is built, and the windows that count are a
    small table made from them."""
    by = [*WINDOW_KEYS, *[k for k in keys if k not in WINDOW_KEYS]]
    named = [c.alias(n) for n, c in aggregates.items()]
    if "day0" not in wl.columns:
        return wl.groupBy(*by).agg(*named)
    agg = wl.groupBy(*by).agg(*named, F.count_if("day0").alias("_day0"), F.count_if("chosen").alias("_n"))
    if by == WINDOW_KEYS:
        kept = agg.where((F.col("_day0") > 0) & (F.col("_n") > 0))
    elif not many:
        kept = (agg.withColumn("_w", F.sum("_day0").over(Window.partitionBy(*WINDOW_KEYS)))
                .where((F.col("_w") > 0) & (F.col("_n") > 0)).drop("_w"))
    else:
        agg = cut_lineage(agg)
        windows = (agg.groupBy(*WINDOW_KEYS).agg(F.sum("_day0").alias("_w")).where(F.col("_w") > 0)
                   .select(*[F.col(k).alias(f"_{k}") for k in WINDOW_KEYS]))
        kept = (agg.where(F.col("_n") > 0)
                .join(windows, [F.col(k) == F.col(f"_{k}") for k in WINDOW_KEYS], "left_semi"))
    return kept.drop("_day0", "_n")


def festival_daily(wl: DataFrame, measure: str = "inc_tax") -> DataFrame:
    """Daily sums inside each window, with the signed day offset, the sale
    year and a 'dd Mon' label."""
    sums = _by_window(wl, ["sale_date", "days_from_festival"], _sales=F.sum(_chosen(wl, measure_col(measure))))
    return sums.select(*WINDOW_KEYS, "sale_date", "days_from_festival",
                       F.coalesce("_sales", F.lit(0)).cast("double").alias("sales"),
                       F.year("sale_date").cast("long").alias("year"),
                       F.date_format("sale_date", "dd MMM").alias("day_label"))


def festival_performance(wl: DataFrame, measure: str = "inc_tax", by_center: bool = False,
                         center_label: str = ALL_CENTERS) -> DataFrame:
    """Window total and average daily sales per festival and holiday date
    (per centre too with ``by_center``), keeping windows with sales > 0,
    largest first. The average is over the days of the window."""
    keys = ["center_name"] if by_center else []
    days = F.max("window_days") if "window_days" in wl.columns else F.lit(WINDOW_DIVISOR)
    agg = _by_window(wl, keys, _total=F.sum(_chosen(wl, measure_col(measure))), _days=days)
    out = agg.where(not_null([*WINDOW_KEYS, *keys]) & (F.col("_total") > 0)).select(
        "festival", F.year("holiday_date").cast("long").alias("year"), "holiday_date",
        (F.col("center_name") if by_center else F.lit(center_label)).alias("center"),
        F.col("_total").cast("double").alias("total_window_sales"),
        (F.col("_total").cast("double") / F.col("_days").cast("double")).alias("average_daily_sales"))
    return out.orderBy(F.desc("total_window_sales"), "festival", "holiday_date", "center")


def _window_sums(wl: DataFrame, keys: list[str], measure: str, many: bool = False) -> DataFrame:
    """Exact sums of window sales by ``keys`` (none null), as ``_sales``."""
    m = measure_col(measure)
    if "day0" not in wl.columns:
        return sum_by(wl, keys, m, "_sales", exact=True)
    return (_by_window(wl, keys, many, _sales=F.sum(_chosen(wl, m))).where(not_null(keys))
            .groupBy(*keys).agg(F.coalesce(F.sum("_sales"), F.lit(0)).alias("_sales")))


def breakdown(wl: DataFrame, keys: list[str], measure: str = "inc_tax", many: bool = False) -> DataFrame:
    """Sum of window sales by keys; ``year`` means the sale's year. ``many``
    says that the keys have many values (see :func:`_by_window`)."""
    src = wl.withColumn("year", F.year("sale_date").cast("long")) if "year" in keys else wl
    return _window_sums(src, keys, measure, many).select(*keys, F.col("_sales").cast("double").alias("sales"))


def center_business_top(wl: DataFrame, k: int = 10, measure: str = "inc_tax") -> DataFrame:
    """Centre × business unit sums for the k centres with the most window sales.

    The centre ranking is taken from the centre × business-unit sums (a
    centre's total counts all its lines, also those without a business unit;
    the exchange of the sums is reused), and the top k (at most k rows,
    broadcast) select the output rows."""
    sums = _by_window(wl, ["center_name", "business_unit"], _sales=F.sum(_chosen(wl, measure_col(measure))))
    cb = (sums.where(F.col("center_name").isNotNull()).groupBy("center_name", "business_unit")
          .agg(F.coalesce(F.sum("_sales"), F.lit(0)).alias("sales")))
    top = (cb.groupBy("center_name").agg(F.sum("sales").alias("_c"))
           .orderBy(F.desc("_c"), "center_name").limit(k).select("center_name"))
    return (cb.where(F.col("business_unit").isNotNull())
            .join(F.broadcast(top), "center_name", "left_semi")
            .select("center_name", "business_unit", F.col("sales").cast("double").alias("sales")))


def top_items(wl: DataFrame, k: int = 15, measure: str = "inc_tax") -> DataFrame:
    """The k items with the most window sales."""
    return (breakdown(wl, ["item_name"], measure, many=True)
            .orderBy(F.desc("sales"), "item_name").limit(k))


def top_item_counts(wl: DataFrame, k: int = 15) -> DataFrame:
    """The k items with the most window lines."""
    counts = _by_window(wl, ["item_name"], many=True, _lines=F.count(_chosen(wl, F.lit(1))))
    return (counts.where(F.col("item_name").isNotNull()).groupBy("item_name")
            .agg(F.sum("_lines").alias("count"))
            .orderBy(F.desc("count"), "item_name").limit(k))


def service_summary(wl: DataFrame, k: int = 20, measure: str = "inc_tax") -> DataFrame:
    """Top-k (item, category, business unit) by revenue with distinct
    invoices and average price (revenue / invoices). Lines are summed by
    invoice first, so an invoice in two windows counts once."""
    keys = ["item_name", "item_category", "business_unit"]
    sums = _by_window(wl, [*keys, "invoice_no"], many=True, _sales=F.sum(_chosen(wl, measure_col(measure))))
    agg = (sums.where(not_null(keys)).groupBy(*keys)
           .agg(F.coalesce(F.sum("_sales"), F.lit(0)).cast("double").alias("revenue"),
                F.countDistinct("invoice_no").alias("service_count")))
    agg = agg.withColumn("average_price",
                         F.try_divide(F.col("revenue"), F.col("service_count").cast("double")))
    return agg.orderBy(F.desc("revenue"), *keys).limit(k)


def fill_days(daily: DataFrame, series: list[str], zeros: dict[str, object]) -> DataFrame:
    """``daily`` (series, sale_date, columns of ``zeros``; at most a row a day
    and series) with a row for every day from a series' first to its last; a
    day without a row has the values of ``zeros``. Rows with a null date or
    series are left out.

    Each row knows the next one's date and is followed by the empty days up to
    it. A series is ordered by itself; it has a row a day at most. Where there
    is one series only, it is ordered by year, and the first days of the years
    (one array, a date a year) carry over the boundary."""
    src = daily.where(not_null([*series, "sale_date"])).select(*series, "sale_date", *zeros)
    if series:
        after = F.lead("sale_date").over(Window.partitionBy(*series).orderBy("sale_date"))
    else:
        heads = src.groupBy(F.year("sale_date").alias("_y")).agg(F.min("sale_date").alias("_h")).select(
            F.collect_list("_h")).scalar()
        within = F.lead("sale_date").over(Window.partitionBy(F.year("sale_date")).orderBy("sale_date"))
        src = src.withColumn("_heads", heads)
        after = F.coalesce(within, F.array_min(F.filter("_heads", lambda h: h > F.col("sale_date"))))
    upto = F.coalesce(F.date_sub(after, 1), F.col("sale_date"))
    days = src.withColumn("_upto", upto).withColumn("_day", F.explode(F.sequence("sale_date", "_upto")))
    first = F.col("_day") == F.col("sale_date")
    return days.select(*series, F.col("_day").alias("sale_date"),
                       *[F.when(first, F.col(c)).otherwise(F.lit(z)).alias(c) for c, z in zeros.items()])


def daily_traffic(wl: DataFrame, festival_days: DataFrame | None = None, measure: str = "inc_tax",
                  series: tuple[str, ...] = ()) -> DataFrame:
    """Distinct invoices and revenue per day over the windows, zero-filled
    for every day from the first to the last window day (of each series, for
    example a centre or an item), with the festival days flagged.

    ``festival_days`` (holiday_date) names the days to flag. Without it they
    are those of the windows of :func:`festival_lines` that have a sale of the
    series on the holiday. A day in several windows counts once a window in the
    revenue, and its invoices once."""
    series = list(series)
    sums = _by_window(wl, [*series, "sale_date"], many=bool(series), _sales=F.sum(_chosen(wl, measure_col(measure))),
                      _invoices=F.countDistinct(_chosen(wl, "invoice_no"))) if "day0" in wl.columns else \
        wl.groupBy(*series, "sale_date").agg(F.sum(measure_col(measure)).alias("_sales"),
                                             F.countDistinct("invoice_no").alias("_invoices"))
    on_day = F.max(F.col("holiday_date") == F.col("sale_date")) if "day0" in wl.columns else F.lit(False)
    daily = (sums.groupBy(*series, "sale_date")
             .agg(F.max("_invoices").alias("invoices"), F.coalesce(F.sum("_sales"), F.lit(0)).cast("double").alias("revenue"),
                  on_day.alias("is_festival")))
    filled = fill_days(daily, series, {"invoices": 0, "revenue": 0.0, "is_festival": False})
    if festival_days is not None:
        marks = festival_days.select(F.col("holiday_date").alias("sale_date")).distinct().withColumn("_mark", F.lit(True))
        filled = (filled.drop("is_festival").join(marks, "sale_date", "left")
                  .withColumn("is_festival", F.coalesce("_mark", F.lit(False))))
    return filled.select(*series, "sale_date", F.col("invoices").cast("long").alias("invoices"), "revenue", "is_festival")


def calendar_summary(lines: DataFrame, calendar: DataFrame, measure: str = "inc_tax") -> DataFrame:
    """Each calendar row as loaded, with how many years had sales on its
    month/day and what was sold on those days. The fact lines are reduced to
    one row per (month, day) first (at most 366 rows), then joined to the
    calendar."""
    m = measure_col(measure)
    per_day = (lines.where(F.col("sale_date").isNotNull())
               .groupBy(F.month("sale_date").alias("hol_month"),
                        F.dayofmonth("sale_date").alias("hol_day"))
               .agg(F.countDistinct(F.year("sale_date")).alias("years_with_sales"),
                    F.coalesce(F.sum(m), F.lit(0)).cast("double").alias("sales_on_day")))
    cal = calendar.withColumns({"hol_month": F.month("holiday_date"),
                                "hol_day": F.dayofmonth("holiday_date")})
    out = cal.join(per_day, ["hol_month", "hol_day"], "left")
    return out.select("months", "holiday_date", "festival", "mtd_sale",
                      F.coalesce("years_with_sales", F.lit(0)).cast("long").alias("years_with_sales"),
                      F.coalesce("sales_on_day", F.lit(0.0)).alias("sales_on_day"))
