"""Cleaning and derived-column expressions (currency text, dates, months)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CURRENCY_CHARS, MONEY, MONTHS

# Accepted date layouts, tried in order: ISO first, then day-first with dashes,
# month-first with slashes (the usual reading of '01/05/2024'), then named
# months and plain digits. One- and two-digit days and months both match.
DATE_FORMATS = ("yyyy-M-d", "yyyy/M/d", "d-M-yyyy", "M/d/yyyy", "d-MMM-yyyy", "d MMM yyyy",
                "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd")
# A time of day after the date (hours and minutes, optional seconds, fraction,
# AM/PM and zone) does not change the date and is cut off before parsing.
_TIME_OF_DAY = r"(?i)^(.*\d)[T ]+\d{1,2}:\d{2}(:\d{2}([.,]\d+)?)?( ?[AP]M)?( ?(Z|UTC|GMT|[+-]\d{2}:?\d{2}))?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_currency(c: Column | str, to: T.DataType = MONEY) -> Column:
    """Strip '$', '₹' and ',' then coerce to a number; bad text gives NULL."""
    text = F.trim(F.translate(_col(c).cast("string"), CURRENCY_CHARS, ""))
    return text.try_cast(to)


def clean_currency_columns(df: DataFrame, columns, to: T.DataType = MONEY) -> DataFrame:
    """Apply :func:`clean_currency` to each listed column that exists."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: clean_currency(c, to) for c in present})


def without_time(c: Column | str) -> Column:
    """The text of a date, trimmed and without a time of day. Only texts with
    a colon can have one, and the pattern is tried on these alone."""
    text = F.trim(_col(c).cast("string"))
    return F.when(F.contains(text, F.lit(":")), F.regexp_replace(text, _TIME_OF_DAY, "$1")).otherwise(text)


def parse_date(c: Column | str, formats=DATE_FORMATS) -> Column:
    """Text or timestamp to DATE; unparseable or impossible dates give NULL."""
    as_text = without_time(c)
    return F.coalesce(*[F.try_to_timestamp(as_text, F.lit(f)).cast("date") for f in formats])


def parse_date_of(df: DataFrame, column: str, formats=DATE_FORMATS) -> Column:
    """Like :func:`parse_date` but uses the column type: DATE and TIMESTAMP are cast."""
    dtype = df.schema[column].dataType
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("date")
    return parse_date(column, formats)


def year_text(d: Column | str) -> Column:
    """Calendar year as text ('2024')."""
    return F.year(_col(d)).cast("string")


def month_name(d: Column | str) -> Column:
    """Full English month name ('January'): a lookup on the month number,
    cheaper per row than date formatting."""
    return month_label(F.month(_col(d)))


def month_label(month_num: Column | str) -> Column:
    """Full English month name for 1..12 (NULL otherwise)."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.try_element_at(months, _col(month_num).cast("int"))


def month_number(month: Column | str) -> Column:
    """1..12 for a full month name, 0 for anything else (including NULL)."""
    months = F.array(*[F.lit(m) for m in MONTHS])
    return F.coalesce(F.array_position(months, _col(month)), F.lit(0)).cast("int")


def year_from_text(s: Column | str, sep: str = "-") -> Column:
    """Last ``sep``-separated token of a text date ('05-01-2024' -> '2024')."""
    return F.substring_index(_col(s), sep, -1)


def brand(business_unit: Column | str | None) -> Column:
    """Business unit with NULL / 'nan' -> 'Other'; 'Unknown' when the column is absent."""
    if business_unit is None:
        return F.lit("Unknown")
    bu = _col(business_unit)
    return F.coalesce(F.nullif(bu, F.lit("nan")), F.lit("Other"))


def brand_of(df: DataFrame, column: str = "business_unit") -> Column:
    return brand(column if column in df.columns else None)


def with_calendar_parts(df: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """Add ``year`` (text), ``month`` (name) and ``month_num`` from a DATE column."""
    return df.withColumns({
        "year": year_text(date_col),
        "month": month_name(date_col),
        "month_num": F.month(date_col),
    })


def _renamed(raw: DataFrame) -> DataFrame:
    from ..schemas import DB_MEASURE_NAMES, SOURCE_HEADERS
    names = {src: dst for src, dst in {**SOURCE_HEADERS, **DB_MEASURE_NAMES}.items()
             if src in raw.columns and (src == dst or dst not in raw.columns)}
    return raw.withColumnsRenamed(names)


def invalid_dates(raw: DataFrame) -> DataFrame:
    """The raw rows that :func:`normalize_sales` drops: their sale date is
    missing or cannot be read."""
    renamed = _renamed(raw)
    return renamed.where(parse_date_of(renamed, "sale_date").isNull()).toDF(*raw.columns)


def normalize_sales(raw: DataFrame, source: str | None = None, day_first=None) -> DataFrame:
    """Raw sale lines (source headers or database columns, text values) ->
    canonical sale lines.

    Renames the known headers, cleans the money columns, parses the sale
    date and drops rows whose date is invalid (:func:`invalid_dates` returns
    those). Missing optional columns are added as typed NULLs so downstream
    code sees one fixed schema; rows without any sales measure are an error.

    Dates of numbers with slashes are read month first, others day first. With
    ``source``, a column that names the file of each row, the order of day and
    month follows the votes of all dates of the file (``functions.dates``);
    ``day_first`` overrides it by file or column.
    """
    from ..schemas import MEASURES, SALES_LINES
    renamed = _renamed(raw)
    if not set(MEASURES.values()) & set(renamed.columns):
        raise ValueError(f"no sales measure among the columns {raw.columns}")
    if source is not None and isinstance(renamed.schema["sale_date"].dataType, T.StringType):
        from .dates import parse_dates_by_source
        out = parse_dates_by_source(renamed, ["sale_date"], source, day_first)
    else:
        out = renamed.withColumn("sale_date", parse_date_of(renamed, "sale_date"))
    out = clean_currency_columns(out, [f.name for f in SALES_LINES.fields
                                       if f.dataType == MONEY])
    missing = {f.name: F.lit(None).cast(f.dataType) for f in SALES_LINES.fields
               if f.name not in out.columns}
    if missing:
        out = out.withColumns(missing)
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in SALES_LINES.fields
             if f.dataType == T.StringType()}
    return out.withColumns(casts).dropna(subset=["sale_date"]) \
        .select(*[f.name for f in SALES_LINES.fields])
