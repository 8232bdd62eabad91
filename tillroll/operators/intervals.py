"""Joins of days (or whole numbers) with intervals of any length.

Neither a row a day nor a row-by-row comparison: an interval of length n lies
in one or two bins of the next power of two above n, whatever n is. Rows meet
by (level, bin), a level being a bin width that occurs. Two intervals of
different levels meet at the wider one, and a pair that shares two bins comes
out in the bin of the later start only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import not_null, row_count_at_most

#: Interval tables of up to this many rows (two bins each) are broadcast.
BROADCAST_ROWS = 10_000


def _number(df: DataFrame, column: str) -> Column:
    """A date as its day number; whole numbers as they are."""
    return F.unix_date(column) if isinstance(df.schema[column].dataType, T.DateType) else F.col(column).cast("long")


def _level(start: Column, end: Column) -> Column:
    """Bits of the length: 0 for a single day, n for lengths below 2^n."""
    return F.when(end > start, F.length(F.bin(end - start))).otherwise(0).cast("int")


def _placed(df: DataFrame, start: str, end: str, side: str) -> DataFrame:
    lo, hi = (F.col(f"_{side}_{x}") for x in ("lo", "hi"))
    out = df.withColumns({f"_{side}_lo": _number(df, start).cast("long"), f"_{side}_hi": _number(df, end).cast("long")})
    return out.where(not_null([f"_{side}_lo", f"_{side}_hi"]) & (lo <= hi)).withColumn(f"_{side}_own", _level(lo, hi))


def _levels(placed: DataFrame, side: str) -> list[int]:
    """The levels that occur, at most 64."""
    return sorted(placed.agg(F.collect_set(f"_{side}_own")).first()[0])


def _binned(placed: DataFrame, side: str, levels: list[int]) -> DataFrame:
    """A row a level from the own one on, and one or two bins each."""
    own, lo, hi = (F.col(f"_{side}_{x}") for x in ("own", "lo", "hi"))
    at = F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= own)
    # rounded down, also below zero
    shifted = lambda v: F.floor(v / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    return (placed.withColumn("_level", F.explode(at))
            .withColumn("_bin", F.explode(F.sequence(shifted(lo), shifted(hi)))))


def interval_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str], right_on: tuple[str, str]) -> DataFrame:
    """All pairs of a row of ``left`` and one of ``right`` whose intervals, both
    ends included, share a day; all columns of both, whose names differ. A pair
    of the same column twice is a point, as (``sale_date``, ``sale_date``).

    Intervals with a null end, or that end before they start, meet nothing. The
    levels of both sides are found when the frame is built (those of points are
    known). A ``right`` of few rows is broadcast after a count; else both sides
    are dealt out by bin, and large bins are split by AQE."""
    a, b = _placed(left, *left_on, "a"), _placed(right, *right_on, "b")
    found = [_levels(p, side) if on[0] != on[1] else [0] for p, side, on in ((a, "a", left_on), (b, "b", right_on))]
    levels = sorted({x for f in found for x in f} or {0})
    lowest = max(min(f, default=0) for f in found)
    levels = [x for x in levels if x >= lowest]  # pairs meet at the wider of the two
    x, y = _binned(a, "a", levels), _binned(b, "b", levels)
    if row_count_at_most(b, BROADCAST_ROWS):
        y = F.broadcast(y)
    later = F.greatest("_a_lo", "_b_lo")
    pair = ((F.col("_a_lo") <= F.col("_b_hi")) & (F.col("_b_lo") <= F.col("_a_hi"))
            & (F.col("_level") == F.greatest("_a_own", "_b_own"))
            & (F.col("_bin") == F.floor(later / F.pow(F.lit(2.0), F.col("_level")))))
    return x.join(y, ["_level", "_bin"]).where(pair).drop(
        "_level", "_bin", *[f"_{s}_{c}" for s in "ab" for c in ("lo", "hi", "own")])


def long_window_lines(lines: DataFrame, calendar: DataFrame, before: int, after: int, festivals=None) -> DataFrame:
    """Sale lines (or sums by day) inside festival windows of any length, as
    ``holidays.window_lines`` gives them for short ones: a window needs a sale
    on the holiday itself."""
    from .common import apply_filters
    from .holidays import holiday_dates
    windows = (apply_filters(holiday_dates(lines, calendar), {"festival": festivals})
               .select("festival", "holiday_date", F.col("year").alias("holiday_year"),
                       F.date_sub("holiday_date", before).alias("_from"), F.date_add("holiday_date", after).alias("_to")))
    return (interval_join(lines, windows, ("sale_date", "sale_date"), ("_from", "_to")).drop("_from", "_to")
            .withColumns({"days_from_festival": F.datediff("sale_date", "holiday_date").cast("long"),
                          "window_days": F.lit(before + after + 1)}))
