"""Database table scan, one query a partition (predicate pushdown): partitions
of a year or less, or of about equally many rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession


def year_predicates(years, date_col: str = "sale_date", months: int = 12) -> list[str]:
    """Half-open date-range predicates of ``months`` months (a divisor of 12),
    executed in the database; by default one per year."""
    if months < 1 or 12 % months:
        raise ValueError(f"months must divide 12, got {months}")
    starts = [(y, m) for y in years for m in range(1, 13, months)]
    return [f"\"{date_col}\" >= DATE '{y:04d}-{m:02d}-01' AND "
            f"\"{date_col}\" < DATE '{y + (m + months) // 13:04d}-{(m + months - 1) % 12 + 1:02d}-01'"
            for y, m in starts]


def read_by_year(spark: SparkSession, url: str, table: str, years,
                 date_col: str = "sale_date", properties: dict | None = None,
                 order_by: str | None = None, months: int = 12) -> DataFrame:
    """Read ``table`` with one JDBC partition per year, or per ``months``
    months where a year is too much for one task, in parallel.

    Replaces a page-by-page fetch loop: every range is one query whose
    filter runs inside the database; nothing is skipped or fetched twice.
    Errors raise. ``order_by`` sorts the result (a distributed sort).
    """
    df = spark.read.jdbc(url, table, predicates=year_predicates(years, date_col, months),
                         properties=dict(properties or {}))
    return df.orderBy(order_by) if order_by else df


def balanced_predicates(days: Iterable[tuple[dt.date, int]], parts: int, date_col: str = "sale_date",
                        split_col: str | None = None) -> list[str]:
    """Predicates of about equally many rows from the rows of each day.

    The stretches between days of more than an even share are cut evenly, a day
    going where its middle row lies. A day of more than a share is a range of
    its own; with ``split_col``, a whole-number column, it is dealt over several by the
    column's remainder, its nulls with the first. Ranges leave no gap between
    them, and the first and last are open, so rows of days that came after the
    counting are read too; rows without a date are a range of their own."""
    counts = sorted((d, n) for d, n in days if d is not None and n > 0)
    column, share = f'"{date_col}"', max(1.0, sum(n for _, n in counts) / max(1, parts))
    ranges = []  # first day and rows of each
    for heavy, stretch in groupby(counts, lambda c: c[1] > share):
        stretch = list(stretch)
        if heavy:
            ranges += stretch
            continue
        total = sum(n for _, n in stretch)
        pieces, before, piece = max(1, round(total / share)), 0, -1
        for day, n in stretch:
            # the piece that holds the day's middle row
            if (at := int((before + n / 2) * pieces / total)) != piece:
                ranges.append((day, 0))
                piece = at
            ranges[-1] = (ranges[-1][0], ranges[-1][1] + n)
            before += n
    out = []
    for i, (first, rows) in enumerate(ranges):
        bounds = [f"{column} >= DATE '{first.isoformat()}'"] if i else []
        if i + 1 < len(ranges):
            bounds.append(f"{column} < DATE '{ranges[i + 1][0].isoformat()}'")
        inside = " AND ".join(bounds) or f"{column} IS NOT NULL"
        pieces = round(rows / share) if split_col and rows > 1.5 * share else 1
        if pieces < 2:
            out.append(inside)
            continue
        for k in range(pieces):
            # the remainder of a negative number is negative
            rest = f'ABS(MOD("{split_col}", {pieces})) = {k}'
            out.append(f"{inside} AND ({rest}" + (f' OR "{split_col}" IS NULL)' if k == 0 else ")"))
    return [*(out or [f"{column} IS NOT NULL"]), f"{column} IS NULL"]


def day_counts(spark: SparkSession, url: str, table: str, date_col: str = "sale_date",
               properties: dict | None = None) -> list[tuple[dt.date, int]]:
    """Rows of each day, counted in the database: one row a day comes back."""
    query = f'(SELECT CAST("{date_col}" AS DATE) AS day, COUNT(*) AS n FROM {table} GROUP BY CAST("{date_col}" AS DATE)) days'
    rows = spark.read.jdbc(url, query, properties=dict(properties or {})).collect()
    return [(r[0], int(r[1])) for r in rows]


def read_balanced(spark: SparkSession, url: str, table: str, parts: int, date_col: str = "sale_date",
                  split_col: str | None = None, properties: dict | None = None,
                  order_by: str | None = None) -> DataFrame:
    """Read ``table`` in about ``parts`` partitions of like numbers of rows,
    whatever the busy years, months and days (:func:`balanced_predicates`)."""
    days = day_counts(spark, url, table, date_col, properties)
    df = spark.read.jdbc(url, table, predicates=balanced_predicates(days, parts, date_col, split_col),
                         properties=dict(properties or {}))
    return df.orderBy(order_by) if order_by else df
