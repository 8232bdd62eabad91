"""Binned interval joins against comparing every pair."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators import holidays as H
from tillroll.operators import intervals as I

D = dt.date


def brute(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if None not in (*x[1:], *y[1:])
                  and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2])


def frame(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} int, {name}_s long, {name}_e long")


@pytest.mark.parametrize("broadcast", [True, False])
def test_intervals_of_all_lengths(spark, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(I, "BROADCAST_ROWS", 0)
    rng = random.Random(4)

    def rows(n):
        out = []
        for i in range(n):
            s = rng.randrange(-3000, 3000)
            out.append((i, s, s + rng.choice([0, 1, 2, 3, 7, 8, 31, 200, 5000, -1])))
        return [*out, (n, None, 5), (n + 1, 5, None)]
    a, b = rows(150), rows(120)
    got = I.interval_join(frame(spark, a, "a"), frame(spark, b, "b"), ("a_s", "a_e"), ("b_s", "b_e"))
    assert got.columns == ["a", "a_s", "a_e", "b", "b_s", "b_e"]
    assert sorted((r["a"], r["b"]) for r in got.collect()) == brute(a, b)
    points = [(i, s, s) for i, s, _ in a]
    got = I.interval_join(frame(spark, points, "a"), frame(spark, b, "b"), ("a_s", "a_s"), ("b_s", "b_e"))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == brute(points, b)
    empty = frame(spark, [], "b")
    assert I.interval_join(frame(spark, a, "a"), empty, ("a_s", "a_e"), ("b_s", "b_e")).collect() == []
    assert I.interval_join(empty, frame(spark, a, "a"), ("b_s", "b_e"), ("a_s", "a_e")).collect() == []


@pytest.mark.parametrize("days", [1, 6, 200, 100_000])
def test_rows_do_not_grow_with_the_window(spark, days):
    windows = spark.range(500).select(F.date_add(F.lit(D(1990, 1, 1)), F.col("id").cast("int")).alias("s")) \
        .withColumn("e", F.date_add("s", days - 1))
    placed = I._placed(windows, "s", "e", "b")
    assert I._binned(placed, "b", I._levels(placed, "b")).count() <= 2 * 500


def test_long_windows_equal_short_ones(spark, lines):
    c = H.default_calendar(spark)
    for before, after in ((3, 2), (0, 0), (120, 79)):
        short = H.festival_daily(H.window_lines(lines, c, before=before, after=after))
        long = H.festival_daily(I.long_window_lines(lines, c, before, after))
        assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))


def test_a_window_of_several_years(spark):
    rows = [(D(y, 1, 1), str(y), 1.0) for y in range(2018, 2026)]
    lines = spark.createDataFrame(rows, "sale_date date, invoice_no string, sales_inc_tax double")
    c = spark.createDataFrame([("NY", 1, 1)], "festival string, hol_month int, hol_day int")
    got = I.long_window_lines(lines, c, 800, 0).groupBy("holiday_date").count()
    assert {r["holiday_date"].year: r["count"] for r in got.collect()} == {y: min(3, y - 2017) for y in range(2018, 2026)}
