"""Order of day and month by source."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.functions import dates as D
from tillroll.functions.clean import normalize_sales

day = dt.date


def parsed(spark, rows, **kw):
    df = spark.createDataFrame([(i, s, c) for i, (s, c) in enumerate(rows)], "i int, src string, cell string")
    out = D.parse_dates_by_source(df, ["cell"], "src", **kw).orderBy("i").collect()
    assert len(out) == len(rows)
    return [r["cell"] for r in out]


def test_each_source_has_its_own_order(spark):
    rows = [("a", "05/06/2024"), ("a", "25/06/2024"), ("b", "05/06/2024"), ("b", "06/25/2024"), ("c", "05.06.2024"),
            ("c", "06.25.24 10:30"), ("d", "5-6-99"), (None, "05/06/2024"), (None, "31/01/2024")]
    assert parsed(spark, rows) == [day(2024, 6, 5), day(2024, 6, 25), day(2024, 5, 6), day(2024, 6, 25), day(2024, 5, 6),
                                   day(2024, 6, 25), day(1999, 6, 5), day(2024, 6, 5), day(2024, 1, 31)]


def test_separators_of_one_file_vote_apart(spark):
    rows = [("a", "05/06/2024"), ("a", "25/06/2024"), ("a", "05-06-2024"), ("a", "06-25-2024"), ("a", "05.06.2024")]
    assert parsed(spark, rows) == [day(2024, 6, 5), day(2024, 6, 25), day(2024, 5, 6), day(2024, 6, 25), day(2024, 6, 5)]


def test_other_layouts_and_no_dates(spark):
    rows = [("a", "2024-06-05"), ("a", "5 Jun 2024"), ("a", "Jun 5, 2024"), ("a", "20240605"), ("a", "30/02/2024"),
            ("a", "x"), ("a", ""), ("a", None), ("a", "31/31/2024"), ("a", "2024/06/05"), ("a", "05/06-2024")]
    assert parsed(spark, rows) == [day(2024, 6, 5)] * 4 + [None] * 5 + [day(2024, 6, 5), None]


def layouts(spark, rows, override=None):
    df = spark.createDataFrame(rows, "src string, cell string, other string")
    out = D.date_layouts(D.date_votes(df, ["cell", "other"], "src"), override)
    return out, {(r["source"], r["column"], r["mark"]): (r["reads_day_first"], r["status"]) for r in out.collect()}


def test_report_and_override(spark):
    rows = [("a", "05/06/2024", "06.05.2024"), ("a", "07/08/2024", None), ("b", "25/06/2024", "x"), ("b", "06/25/2024", "12.25.2024"),
            ("b", "26/06/2024", "1.1.2024"), ("c", "03/03/2024", "2024-01-01")]
    frame, got = layouts(spark, rows)
    assert got == {("a", "cell", "/"): (False, "ambiguous"), ("a", "other", "."): (True, "ambiguous"), ("b", "cell", "/"): (True, "mixed"),
                   ("b", "other", "."): (False, "month first"), ("c", "cell", "/"): (False, "month first")}
    assert {(r["source"], r["column"]) for r in D.ambiguous_sources(frame).collect()} == {("a", "cell"), ("a", "other"), ("b", "cell")}
    chosen = layouts(spark, rows, {"cell": True, "b": False})[1]
    assert chosen[("a", "cell", "/")] == (True, "chosen") and chosen[("b", "cell", "/")] == (False, "chosen")
    assert chosen[("a", "other", ".")] == (True, "ambiguous")
    # a cell of a mixed file that is a date in the other order only is not lost
    assert parsed(spark, [(r[0], r[1]) for r in rows if r[0] == "b"]) == [day(2024, 6, 25), day(2024, 6, 25), day(2024, 6, 26)]
    assert parsed(spark, [("a", "05/06/2024")], override={"a": True}) == [day(2024, 6, 5)]


def test_hot_source_and_stored_layouts(spark):
    df = spark.range(30_000).select(F.lit("one").alias("src"), F.date_format(F.date_add(F.lit(day(2024, 1, 1)), (F.col("id") % 366).cast("int")), "d/M/yyyy").alias("cell"),
                                    F.date_add(F.lit(day(2024, 1, 1)), (F.col("id") % 366).cast("int")).alias("want"))
    stored = D.date_layouts(D.date_votes(df, ["cell"], "src"))
    assert D.parse_dates_by_source(df, ["cell"], "src", layouts=stored).where("cell IS NULL OR cell <> want").count() == 0


def test_files_and_jobs(spark, capsys):
    from tillroll.jobs import run
    from tillroll.sources.files import load_all
    at = tempfile.mkdtemp(prefix="tillroll-sheets-")
    head = "Sale Date,Invoice No,Center Name,Sales Collected (Inc.Tax)\n"
    with open(os.path.join(at, "a.csv"), "w") as f:
        f.write(head + "05/06/2024,1,X,10\n25/06/2024,2,X,20\n")
    with open(os.path.join(at, "b.csv"), "w") as f:
        f.write(head + "05/06/2024,3,Y,30\n06/25/2024,4,Y,40\nno date,5,Y,50\n")
    os.rename(at, at + ".csv")
    data = load_all(spark, at + ".csv", dates_by_file=True)
    got = sorted((r["center_name"], r["sale_date"], float(r["sales_inc_tax"])) for r in data.sales.collect())
    assert got == [("X", day(2024, 6, 5), 10.0), ("X", day(2024, 6, 25), 20.0), ("Y", day(2024, 5, 6), 30.0), ("Y", day(2024, 6, 25), 40.0)]
    out = run(["monthly-mart", "--input", at + ".csv", "--output", at + "-mart"], spark)
    assert (out["rows"], out["invalid_dates"]) == (5, 1)
    assert sorted((r["month"], r["mtd_sales"]) for r in spark.read.parquet(at + "-mart").collect()) == [
        ("June", 30.0), ("June", 40.0), ("May", 30.0)]


def test_dates_that_are_dates_need_no_votes(spark):
    df = spark.createDataFrame([(day(2024, 6, 5), 1.0, "f")], "sale_date date, sales_inc_tax double, source_file string")
    assert normalize_sales(df, "source_file").first()["sale_date"] == day(2024, 6, 5)


@pytest.mark.parametrize("cell", ["05/06/2024", "x", None])
def test_empty_and_single(spark, cell):
    assert len(parsed(spark, [("a", cell)])) == 1
    df = spark.createDataFrame([], "src string, cell string")
    assert D.parse_dates_by_source(df, ["cell"], "src").collect() == []


def test_numbers_are_cast_and_not_parsed_by_patterns(spark):
    """A failed parse costs many casts: both readings are casts that give what
    the pattern gave, and other layouts are tried on other cells only."""
    cells = [f"{a}/{b}/{y}" for a in ("0", "00", "1", "02", "12", "13", "29", "30", "31", "32") for b in ("0", "2", "02", "11", "13", "29", "31")
             for y in ("0000", "1900", "2000", "2023", "2024", "68", "69")]
    df = spark.createDataFrame([(c,) for c in cells], "cell string").withColumn("p", D._parts("cell"))
    readings = D._dates(F.col("p"))
    assert not any("timestamp" in str(r) for r in readings)
    year = F.when(F.length(F.col("p")[2]) == 4, F.col("p")[2]).otherwise(F.concat(F.when(F.col("p")[2] < "69", "20").otherwise("19"), F.col("p")[2]))
    for reading, (d, m) in zip(readings, ((0, 1), (1, 0))):
        pattern = F.try_to_timestamp(F.concat_ws("-", year, F.col("p")[m], F.col("p")[d]), F.lit("yyyy-M-d")).cast("date")
        assert df.where(~reading.eqNullSafe(pattern)).count() == 0
        assert df.where(reading.isNotNull()).count() > 50
