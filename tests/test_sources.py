import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillroll.schemas import RAW_SALES_TEXT, SERVICE_MART
from tillroll.sources import files as FS
from tillroll.sources.jdbc import year_predicates


def fresh(name):
    return os.path.join(tempfile.mkdtemp(prefix="tillroll-test-"), name)


def test_csv_round_trip_by_header_name(spark):
    df = spark.createDataFrame([("2024-01-05", "A1", "₹10")],
                               "`Sale Date` string, `Invoice No` string, `Sales Collected (Inc.Tax)` string")
    path = FS.write_table(df, fresh("sales.csv"), "csv")
    back = FS.read_table(spark, path, RAW_SALES_TEXT)
    r = back.first()
    assert back.columns == RAW_SALES_TEXT.fieldNames()
    assert (r["Sale Date"], r["Invoice No"], r["Sales Collected (Inc.Tax)"], r["Center Name"]) == \
        ("2024-01-05", "A1", "₹10", None)


def test_missing_and_unsupported(spark):
    with pytest.raises(FileNotFoundError):
        FS.read_table(spark, fresh("nothing.parquet"))
    with pytest.raises(ValueError):
        FS.read_table(spark, fresh("x.docx"))
    assert FS.format_of("a/b/C.PARQUET") == "parquet"


def test_exists_list_and_marts(spark):
    path = fresh("mart")
    assert not FS.path_exists(spark, path)
    empty = FS.load_mart(spark, path, SERVICE_MART)
    assert empty.count() == 0 and empty.schema == SERVICE_MART
    build = lambda: spark.createDataFrame(
        [("C", 2024, "Service", "Hair", "x", "y", "z", 1.5, 2)],
        "center_name string, year int, category string, service_type string, item_category string, "
        "item_subcategory string, business_unit string, total_sales double, transaction_count long")
    assert FS.ensure_mart(spark, path, build, partition_by=["year"])["status"] == "processed"
    assert FS.ensure_mart(spark, path, build)["status"] == "exists"
    back = FS.load_mart(spark, path, SERVICE_MART).first()
    assert back["year"] == "2024" and back["transaction_count"] == 2
    listed = FS.list_files(spark, path, "*.parquet")
    assert listed.count() >= 1 and listed.columns == ["path", "length", "modificationTime"]


def test_upsert_incoming_wins(spark):
    cur = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    new = spark.createDataFrame([("b", 20.0), ("c", 30.0)], "k string, v double")
    out = sorted(tuple(r) for r in FS.upsert(cur, new, ["k"]).collect())
    assert out == [("a", 1.0), ("b", 20.0), ("c", 30.0)]


def test_preprocess_monthly_sheet(spark):
    sheet = spark.createDataFrame([(2024, "March", "₹1,000", "12", "$83.3"), (2024, "Foo", "x", None, "")],
                                  "Year int, Month string, `MTD SALES` string, `MTD BILLS` string, `MTD ABV` string")
    out = [tuple(r) for r in FS.preprocess_monthly_sheet(sheet).collect()]
    assert out == [("2024", "March", 1000.0, 12.0, 83.3, 3), ("2024", "Foo", None, None, None, 0)]


def test_jdbc_predicates_of_months():
    preds = year_predicates([2020], "d", months=3)
    ends = ["2020-01-01", "2020-04-01", "2020-07-01", "2020-10-01", "2021-01-01"]
    assert preds == [f"\"d\" >= DATE '{a}' AND \"d\" < DATE '{b}'" for a, b in zip(ends, ends[1:])]
    assert len(year_predicates([2020, 2021], months=1)) == 24
    with pytest.raises(ValueError):
        year_predicates([2020], months=5)


def test_jdbc_year_predicates():
    preds = year_predicates([2020, 2021])
    assert preds == ["\"sale_date\" >= DATE '2020-01-01' AND \"sale_date\" < DATE '2021-01-01'",
                     "\"sale_date\" >= DATE '2021-01-01' AND \"sale_date\" < DATE '2022-01-01'"]


def test_load_all(spark):
    df = spark.createDataFrame([("2024-01-05", "A1", "T NAGAR", "₹10")],
                               "`Sale Date` string, `Invoice No` string, `Center Name` string, "
                               "`Sales Collected (Inc.Tax)` string")
    path = FS.write_table(df, fresh("s.csv"), "csv")
    data = FS.load_all(spark, path)
    r = data.sales.first()
    assert (r.year, r.month, float(r.sales_inc_tax)) == ("2024", "January", 10.0)
    assert data.calendar.count() == 53
    assert data.calendar.where(F.col("holiday_date").isNull()).count() == 0


def test_incomplete_mart_is_rebuilt(spark):
    path = fresh("partial")
    os.makedirs(os.path.join(path, "_temporary"))          # left by an interrupted job
    assert FS.path_exists(spark, path) and not FS.is_complete(spark, path)
    assert FS.load_mart(spark, path, SERVICE_MART).count() == 0
    build = lambda: spark.createDataFrame(
        [("C", "2024", "Service", "Hair", "x", "y", "z", 1.5, 2)], SERVICE_MART)
    assert FS.ensure_mart(spark, path, build)["status"] == "processed"
    assert FS.ensure_mart(spark, path, build)["status"] == "exists"
    assert FS.load_mart(spark, path, SERVICE_MART).count() == 1


def test_write_mart_replaces(spark):
    path = fresh("mart_w")
    FS.write_mart(spark.createDataFrame([(1, "2024")], "v int, year string"), path, partition_by=["year"])
    FS.write_mart(spark.createDataFrame([(2, "2025")], "v int, year string"), path, partition_by=["year"])
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(2, 2025)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_format_dispatch_round_trip(spark, fmt):
    from pyspark.sql import types as T
    df = spark.createDataFrame([("A", 1.5), ("B", None)], "k string, v double")
    path = FS.write_table(df, fresh(f"t.{fmt}"), fmt)
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.DoubleType())])
    back = FS.read_table(spark, path, schema if fmt == "json" else None)
    assert sorted(tuple(r) for r in back.select("k", "v").collect()) == [("A", 1.5), ("B", None)]
    with pytest.raises(FileNotFoundError):
        FS.read_table(spark, fresh(f"none.{fmt}"))


def test_csv_without_schema_infers_types(spark):
    df = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    path = FS.write_table(df, fresh("infer.csv"), "csv")
    back = FS.read_table(spark, path)
    assert dict(back.dtypes) == {"a": "int", "b": "double", "c": "string"}


def test_upsert_incoming_may_lack_columns(spark):
    cur = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, v double, note string")
    new = spark.createDataFrame([("b", 20.0)], "k string, v double")
    out = sorted(tuple(r) for r in FS.upsert(cur, new, ["k"]).collect())
    assert out == [("a", 1.0, "x"), ("b", 20.0, "y")]


def test_upsert_new_columns_and_repeated_keys(spark):
    cur = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, v double, note string")
    new = spark.createDataFrame([("b", None, 7), ("c", 3.0, 8), ("c", 2.0, 9)], "k string, v double, n int")
    out = FS.upsert(cur, new, ["k"])
    assert out.columns == ["k", "v", "note", "n"]
    assert sorted(tuple(r) for r in out.collect()) == [
        ("a", 1.0, "x", None), ("b", None, "y", 7), ("c", 3.0, None, 8)]


def test_csv_keeps_quotes_commas_and_line_breaks(spark):
    rows = [('12" brush, big', "1"), ('say ""x""', "2"), ("two\nlines", "3"), ("back\\slash", "4")]
    path = FS.write_table(spark.createDataFrame(rows, "name string, v string"), fresh("q.csv"), "csv")
    back = FS.read_table(spark, path, multiline=True, text=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)


def _dated(spark, days):
    """A table with n rows a day, some without a date or a number."""
    rows = [(d, i) for d, n in days for i in range(n)] + [(None, 1), (None, None)] + [(days[0][0], None)]
    return spark.createDataFrame(rows, "sale_date date, invoice_no int")


def _sizes(df, predicates):
    """Rows of each predicate, as the database would give them."""
    parts = [df.where(p.replace('"', "`")) for p in predicates]
    sizes = [p.count() for p in parts]
    assert sum(sizes) == df.count()
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    assert sorted(map(str, whole.collect())) == sorted(map(str, df.collect()))  # each row once
    return sizes


@pytest.mark.parametrize("parts", [1, 4, 10])
def test_balanced_predicates_read_each_row_once_in_like_parts(spark, parts):
    import datetime as dt

    from tillroll.sources.jdbc import balanced_predicates
    # one busy month among quiet years, and days without rows
    days = [(dt.date(2020, 1, 1) + dt.timedelta(days=3 * i), 30 if 200 <= i < 212 else 1 + i % 4) for i in range(400)]
    df = _dated(spark, days)
    sizes = _sizes(df, balanced_predicates(days, parts))
    dated = sizes[:-1]
    assert sizes[-1] == 2 and abs(len(dated) - parts) <= max(1, parts // 4)
    assert max(dated) <= 2 * min(dated)


def test_balanced_predicates_split_a_heavy_day(spark):
    import datetime as dt

    from tillroll.sources.jdbc import balanced_predicates
    day = dt.date(2024, 3, 1)
    days = [(day + dt.timedelta(days=i), 900 if i == 5 else 40) for i in range(20)]
    df = _dated(spark, days)
    whole = _sizes(df, balanced_predicates(days, 8))
    assert max(whole) >= 900
    sizes = _sizes(df, balanced_predicates(days, 8, split_col="invoice_no"))
    assert max(sizes[:-1]) <= 2 * min(sizes[:-1])


def test_balanced_predicates_of_nothing_and_late_days(spark):
    import datetime as dt

    from tillroll.sources.jdbc import balanced_predicates
    assert balanced_predicates([], 4) == ['"sale_date" IS NOT NULL', '"sale_date" IS NULL']
    counted = [(dt.date(2024, 1, d), 10) for d in range(5, 25)]
    came_later = [(dt.date(2023, 12, 31), 3), *counted, (dt.date(2024, 2, 2), 3)]
    _sizes(_dated(spark, came_later), balanced_predicates(counted, 4))
