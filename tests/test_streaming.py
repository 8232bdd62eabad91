import os
import tempfile

from pyspark.sql import functions as F

from tillroll.operators.sales import as_double, monthly_outlet
from tillroll.plans.catalog import _raw_text_lines
from tillroll.sources.testbed import sales_lines
from tillroll.streaming.refresh import read_mart, start_mart_refresh

SF = "/root/testdata/sf0.001"


def test_incremental_mart_equals_batch_mart(spark):
    base = tempfile.mkdtemp(prefix="tillroll-stream-")
    src, lines_path, mart_path, ckpt = (os.path.join(base, d) for d in ("in", "lines", "mart", "ckpt"))
    lines = sales_lines(spark, SF, items=False, calendar_parts=False)
    raw = _raw_text_lines(lines)
    early = raw.where(F.col("Sale Date") < "1998-01-01")
    late = raw.where(F.col("Sale Date") >= "1998-01-01")
    # Two arrivals; the second also repeats nothing of the first.
    early.write.option("header", True).csv(os.path.join(src, "a"))
    schema = raw.schema
    q = start_mart_refresh(spark, os.path.join(src, "*"), lines_path, mart_path, ckpt, raw_schema=schema)
    q.awaitTermination()
    late.write.option("header", True).csv(os.path.join(src, "b"))
    q = start_mart_refresh(spark, os.path.join(src, "*"), lines_path, mart_path, ckpt, raw_schema=schema)
    q.awaitTermination()
    got = read_mart(spark, mart_path)
    from tillroll.functions.clean import with_calendar_parts
    want = as_double(monthly_outlet(with_calendar_parts(lines)))
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_replayed_epoch_is_idempotent(spark):
    """A batch retried after a failure (same epoch id) rewrites its own
    folder: lines are not duplicated and the mart is unchanged."""
    from tillroll.streaming.refresh import _refresh_batch
    base = tempfile.mkdtemp(prefix="tillroll-replay-")
    lines_path, mart_path = os.path.join(base, "lines"), os.path.join(base, "mart")
    raw = _raw_text_lines(sales_lines(spark, SF, items=False, calendar_parts=False))
    _refresh_batch(spark, raw, 0, lines_path, mart_path, "inc_tax")
    first = read_mart(spark, mart_path).collect()
    _refresh_batch(spark, raw, 0, lines_path, mart_path, "inc_tax")
    assert spark.read.parquet(lines_path).count() == raw.count()
    assert sorted(map(tuple, read_mart(spark, mart_path).collect())) == sorted(map(tuple, first))


def test_batch_reads_only_the_months_it_touches(spark):
    """A file of another month that cannot be read does not concern it; a month
    of an earlier batch is recomputed from the lines of both."""
    from tillroll.streaming.refresh import _refresh_batch
    base = tempfile.mkdtemp(prefix="tillroll-months-")
    lines_path, mart_path = os.path.join(base, "lines"), os.path.join(base, "mart")

    def batch(epoch, *dates):
        raw = spark.createDataFrame([(d, str(i), "X", "B", "$10") for i, d in enumerate(dates, 10 * epoch)],
                                    ["Sale Date", "Invoice No", "Center Name", "Business Unit", "Sales Collected (Inc.Tax)"])
        _refresh_batch(spark, raw, epoch, lines_path, mart_path, "inc_tax")
    batch(0, "2024-01-05", "2024-02-06", "2023-02-06")
    with open(os.path.join(lines_path, "year=2024", "month=January", "batch=0", "broken.parquet"), "w") as f:
        f.write("no parquet")
    batch(1, "2024-02-07", "2024-03-08")
    got = sorted((r["year"], r["month"], r["mtd_sales"], r["mtd_bills"]) for r in read_mart(spark, mart_path).collect())
    assert got == [("2023", "February", 10.0, 1), ("2024", "February", 20.0, 2), ("2024", "January", 10.0, 1), ("2024", "March", 10.0, 1)]
    batch(2, "no date")  # nothing touched
    assert read_mart(spark, mart_path).count() == 4
