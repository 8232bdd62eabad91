"""A mart kept by signed changes against a rebuild from the lines that are left."""

import datetime as dt
import random
from collections import defaultdict
from decimal import Decimal

import pytest

from tillroll.operators import delta as D
from tillroll.operators.bills import bill_mart, distinct_bills
from tillroll.operators.sales import monthly_outlet
from tillroll.session import scratch_path

SCHEMA = "sale_date date, invoice_no string, center_name string, business_unit string, sales_inc_tax decimal(18,6)"


def frame(spark, rows, sign=True):
    return spark.createDataFrame(rows, SCHEMA + (", sign int" if sign else ""))


def mart(df):
    return sorted((r["year"], r["month"], r["outlet_name"], r["brand"], Decimal(r["mtd_sales"]), r["mtd_bills"], r["mtd_abv"])
                  for r in df.collect())


def random_line(rng):
    return (dt.date(2024, rng.randint(1, 4), rng.randint(1, 28)), rng.choice([None, *(f"b{i}" for i in range(40))]),
            rng.choice("XYZ"), rng.choice(["p", None]), Decimal(rng.randrange(500)))


def test_batches_equal_a_rebuild(spark):
    rng, held = random.Random(8), []
    path = scratch_path(spark, "state")
    for batch in range(1, 5):
        back = rng.sample(held, len(held) // 3)
        new = [random_line(rng) for _ in range(60)]
        # corrections: taken back, and again with another amount
        again = [(*x[:4], x[4] + 1) for x in back[::2]]
        for x in back:
            held.remove(x)
        held += new + again
        wrote = D.merge_changes(spark, path, frame(spark, [(*x, 1) for x in new + again] + [(*x, -1) for x in back]), batch)
        assert wrote
        state = D.read_state(spark, path)
        assert mart(D.mart_of(state)) == mart(monthly_outlet(frame(spark, held, False)))
        # merged again after a failure: nothing happens twice
        assert D.merge_changes(spark, path, frame(spark, [(*x, 1) for x in new]), batch) == []
    assert mart(D.mart_of(D.read_state(spark, path))) == mart(monthly_outlet(frame(spark, held, False)))
    assert distinct_bills(bill_mart(frame(spark, held, False))).first()[0] == len({x[1] for x in held} - {None})


def test_only_touched_months_are_written(spark):
    path = scratch_path(spark, "state")
    rows = [(dt.date(2024, m, 5), f"b{m}", "X", "p", Decimal(m), 1) for m in (1, 2, 3)]
    assert len(D.merge_changes(spark, path, frame(spark, rows), 1)) == 3
    files = lambda: set(D.read_state(spark, path).inputFiles())
    before = files()
    assert D.merge_changes(spark, path, frame(spark, [(dt.date(2024, 2, 9), "c", "X", "p", Decimal(7), 1)]), 2) == [("2024", "February")]
    kept = {f for f in before if "February" not in f}
    assert kept and kept <= files()
    text = D.read_state(spark, path).where("year = '2024' AND month = 'February'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in text


def test_a_month_taken_back_whole(spark):
    path = scratch_path(spark, "state")
    row = (dt.date(2024, 1, 5), "b", "X", "p", Decimal(3))
    D.merge_changes(spark, path, frame(spark, [(*row, 1)] * 2), 1)
    D.merge_changes(spark, path, frame(spark, [(*row, -1)]), 2)
    assert mart(D.mart_of(D.read_state(spark, path))) == [("2024", "January", "X", "p", Decimal(3), 1, 3.0)]
    D.merge_changes(spark, path, frame(spark, [(*row, -1)]), 3)
    assert D.mart_of(D.read_state(spark, path)).collect() == []
    D.merge_changes(spark, path, frame(spark, [(*row, 1)]), 4)
    assert len(mart(D.mart_of(D.read_state(spark, path)))) == 1


def test_no_state_and_no_changes(spark):
    path = scratch_path(spark, "state")
    assert D.mart_of(D.read_state(spark, path)).collect() == []
    assert D.merge_changes(spark, path, frame(spark, []), 1) == []
    late = frame(spark, [(dt.date(2024, 1, 5), "b", "X", "p", Decimal(3), 1)])
    assert D.merge_changes(spark, path, late, 7) == [("2024", "January")]
    # an earlier number comes too late for the month
    assert D.merge_changes(spark, path, late, 3) == []


def test_signs_add_up_by_invoice(spark):
    """An invoice with one line taken back still counts."""
    sums = defaultdict(int)
    path = scratch_path(spark, "state")
    rows = [(dt.date(2024, 1, 5), "b", "X", "p", Decimal(v), s) for v, s in ((5, 1), (7, 1), (5, -1))]
    for r in rows:
        sums["X"] += r[4] * r[5]
    D.merge_changes(spark, path, frame(spark, rows), 1)
    got = D.mart_of(D.read_state(spark, path)).first()
    assert (got["mtd_sales"], got["mtd_bills"]) == (pytest.approx(sums["X"]), 1)
