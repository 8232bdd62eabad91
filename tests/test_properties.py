"""Property tests: formatters against Python's own formatting, dense vs sparse."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.functions import money as M


def python_indian(amount):
    """Independent Python rendering: group the integer part 3 then 2-2-2."""
    if amount is None or amount == 0:
        return "₹0"
    n = int(round(amount))
    sign, digits = ("-", str(-n)) if n < 0 else ("", str(n))
    head, tail = digits[:-3], digits[-3:]
    groups = []
    while head:
        groups.insert(0, head[-2:])
        head = head[:-2]
    return "₹" + sign + ",".join(groups + [tail])


finite = st.floats(min_value=-1e13, max_value=1e13, allow_nan=False, allow_infinity=False)


@settings(max_examples=5, deadline=None)
@given(st.lists(finite, min_size=200, max_size=400))
def test_money_matches_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(M.money("x")).collect()]
    assert got == [python_indian(v) for v in values]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e6, max_value=1e6, allow_nan=False), min_size=200, max_size=400))
def test_percentage_and_lakhs_match_python(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [tuple(r) for r in df.select(M.percentage("x"), M.money("x", "lakhs")).collect()]
    want = [(f"{v:.2f}%", "₹0" if v == 0 else f"₹{v / 100000:.2f} Lakhs") for v in values]
    assert got == want


def test_dense_contains_sparse_with_equal_sums(spark, lines):
    from tillroll.operators.common import dense_sum, sum_by
    chosen = F.col("item_category") == "Brand#1"
    dense = dense_sum(lines, "center_name", "year", "inc_tax", "sales", chosen)
    sparse = sum_by(lines.where(chosen), ["center_name", "year"], "inc_tax", "sales")
    assert sparse.join(dense, ["center_name", "year"], "left_anti").count() == 0
    assert dense.count() >= sparse.count()
    d, s = dense.agg(F.sum("sales")).first()[0], sparse.agg(F.sum("sales")).first()[0]
    assert abs(d - s) < 1e-6


def python_service_type(item_type, cat, sub, name, keywords):
    """The classification rule stated directly in Python (test oracle)."""
    if item_type == "Product":
        return "Product"
    fields = [(v or "").lower() for v in (cat, sub, name)]
    for label, *word_lists in keywords:
        if any(w in f for f, words in zip(fields, word_lists) for w in words):
            return label
    return "Other Services"


_vocab = ["Hair", "HAIRCUT", "color", "Cut", "style", "BlowDry", "facial", "Skin", "face",
          "cleanup", "Spa", "massage", "Therapy", "nail", "wax", "pedi", "", "x"]
_field = st.one_of(st.none(), st.lists(st.sampled_from(_vocab), min_size=1, max_size=3)
                   .map(" ".join))
_row = st.tuples(st.sampled_from(["Product", "Service", "product", None]), _field, _field, _field)


@settings(max_examples=5, deadline=None)
@given(st.lists(_row, min_size=100, max_size=200))
def test_classifier_matches_rule(spark, rows):
    from tillroll.functions.classify import service_type
    from tillroll.schemas import SERVICE_KEYWORDS
    df = spark.createDataFrame(rows, "item_type string, item_category string, "
                                     "item_subcategory string, item_name string")
    got = [r[0] for r in df.select(service_type()).collect()]
    assert got == [python_service_type(*r, SERVICE_KEYWORDS) for r in rows]
