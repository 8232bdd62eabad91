"""Pruned top k against sums of all keys, on skewed, flat and odd data."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillroll.operators import topk as T
from tillroll.operators.sales import top_pairs

SCHEMA = "item_name string, business_unit string, sales_inc_tax decimal(18,6)"


def brute(rows, k):
    sums = {}
    for a, b, v in rows:
        if a is not None and b is not None:
            sums[a, b] = sums.get((a, b), 0) + (v or 0)
    return [(*x, float(s)) for x, s in sorted(sums.items(), key=lambda x: (-x[1], x[0]))[:k]]


def check(spark, rows, k, way, buckets=T.BUCKETS):
    df = spark.createDataFrame(rows, SCHEMA)
    keys = ["item_name", "business_unit"]
    got = [tuple(r) for r in T.top_sums(df, keys, k, buckets=buckets).collect()]
    assert got == brute(rows, k) == [tuple(r) for r in top_pairs(df, keys, k).collect()]
    assert T.pruned_sums(df, keys, k, F.col("sales_inc_tax"), buckets)[1] == way


def test_heavy_keys_are_found_among_the_first(spark):
    rng = random.Random(1)
    rows = [(f"i{int(5000 / (1 + rng.randrange(5000)))}", rng.choice("ab"), Decimal(rng.randrange(1, 90))) for _ in range(6000)]
    check(spark, rows, 5, "first")
    check(spark, rows, 5, "first", buckets=4096)


def test_flat_keys_take_the_whole_way(spark):
    rows = [(f"i{i}", "a", Decimal(7)) for i in range(3000)]
    check(spark, rows, 10, "all")


def test_a_heavy_bucket_of_light_keys_needs_a_second_look(spark):
    """Many light keys make the highest buckets; the heavy keys are elsewhere."""
    buckets = 512

    def bucket(name):
        return spark.range(1).select(F.pmod(F.xxhash64(F.lit(name), F.lit("a")), F.lit(buckets))).first()[0]
    names = spark.range(60_000).select(F.concat(F.lit("i"), "id").alias("n")).select(
        "n", F.pmod(F.xxhash64("n", F.lit("a")), F.lit(buckets)).alias("b"))
    crowd = [r["n"] for r in names.where(F.col("b") < T.FIRST * 2).collect()]
    heavy = [r["n"] for r in names.where((F.col("b") > 100) & (F.col("b") < 104)).limit(3).collect()]
    assert bucket(crowd[0]) < T.FIRST * 2
    light = [r["n"] for r in names.where("b > 200").dropDuplicates(["b"]).collect()]
    rows = ([(n, "a", Decimal(10)) for n in crowd] + [(n, "a", Decimal(500)) for n in heavy]
            + [(n, "a", Decimal(1)) for n in light])
    check(spark, rows, 2, "second", buckets)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_ties_nulls_negatives_and_few_keys(spark, k):
    rows = [("a", "x", Decimal(5)), ("b", "x", Decimal(5)), ("c", "x", Decimal(5)), ("d", "x", None), ("d", "x", None),
            (None, "x", Decimal(99)), ("e", None, Decimal(99)), ("f", "x", Decimal(80)), ("f", "x", Decimal(-79)),
            ("g", "x", Decimal(-3)), ("a", "y", Decimal(5))]
    check(spark, rows, k, "first")
    assert T.top_sums(spark.createDataFrame([], SCHEMA), ["item_name"], k).collect() == []


def test_counts_and_a_large_k(spark):
    df = spark.createDataFrame([("a", "x", None)] * 3 + [("b", "x", Decimal(1))] * 2 + [(None, "x", None)] * 9, SCHEMA)
    assert [tuple(r) for r in T.top_counts(df, ["item_name"], 5).collect()] == [("a", 3), ("b", 2)]
    assert T.pruned_sums(df, ["item_name"], T.MAX_K + 1, F.lit(1))[1] == "all"
