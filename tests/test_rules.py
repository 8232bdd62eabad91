"""Keyword rules against testing every rule on every value."""

import random

from pyspark.sql import functions as F

from tillroll.operators import rules as R


def brute(values, rules):
    out = {}
    for v in set(values) - {None}:
        fits = [(p, label) for p, k, label in rules if k and k.lower() in v.lower()]
        if fits:
            out[v] = min(fits)[1]
    return out


def test_thousands_of_rules(spark):
    rng = random.Random(6)
    parts = ["hair", "cut", "color", "spa", "face", "nail", "oil", "été", "İx", "a", "bo", "-", " "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(600)] + [None, ""]
    rules = [(i, "".join(rng.choice("abcefhilnoprstu -") for _ in range(rng.randint(1, 6))), f"L{i % 30}") for i in range(5000)]
    # late rules of real parts, ties of priority, odd ones
    rules += [(9000 + i, rng.choice(parts) + rng.choice(parts).upper(), f"M{i}") for i in range(200)]
    rules += [(4, "hair", "A"), (4, "hair", "B"), (1, "", "never"), (1, "zzzz", "never"), (2, "é", "E")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, item_name string")
    table = spark.createDataFrame([*rules, (0, None, "never")], "priority int, keyword string, label string")
    plain = [(v, x) for v, x in brute([v for v in values if v and "İ" not in v], rules).items()]
    got = {r["item_name"]: r["label"] for r in R.label_values(rows, "item_name", table).collect()}
    assert {v: x for v, x in got.items() if "İ" not in v} == dict(plain) and len(plain) > 300
    out = R.classify_by_rules(rows, "item_name", table, default="none").orderBy("i").collect()
    assert [r["service_type"] for r in out] == [got.get(v, "none") for v in values]
    assert out[0].asDict().keys() == {"i", "item_name", "service_type"}


def test_the_plan_does_not_grow_with_the_rules(spark):
    rows = spark.createDataFrame([("abcd",)], "item_name string")

    def size(n):
        table = spark.range(n).select(F.col("id").alias("priority"), F.concat(F.lit("k"), "id").alias("keyword"), F.lit("x").alias("label"))
        text = R.label_values(rows, "item_name", table)._jdf.queryExecution().optimizedPlan().toString()
        return len(text.splitlines())
    assert size(10) == size(5000)


def test_empty_sides(spark):
    rows = spark.createDataFrame([("abcd",), (None,)], "item_name string")
    none = spark.createDataFrame([], "priority int, keyword string, label string")
    assert [r["service_type"] for r in R.classify_by_rules(rows, "item_name", none, "d").collect()] == ["d", "d"]
    some = spark.createDataFrame([(1, "b", "x")], none.schema)
    assert R.classify_by_rules(rows.limit(0), "item_name", some).collect() == []
