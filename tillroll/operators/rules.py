"""Classification by a table of keyword rules.

A few keywords are a CASE expression (``functions.classify``); thousands of
them would be a plan that grows with the rules and tests every rule on every
line. Here the rules are a table. The values of the column are taken apart into
runs of three characters once, each keyword is looked up by the rarest of its
own runs, the pairs found are verified, and the first rule of each value wins.
Lines then meet their value's label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_count_at_most

GRAM = 3
#: Labelled values of up to this many rows are broadcast to the lines.
BROADCAST_ROWS = 100_000


def _grams(text: Column, size: int) -> Column:
    """The distinct runs of ``size`` characters of a text; none for a shorter one."""
    at = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(size))))) \
        .otherwise(F.array().cast("array<string>"))


def label_values(values: DataFrame, column: str, rules: DataFrame) -> DataFrame:
    """(column, label) of the distinct ``values`` that a rule fits: that of the
    smallest ``priority`` (then the smallest label) among the ``rules``
    (priority, keyword, label) whose keyword stands in the value, both in small
    letters. Null values and keywords and empty keywords fit nothing."""
    texts = (values.select(column).where(F.col(column).isNotNull()).distinct()
             .withColumn("_text", F.lower(column)))
    words = (rules.where(F.length("keyword") > 0)
             .groupBy(F.lower("keyword").alias("_word")).agg(F.min(F.struct("priority", "label")).alias("_rule")))
    # keywords of one or two characters are runs of that size themselves
    sizes = range(1, GRAM + 1)
    size = F.least(F.length("_word"), F.lit(GRAM))
    grams = texts.select(column, "_text", F.explode(F.array_distinct(F.flatten(F.array(
        *[_grams(F.col("_text"), n) for n in sizes])))).alias("_gram"))
    often = grams.groupBy("_gram").agg(F.count("*").alias("_often"))
    own = F.when(size == 1, _grams(F.col("_word"), 1)).when(size == 2, _grams(F.col("_word"), 2)).otherwise(_grams(F.col("_word"), 3))
    # a run that no value has means that the keyword is in none
    keyed = (words.select("_word", "_rule", F.explode(own).alias("_gram"))
             .join(often, "_gram", "left").groupBy("_word", "_rule")
             .agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_gram")).alias("_g"))
             .where(F.col("_g.n") > 0).select("_word", "_rule", F.col("_g._gram").alias("_gram")))
    return (grams.join(keyed, "_gram").where(F.contains("_text", "_word"))
            .groupBy(column).agg(F.min("_rule").alias("_rule")).select(column, F.col("_rule.label").alias("label")))


def classify_by_rules(lines: DataFrame, column: str, rules: DataFrame, default: str = "Other Services",
                      name: str = "service_type") -> DataFrame:
    """The lines with the label of their ``column`` as ``name``; ``default``
    where no rule fits or the value is null. Every line stays."""
    labels = label_values(lines, column, rules).withColumnRenamed(column, "_value")
    if row_count_at_most(labels, BROADCAST_ROWS):
        labels = F.broadcast(labels)
    return (lines.join(labels, F.col(column) == F.col("_value"), "left")
            .withColumn(name, F.coalesce("label", F.lit(default))).drop("_value", "label"))
