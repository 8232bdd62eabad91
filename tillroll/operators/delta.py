"""A monthly mart kept up to date by signed changes.

The state has a row a mart row and invoice: the number of its lines and the sum
of their sales. Changes are lines with a sign, 1 for a line that is new and -1
for one taken back; a corrected line is taken back and comes again. Sums and
counts of both add up, so only the months that a batch of changes touches are
read, merged and written. The mart follows from the state of these months: its
bills are the invoices with lines left.

Each month keeps the number of the batch that was merged last. A batch that is
merged again after a failure passes over the months that have it already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.files import path_exists
from .common import measure_col, not_null
from .sales import abv, keyed_lines

KEYS = ["year", "month", "outlet_name", "brand"]
STATE = "outlet_name string, brand string, invoice_no string, lines long, sales decimal(38,6), batch long, year string, month string"


def state_changes(changes: DataFrame, measure: str = "inc_tax", sign: str = "sign") -> DataFrame:
    """Changes by mart row and invoice; a null invoice is one of its own."""
    m = measure_col(measure)
    keyed, keys, labels = keyed_lines(changes)
    return (keyed.where(not_null(keys)).groupBy(*keys, F.col("invoice_no").cast("string").alias("invoice_no"))
            .agg(F.sum(F.col(sign).cast("long")).alias("lines"),
                 F.coalesce(F.sum(F.col(m) * F.col(sign)), F.lit(0)).cast("decimal(38,6)").alias("sales"))
            .select(*labels, "outlet_name", "brand", "invoice_no", "lines", "sales"))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The stored state; empty before the first batch. Invoices whose lines
    were all taken back stay with no lines."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(path)


def merge_changes(spark: SparkSession, path: str, changes: DataFrame, batch: int, measure: str = "inc_tax",
                  sign: str = "sign") -> list[tuple[str, str]]:
    """Merges a batch of changes into the state at ``path`` and returns the
    (year, month) pairs that it wrote. Batches are numbered upwards; months
    that hold this or a later number are passed over. Changes may be empty.

    The months of a batch are a short list (twelve a year); they pick the
    partitions that are read. The merged rows are stored before the partitions
    are replaced, each as a whole."""
    fresh = cut_lineage(state_changes(changes, measure, sign).withColumn("batch", F.lit(batch).cast("long")))
    touched = [(r["year"], r["month"]) for r in fresh.select("year", "month").distinct().collect()]
    if not touched:
        return []
    months = lambda pairs: F.concat_ws(" ", "year", "month").isin([f"{y} {m}" for y, m in pairs])
    pruned = lambda df, pairs: df.where(F.col("year").isin(sorted({y for y, _ in pairs}))
                                        & F.col("month").isin(sorted({m for _, m in pairs})) & months(pairs))
    stored = pruned(read_state(spark, path), touched)
    done = {(r["year"], r["month"]) for r in stored.groupBy("year", "month").agg(F.max("batch").alias("b"))
            .where(F.col("b") >= batch).collect()}
    todo = [p for p in touched if p not in done]
    if not todo:
        return []
    merged = cut_lineage(
        pruned(stored, todo).unionByName(pruned(fresh, todo))
        .groupBy(*KEYS, "invoice_no").agg(F.sum("lines").alias("lines"), F.sum("sales").cast("decimal(38,6)").alias("sales"))
        .withColumn("batch", F.lit(batch).cast("long")))
    (merged.select(*[c.split()[0] for c in STATE.split(", ")])
     .repartition("year", "month", F.pmod(F.xxhash64("invoice_no"), F.lit(8)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path))
    return sorted(todo)


def mart_of(state: DataFrame) -> DataFrame:
    """The monthly mart of a state, as ``sales.monthly_outlet`` gives it from
    the lines that are left."""
    rows = state.groupBy(*KEYS).agg(
        F.sum("sales").alias("mtd_sales"), F.sum("lines").alias("_lines"),
        F.count_if((F.col("lines") > 0) & F.col("invoice_no").isNotNull()).alias("mtd_bills"))
    return (rows.where(F.col("_lines") > 0).drop("_lines")
            .withColumn("mtd_abv", abv("mtd_sales", "mtd_bills")))
