"""Storage layout for repeated queries: co-located (bucketed) line and order tables.

Every dashboard query joins the line table to its order-level dimensions on
the order key. Written once as tables bucketed (and sorted) by that key into
the same number of buckets, the join reads matching buckets side by side:
no shuffle of the line table at query time, and each bucket's rows arrive
sorted for the merge join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .testbed import canonical_lines, line_items, order_dimensions, table


def write_bucketed(df: DataFrame, name: str, keys: list[str], buckets: int,
                   path: str | None = None) -> str:
    """Save ``df`` as a table bucketed and sorted by ``keys``."""
    w = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)
    return name


def bucket_lines_and_orders(spark: SparkSession, sf_dir: str, buckets: int,
                            prefix: str = "tillroll", location: str | None = None) -> tuple[str, str]:
    """Write ``lineitem`` and the order-level dimensions (orders ⋈ customer ⋈
    nation) bucketed by order key; returns the two table names."""
    li = line_items(spark, sf_dir)
    dims = order_dimensions(spark, sf_dir)
    names = (f"{prefix}_lines", f"{prefix}_order_dims")
    write_bucketed(li, names[0], ["l_orderkey"], buckets,
                   f"{location.rstrip('/')}/{names[0]}" if location else None)
    write_bucketed(dims, names[1], ["o_orderkey"], buckets,
                   f"{location.rstrip('/')}/{names[1]}" if location else None)
    return names


def co_located_lines(spark: SparkSession, lines_table: str, dims_table: str) -> DataFrame:
    """Line rows joined to their order dimensions, bucket by bucket."""
    li = spark.table(lines_table)
    dims = spark.table(dims_table)
    return li.join(dims, li.l_orderkey == dims.o_orderkey, "inner")


def co_located_sales_lines(spark: SparkSession, lines_table: str, dims_table: str,
                           sf_dir: str | None = None, items: bool = True) -> DataFrame:
    """Canonical sale lines from the bucketed tables (item columns from the
    ``part`` table of ``sf_dir`` when ``items``)."""
    part = table(spark, sf_dir, "part") if items and sf_dir else None
    return canonical_lines(co_located_lines(spark, lines_table, dims_table), part)
