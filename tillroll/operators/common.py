"""Shared relational building blocks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import MEASURES
from ..session import cut_lineage

ALL = "All"

# Most distinct values that become pivot columns (the long form has no limit).
MAX_PIVOT_VALUES = 1_000


def measure_col(measure: str) -> str:
    """'inc_tax' / 'exc_tax' (or a column name) -> the sale-line column."""
    return MEASURES.get(measure, measure)


def not_null(keys: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def sum_by(df: DataFrame, keys: list[str], measure: str, alias: str,
           exact: bool = False) -> DataFrame:
    """Group-by sum with dataframe-library semantics: NULL keys are dropped and
    an all-NULL group sums to 0. Money sums are DECIMAL (exact, order
    independent); ``exact=True`` keeps them DECIMAL for further roll-ups,
    otherwise they are cast to DOUBLE."""
    total = F.coalesce(F.sum(measure_col(measure)), F.lit(0))
    return (df.where(not_null(keys)).groupBy(*keys)
            .agg((total if exact else total.cast("double")).alias(alias)))


def _year_ranges(years) -> Column | None:
    """sale_date range predicate equivalent to ``year IN years`` (None if a
    value is not a year number)."""
    try:
        ys = sorted({int(y) for y in years})
    except (TypeError, ValueError):
        return None
    if not ys or ys[0] < 1 or ys[-1] > 9998:
        return None
    return reduce(lambda a, b: a | b, [
        (F.col("sale_date") >= F.lit(dt.date(y, 1, 1))) & (F.col("sale_date") < F.lit(dt.date(y + 1, 1, 1)))
        for y in ys])


def apply_filters(df: DataFrame, filters: Mapping[str, object] | None) -> DataFrame:
    """Equality / IN filters; a value of None or 'All' means no filter.

    A filter on a column that is absent is an error, not a no-op (a year
    filter may also act on ``sale_date``). Expressed as plain predicates so they push down to the scan. A ``year``
    filter on rows that carry ``sale_date`` also gets the equivalent date
    range, which Parquet can use to skip row groups (the year text itself is
    an expression the scan cannot use).
    """
    for column, value in (filters or {}).items():
        if value is None or value == ALL:
            continue
        values = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        if column == "year" and "sale_date" in df.columns:
            ranges = _year_ranges(values)
            if ranges is not None:
                df = df.where(ranges)
                if column not in df.columns:
                    continue
        if column not in df.columns:
            raise ValueError(f"cannot filter on {column!r}: the columns are {df.columns}")
        if len(values) == 1:
            df = df.where(F.col(column) == F.lit(values[0]))
        else:
            df = df.where(F.col(column).isin(values))
    return df


def select_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Keep only the listed columns that exist, in the listed order."""
    return df.select(*[c for c in columns if c in df.columns])


def row_count_at_most(df: DataFrame, limit: int) -> bool:
    """True when ``df`` has at most ``limit`` rows (reads at most limit+1)."""
    return df.limit(limit + 1).count() <= limit


def distinct_values(df: DataFrame, column: str, limit: int = MAX_PIVOT_VALUES) -> list:
    """Sorted distinct non-NULL values of a low-cardinality column.

    Used only for pivot headers / explode lists; refuses unbounded domains.
    """
    values = (df.where(F.col(column).isNotNull()).select(column).distinct()
              .limit(limit + 1).collect())
    if len(values) > limit:
        raise ValueError(f"{column} has more than {limit} distinct values")
    return sorted(r[0] for r in values)


def dense_sum(df: DataFrame, dim: str, small_dim: str, measure: str, alias: str,
              where: Column | None = None) -> DataFrame:
    """Sum of ``measure`` over rows matching ``where`` for every (dim,
    small_dim) pair of the unfiltered data's categories, zero when nothing
    matches (categorical group-by). The fact rows are aggregated once, with a
    conditional sum; the grid comes from that aggregate inside the plan: the
    second dimension's distinct values are one array, exploded beside each
    value of the first."""
    m = F.col(measure_col(measure))
    cond = m if where is None else F.when(where, m)
    observed = (df.where(not_null([dim, small_dim])).groupBy(dim, small_dim)
                .agg(F.sum(cond).alias(alias)))
    values = observed.select(F.sort_array(F.collect_set(small_dim))).scalar()
    grid = observed.select(dim).distinct().withColumn(small_dim, F.explode(values))
    return (grid.join(observed, [dim, small_dim], "left")
            .select(dim, small_dim, F.coalesce(F.col(alias), F.lit(0)).cast("double").alias(alias)))


def ordinal(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a global order, computed without
    moving all rows into one task: a range-partitioned sort is materialised,
    each partition numbers its own rows, and per-partition row counts (one
    number per partition) give the offsets."""
    pid = "_tr_pid"
    ordered = cut_lineage(df.orderBy(*order).withColumn(pid, F.spark_partition_id()))
    counts = sorted((r[0], r[1]) for r in
                    ordered.groupBy(pid).count().collect())
    offsets, running = [], 0
    for p, n in counts:
        offsets.append((p, running))
        running += n
    spark = df.sparkSession
    offset_df = spark.createDataFrame(offsets or [(0, 0)], f"{pid} int, _tr_offset long")
    local = Window.partitionBy(pid).orderBy(*order)
    return (ordered.withColumn("_tr_local", F.row_number().over(local))
            .join(F.broadcast(offset_df), pid)
            .withColumn(name, (F.col("_tr_offset") + F.col("_tr_local")).cast("long"))
            .drop(pid, "_tr_local", "_tr_offset"))
