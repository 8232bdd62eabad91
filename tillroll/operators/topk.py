"""Exact top k of a sum over many keys, without moving the sums of all keys.

A summary of fixed length comes first: the sums of the positive amounts by hash
bucket of the key. Such sums of parts of the data add up, and a bucket's sum is
at least the sum of any of its keys. The keys of the few highest buckets are
then summed exactly; the k-th of these is a threshold, and no key of a bucket
below it can be among the top k. Where some buckets not yet looked at reach the
threshold, their keys are summed too; where these are too many, as on data
without heavy keys, all keys are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import apply_filters, measure_col, not_null

#: Length of the summary; a row a bucket and task is dealt out.
BUCKETS = 1 << 16
#: Buckets looked at first, by rank wanted.
FIRST = 8
#: Largest k that is pruned, and the largest share of the buckets that is worth
#: a pass of its own.
MAX_K = 1_000
WORTH = 0.25


def _sums(src: DataFrame, keys: list[str]) -> DataFrame:
    return src.groupBy(*keys).agg(F.coalesce(F.sum("_v"), F.lit(0)).alias("_sum"))


def pruned_sums(lines: DataFrame, keys: list[str], k: int, value: Column,
                buckets: int = BUCKETS) -> tuple[DataFrame, str]:
    """(keys, ``_sum``) of keys that hold all of the top ``k`` sums, ties of
    the k-th too, and the way it went: ``first`` (the highest buckets were
    enough), ``second`` (some more were looked at) or ``all``.

    Keys with a null part are left out; null values add nothing, and a key of
    null values sums to 0. Values below 0 lower a key's sum, not its bucket's
    bound. The summary and the sums of the first buckets' keys are stored while
    the frame is built."""
    src = lines.where(not_null(keys)).select(*keys, value.alias("_v"))
    if not 1 <= k <= MAX_K:
        return _sums(src, keys), "all"
    src = src.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    bounds = cut_lineage(src.groupBy("_b").agg(F.sum(F.greatest("_v", F.lit(0))).alias("_most"))
                         .select("_b", F.coalesce("_most", F.lit(0)).alias("_most")))
    first = [r["_b"] for r in bounds.orderBy(F.desc("_most"), "_b").limit(FIRST * k).select("_b").collect()]
    summed = cut_lineage(_sums(src.where(F.col("_b").isin(first)), keys))
    top = summed.orderBy(F.desc("_sum")).limit(k).agg(F.count("*").alias("n"), F.min("_sum").alias("least")).first()
    rest = bounds.where(~F.col("_b").isin(first))
    if top["n"] == k:
        rest = rest.where(F.col("_most") >= F.lit(top["least"]))
    more, held = rest.count(), bounds.count()
    if more == 0:
        return summed, "first"
    if top["n"] < k or more > WORTH * held:
        return _sums(src, keys), "all"
    # at most WORTH of the buckets, a number each
    return summed.unionByName(_sums(src.join(F.broadcast(rest.select("_b")), "_b", "left_semi"), keys)), "second"


def top_sums(lines: DataFrame, keys: list[str], k: int, measure: str = "inc_tax", filters=None,
             buckets: int = BUCKETS) -> DataFrame:
    """The k key combinations with the largest sales (ties by the keys), as
    ``sales.top_pairs`` gives them, for keys of many values."""
    sums, _ = pruned_sums(apply_filters(lines, filters), keys, k, F.col(measure_col(measure)), buckets)
    return (sums.select(*keys, F.col("_sum").cast("double").alias("sales"))
            .orderBy(F.desc("sales"), *keys).limit(k))


def top_counts(lines: DataFrame, keys: list[str], k: int, filters=None, buckets: int = BUCKETS) -> DataFrame:
    """The k key combinations with the most lines (ties by the keys)."""
    sums, _ = pruned_sums(apply_filters(lines, filters), keys, k, F.lit(1).cast("long"), buckets)
    return (sums.select(*keys, F.col("_sum").alias("count")).orderBy(F.desc("count"), *keys).limit(k))
