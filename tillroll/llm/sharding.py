"""Sharding by extendible hashing.

A row's hash is the first 60 bits of an MD5 of its id. The directory starts as
one bucket; a bucket over the byte limit is split on its next hash bit, until
every shard fits. Sizes are summed once by the first ``cell_bits`` bits and
rolled up to every shorter prefix, so all splits of that depth come from one
pass; only rows of cells that are still too large are read again, with more
bits. Rows that no bit tells apart (repeated ids) are cut by running size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

HASH_BITS = 60
CELL_BITS = 16
#: Bytes of a shard; small, so that the test tables split too.
LIMIT = 1 << 20


def _prefix(bits: int):
    return F.shiftright(F.col("hash"), HASH_BITS - bits)


def shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
           cell_bits: int = CELL_BITS) -> DataFrame:
    """(id_col, n_bytes long, shard string, shard_bytes long), a row a row of
    ``docs``; n_bytes is the text's UTF-8 length, and shard the hash prefix in
    bits (empty: the only shard).

    Null and empty texts have 0 bytes. Rows of one id (or a null id) have one
    hash: where they alone are over the limit they are cut into runs, "-0",
    "-1", ..., by running size in the order of their text's MD5. A single row
    larger than the limit has a run of its own. An empty table gives an empty
    result; other columns are ignored."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_md5")))
    placed, left, base = [], rows, 0
    while True:
        bits = min(base + cell_bits, HASH_BITS)
        cells = left.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        sums = (cells.select("cell", "bytes", F.explode(F.sequence(F.lit(base), F.lit(bits))).alias("depth"))
                .withColumn("prefix", F.expr(f"shiftright(cell, {bits} - depth)")))
        # the shallowest prefix of a cell that fits is its shard
        fits = (sums.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"))
                .where(F.col("shard_bytes") <= limit))
        directory = cut_lineage(sums.join(fits, ["depth", "prefix"]).groupBy("cell").agg(
            F.min(F.struct("depth", "prefix", "shard_bytes")).alias("s")).select("cell", "s.*"))
        keyed = left.withColumn("cell", _prefix(bits))
        name = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
        placed.append(keyed.join(directory, "cell").select("__id", "n_bytes", name.alias("shard"), "shard_bytes"))
        left = cut_lineage(keyed.join(directory, "cell", "left_anti").select(*rows.columns))
        base = bits
        if left.isEmpty():
            break
        if bits == HASH_BITS:
            placed.append(_runs(left, limit))
            break
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed("__id", id_col)


def _runs(left: DataFrame, limit: int) -> DataFrame:
    """Rows of equal hashes over the limit, cut by running size: a run closes
    before the row that would pass a multiple of half the limit, so a run holds
    at most the limit unless it is one row. Rows of a hash are summed in
    sub-cells of their text's hash first, so no task orders all of a hash."""
    sub = F.substring("text_md5", 1, 3)
    cell = left.groupBy("hash", sub.alias("sub")).agg(F.sum("n_bytes").alias("b"))
    before = Window.partitionBy("hash").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    start = cell.select("hash", "sub", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("hash", "sub").orderBy("text_md5", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    half = max(1, limit // 2)
    big = F.col("n_bytes") > half
    offset = F.col("before") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0))
    number = F.when(big, F.concat(F.lit("b"), offset.cast("string"))).otherwise(
        F.floor(offset / half).cast("string"))
    named = (left.withColumn("sub", sub).join(start, ["hash", "sub"])
             .withColumn("shard", F.concat(F.lpad(F.bin("hash"), HASH_BITS, "0"), F.lit("-"), number)))
    sizes = named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"))
    return named.join(sizes, "shard").select("__id", "n_bytes", "shard", "shard_bytes")
