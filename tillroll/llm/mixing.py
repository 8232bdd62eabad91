"""Mixing sources to target weights by systematic sampling.

The rows of a source are laid out by size, then by a hash of their id; each
takes up ``target / source size`` on a line (its expected copies), the line
starts at one random offset a source, and a row is emitted once for every
whole number its stretch crosses. The prefix sum is the row's rank times the
rate, so it needs ranks only: rows are ranked inside cells (source, size
class, hash slot), which also split a source that holds most rows, and a cell
starts after the rows of the cells before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import n_words

#: Hash slots a size class is cut into; a cell is the unit that one task sorts.
SLOTS = 1024
CLASSES_PER_DOUBLING = 4


def _unit(key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size, one row a source) with ``target``.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all sizes; none gets more than ``cap`` times its own size and
    the excess goes to the others by weight until none is above. That is
    min(cap * size, level * weight) with one level for all: sources are
    saturated in the order of cap * size / weight, and the level after k of
    them is what is left over the weight that is left. One row a source is
    ordered in one task."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("i") - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (sizes.withColumn("i", F.row_number().over(order))
              .withColumn("weight", weight)
              .withColumn("most", F.lit(float(cap)) * F.col("source_size"))
              .withColumn("fill", F.col("most") / F.col("weight"))
              .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(everything))
              .withColumn("weights", F.sum("weight").over(everything))
              .withColumn("spent", F.coalesce(F.sum("most").over(upto), F.lit(0.0)))
              .withColumn("served", F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
              .withColumn("level", (F.col("budget") - F.col("spent")) / (F.col("weights") - F.col("served"))))
    # the first source that is not saturated by its level sets the level
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"]
    return ranked.withColumn("set", level).select(
        "source", "source_size",
        F.when(F.col("set").isNull(), F.col("most"))
        .otherwise(F.least("most", F.col("set") * F.col("weight"))).alias("target"))


def _copies(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int,
            weights, share, cap, carry: list[str]) -> DataFrame:
    text = F.xxhash64(F.col(text_col).cast("string"))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), text.cast("string")))
    source = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    sized = docs.select(
        *carry, F.col(source_col).cast("string").alias("__source"),
        n_words(F.col(text_col).cast("string")).alias("__size"), source.alias("__key"),
        key.alias("__name"), text.alias("__text_hash"),
        _unit(F.concat_ws(":", F.lit(str(seed)), F.lit("row"), key)).alias("__u")).withColumn(
        "__class", F.floor(F.log2(F.greatest(F.col("__size"), F.lit(1))) * CLASSES_PER_DOUBLING + 1e-9).cast("int")
    ).withColumn("__slot", F.floor(F.col("__u") * SLOTS).cast("int"))
    cell = ["__key", "__class", "__slot"]
    cells = cut_lineage(sized.groupBy(*cell).agg(  # rows: sources x classes x slots at most
        F.count("*").alias("n"), F.sum("__size").alias("size"), F.first("__source").alias("source")))
    plan = targets(cells.groupBy("__key").agg(F.first("source").alias("source"),
                                              F.sum("size").alias("source_size"))
                   .select("source", "source_size"), weights, share, cap)
    plan = plan.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    before = Window.partitionBy("__key").orderBy("__class", "__slot").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = (cells.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .select(*cell, "__before").join(plan.select("__key", "source_size", "target"), "__key"))
    rank = F.col("__before") + F.row_number().over(
        Window.partitionBy(*cell).orderBy("__size", "__u", "__name", "__text_hash"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _unit(F.concat_ws(":", F.lit(str(seed)), F.lit("source"), F.col("__key")))
    placed = (sized.join(starts, cell).withColumn("__rank", rank)
              .withColumn("__rate", rate).withColumn("__offset", offset))
    copies = (F.floor(F.col("__offset") + F.col("__rank") * F.col("__rate"))
              - F.floor(F.col("__offset") + (F.col("__rank") - 1) * F.col("__rate")))
    return placed.withColumn("__copies", copies.cast("long"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", weights=(5, 2, 1), share: float = 1.5,
               cap: float = 2.0, seed: int = 42) -> DataFrame:
    """(id_col long, size, source_size, target, taken, copies), one row a row of
    ``docs``. Same input and seed, same result: offsets and order come from
    MD5s of the seed, the source and the id.

    Null and empty texts have size 0 and are emitted at their source's rate
    like others; a source of size 0 has target 0 and emits nothing. Null
    sources form one source, last in the order, apart from the source named
    "null". Null and repeated ids are rows of their own: rows with a null id are
    placed by a hash of their text, rows with one id are ordered by it. An empty
    table gives an empty result."""
    c = _copies(docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"),
                            F.col(source_col).alias("__src")),
                "__id", "__text", "__src", seed, weights, share, cap, ["__id"])
    return c.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target",
                    (F.col("__size") * F.col("__copies")).alias("taken"),
                    F.col("__copies").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=(5, 2, 1), share: float = 1.5,
        cap: float = 2.0, seed: int = 42) -> DataFrame:
    """The rows of the mix, all columns of ``docs``, each row as often as it is
    emitted. Rules as for :func:`mix_report`."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"),
                        docs[id_col].alias("__id"), docs[text_col].alias("__text"),
                        docs[source_col].alias("__src"))
    c = _copies(whole, "__id", "__text", "__src", seed, weights, share, cap, ["__row", "__id"])
    return (c.where("__copies > 0")
            .select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
            .select("__row.*"))
