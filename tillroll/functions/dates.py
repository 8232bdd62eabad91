"""Which of day and month comes first, decided for each source by all its dates.

``05/06/2024`` is 5 June in one sheet and 6 May in another, and only the other
cells of the sheet tell. Every cell of numbers votes: a first number above 12
can only be a day, a second one above 12 only a day as well. A source (file) is
read as its votes say, by column and separator; where nothing votes, or
votes contradict each other, the report says so and an override decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import _col, parse_date, without_time

#: Day, month and year as numbers, in either order; the year has two or four digits.
NUMBERS = r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4}|[0-9]{2})$"
#: Separators whose dates are read day first where no cell tells.
DAY_FIRST = ("-", ".")
#: Two-digit years below this are after 2000, others before.
PIVOT = 69
#: Layout tables of up to this many rows (a row a file, column and separator,
#: about 200 bytes) are broadcast.
BROADCAST_ROWS = 10_000


def _parts(c: Column | str) -> Column:
    """First and second number, year and separator of a date of numbers, as an
    array of texts; of another length for other texts. One pattern a cell."""
    return F.split(F.regexp_replace(without_time(c), NUMBERS, "$1|$3|$4|$2"), "\\|")


def _mark(parts: Column) -> Column:
    """The separator of a date of numbers, null for other texts."""
    return F.when(F.size(parts) == 4, F.get(parts, F.lit(3)))


def date_votes(df: DataFrame, columns: Iterable[str], source: Column | str) -> DataFrame:
    """(source, column, mark, day_first, month_first, either: long): how many
    cells of a source can only be read day first, only month first, or both
    ways with another date each. Cells that are no numbers, no date either way
    or the same date both ways do not vote. One row a source, column and
    separator that occurs; counted in the tasks before they are dealt out."""
    cells = df.select(_col(source).cast("string").alias("source"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("cell")) for c in columns])).alias("_c")) \
        .select("source", "_c.*")
    split = cells.select("source", "column", _parts("cell").alias("_p"))
    part = lambda i: F.get("_p", F.lit(i))
    marked = (split.select("source", "column", _mark(F.col("_p")).alias("mark"), part(0).try_cast("int").alias("a"),
                           part(1).try_cast("int").alias("b"))
              .where(F.col("mark").isin("-", "/", ".")))
    month_a, month_b = F.col("a").between(1, 12), F.col("b").between(1, 12)
    return marked.groupBy("source", "column", "mark").agg(
        F.count_if((F.col("a") > 12) & (F.col("a") <= 31) & month_b).alias("day_first"),
        F.count_if((F.col("b") > 12) & (F.col("b") <= 31) & month_a).alias("month_first"),
        F.count_if(month_a & month_b & (F.col("a") != F.col("b"))).alias("either"))


def date_layouts(votes: DataFrame, override: Mapping[str, bool] | None = None) -> DataFrame:
    """The votes with ``reads_day_first`` and ``status``: ``day first`` or
    ``month first`` where the votes agree, ``mixed`` where they do not (the
    more frequent order is taken, and of equal ones the separator's),
    ``ambiguous`` where only cells with two readings occur (the separator's
    order is taken), ``chosen`` where ``override`` (column or source: day
    first) names it, the source before the column."""
    usual = F.col("mark").isin(*DAY_FIRST)
    voted = F.when(F.col("day_first") > F.col("month_first"), True).when(
        F.col("day_first") < F.col("month_first"), False).otherwise(usual)
    status = (F.when((F.col("day_first") > 0) & (F.col("month_first") > 0), "mixed")
              .when(F.col("day_first") > 0, "day first").when(F.col("month_first") > 0, "month first")
              .when(F.col("either") > 0, "ambiguous").otherwise(F.when(usual, "day first").otherwise("month first")))
    named = F.lit(None).cast("boolean")
    if override:
        table = F.create_map(*[F.lit(x) for kv in override.items() for x in kv])
        named = F.coalesce(F.try_element_at(table, "source"), F.try_element_at(table, "column"))
    return votes.withColumns({"reads_day_first": F.coalesce(named, voted),
                              "status": F.when(named.isNotNull(), "chosen").otherwise(status)})


def ambiguous_sources(layouts: DataFrame) -> DataFrame:
    """The report: sources that someone should look at."""
    return layouts.where(F.col("status").isin("ambiguous", "mixed"))


def _dates(parts: Column) -> tuple[Column, Column]:
    """A date of numbers read day first, and read month first; null for no date.
    Cast, not parsed by a pattern: a cell that is a date in one order only
    would cost a failed parse, many times a cast."""
    a, b, y = (F.get(parts, F.lit(i)) for i in range(3))
    year = F.when(F.length(y) == 4, y).otherwise(F.concat(F.when(y < str(PIVOT), "20").otherwise("19"), y))

    def date(day, month):
        return F.concat_ws("-", year, month, day).try_cast("date")
    return date(a, b), date(b, a)


def parse_dates_by_source(df: DataFrame, columns: Iterable[str], source: str,
                          override: Mapping[str, bool] | None = None, layouts: DataFrame | None = None) -> DataFrame:
    """``df`` with the text ``columns`` as dates, each cell read in the order of
    its source. No row is lost: a cell that is no date is null. A null source
    is a source of its own. ``layouts`` gives stored layouts; without them the
    columns are read once more for the votes, when the frame is built, since
    their number decides how they are joined."""
    from ..operators.common import row_count_at_most
    from ..session import cut_lineage
    columns = list(columns)
    if layouts is None:
        layouts = cut_lineage(date_layouts(date_votes(df, columns, source), override))
    orders = layouts.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(
        F.concat_ws("\n", "column", "mark"), "reads_day_first"))).alias("_orders")).withColumnRenamed("source", "_source")
    if row_count_at_most(orders, BROADCAST_ROWS):
        orders = F.broadcast(orders)
    # the readings are made before the join, and what comes after it only chooses among them
    read = df.withColumns({f"_{c}_p": _parts(c) for c in columns})
    for c in columns:
        first, second = _dates(F.col(f"_{c}_p"))
        numbers = _mark(F.col(f"_{c}_p")).isin("-", "/", ".")
        # the other layouts are tried on cells that are no numbers only
        read = read.withColumns({f"_{c}_m": _mark(F.col(f"_{c}_p")), f"_{c}_a": F.when(numbers, first), f"_{c}_b": F.when(numbers, second),
                                 f"_{c}_t": F.when(F.coalesce(numbers, F.lit(False)), F.lit(None)).otherwise(parse_date(c))})
    out = read.join(orders, F.col(source).cast("string").eqNullSafe(F.col("_source")), "left")
    for c in columns:
        mark, first, second = (F.col(f"_{c}_{x}") for x in "mab")
        order = F.coalesce(F.try_element_at("_orders", F.concat_ws("\n", F.lit(c), mark)), mark.isin(*DAY_FIRST))
        out = out.withColumn(c, F.when(mark.isin("-", "/", "."), F.when(order, F.coalesce(first, second))
                                       .otherwise(F.coalesce(second, first))).otherwise(F.col(f"_{c}_t")))
    return out.drop("_orders", "_source", *[f"_{c}_{x}" for c in columns for x in "pmabt"])
