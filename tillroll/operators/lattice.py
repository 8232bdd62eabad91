"""Stored sums by a few sets of dimensions, and the smallest one for a question.

The mix views sum sales by one or two dimensions under filters on any others.
All such questions are answered by the sums by all dimensions together, but
that table is nearly as long as the lines. So some smaller sets are stored too:
the length of every set's table is estimated by distinct-count sketches in one
pass, and sets are chosen one by one, each time the one that saves most rows
over all questions that it can answer. A question reads the shortest stored
table that has its keys and filter columns, and goes on like one over lines.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import partitions_for
from .common import ALL

DIMENSIONS = ("year", "month", "center_name", "item_type", "item_category", "item_subcategory", "business_unit")
MEASURES = ("sales_inc_tax", "sales_exc_tax", "tax_collected")
#: Tables besides the one by all dimensions.
TABLES = 6
#: Most dimensions: every set of them is weighed (two to their number).
MAX_DIMENSIONS = 10


def subsets(dimensions: Iterable[str]) -> list[frozenset[str]]:
    """All sets of the dimensions, the empty one too."""
    names = list(dimensions)
    return [frozenset(c) for n in range(len(names) + 1) for c in combinations(names, n)]


def estimate_rows(base: DataFrame, dimensions: Iterable[str]) -> dict[frozenset[str], int]:
    """Number of groups of every set of dimensions: one sketch a set, merged
    over the tasks; the result is one row."""
    sets = [s for s in subsets(dimensions) if s]
    aggregates = [F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*sorted(s)), 10)).alias(f"n{i}")
                  for i, s in enumerate(sets)]
    row = base.agg(*aggregates).first()
    return {frozenset(): 1} | {s: max(1, row[i] or 0) for i, s in enumerate(sets)}


def choose(rows: Mapping[frozenset[str], int], tables: int,
           demand: Mapping[frozenset[str], float] | None = None) -> list[frozenset[str]]:
    """The set of all dimensions, and up to ``tables`` others, each the one that
    saves most rows beyond those before it. ``demand`` weighs the questions
    (their columns); without it all sets count alike."""
    top = max(rows, key=len)
    asked = dict(demand) if demand is not None else dict.fromkeys(rows, 1.0)
    cost = {q: rows[top] for q in asked}
    chosen = [top]
    for _ in range(tables):
        def saved(s):
            return sum(w * max(0, cost[q] - rows[s]) for q, w in asked.items() if q <= s)
        best = max((s for s in rows if s not in chosen), key=lambda s: (saved(s), -len(s), sorted(s)), default=None)
        if best is None or saved(best) <= 0:
            break
        chosen.append(best)
        cost = {q: min(c, rows[best]) if q <= best else c for q, c in cost.items()}
    return chosen


@dataclass(frozen=True)
class Lattice:
    """Stored tables by their dimensions, with their lengths."""

    spark: SparkSession
    path: str
    rows: dict[frozenset[str], int]

    def table(self, dimensions: frozenset[str]) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{_name(dimensions)}")

    def smallest(self, columns: Iterable[str]) -> frozenset[str]:
        """The shortest table with all the columns."""
        asked = frozenset(columns)
        able = [s for s in self.rows if asked <= s]
        if not able:
            raise ValueError(f"no stored table has {sorted(asked)}")
        return min(able, key=lambda s: (self.rows[s], len(s), sorted(s)))

    def lines_for(self, keys: Iterable[str], filters: Mapping[str, object] | None = None) -> DataFrame:
        """The shortest table for sums by ``keys`` under ``filters``, to be used
        like sale lines: measures under their own names, ``lines`` counts them.
        Filters of None or 'All' ask for no column. The filters themselves are
        the caller's to apply, as on lines."""
        return self.table(self.smallest({*keys, *(c for c, v in (filters or {}).items() if v is not None and v != ALL)}))


def _name(dimensions: frozenset[str]) -> str:
    return "by-" + "-".join(sorted(dimensions)) if dimensions else "total"


def build_lattice(lines: DataFrame, path: str, dimensions: Iterable[str] = DIMENSIONS,
                  measures: Iterable[str] = MEASURES, tables: int = TABLES,
                  demand: Mapping[frozenset[str], float] | None = None) -> Lattice:
    """Stores the sums by all ``dimensions`` and by the chosen sets under
    ``path`` and returns the :class:`Lattice`.

    The lines are read once; each further table is made from the shortest
    stored one that has its dimensions. Null dimension values are groups of
    their own, so that a question drops only rows whose own keys are null, and
    sums are exact decimals (null where all values are). A list of the tables
    is written last, so a folder without it is not a finished lattice."""
    dimensions, measures = tuple(dimensions), tuple(measures)
    if not 1 <= len(dimensions) <= MAX_DIMENSIONS:
        raise ValueError(f"a lattice has 1 to {MAX_DIMENSIONS} dimensions")
    spark, top = lines.sparkSession, frozenset(dimensions)
    sums = [F.sum(m).alias(m) for m in measures]
    # the groups may be as many as the lines: partitions by the bytes that are read
    with partitions_for(lines):
        (lines.groupBy(*sorted(top)).agg(*sums, F.count(F.lit(1)).alias("lines"))
         .write.mode("overwrite").parquet(f"{path}/{_name(top)}"))
    base = spark.read.parquet(f"{path}/{_name(top)}")
    estimated = estimate_rows(base, dimensions)
    estimated[top] = base.count()
    out = Lattice(spark, path, {top: estimated[top]})
    # longer tables first: a shorter one can come from them
    for s in sorted(choose(estimated, tables, demand)[1:], key=lambda s: -estimated[s]):
        longer = out.table(out.smallest(s))
        with partitions_for(longer):
            (longer.groupBy(*sorted(s)).agg(*sums, F.sum("lines").alias("lines"))
             .write.mode("overwrite").parquet(f"{path}/{_name(s)}"))
        out.rows[s] = estimated[s]
    listed = [(json.dumps(sorted(s)), n) for s, n in out.rows.items()]
    spark.createDataFrame(listed, "dimensions string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{path}/tables")
    return out


def open_lattice(spark: SparkSession, path: str) -> Lattice:
    """A stored lattice; the list of tables has a row a table."""
    listed = spark.read.parquet(f"{path}/tables").collect()
    return Lattice(spark, path, {frozenset(json.loads(r["dimensions"])): r["rows"] for r in listed})
