"""Year-over-year growth, pivots and the flat +10 % projection.

The scalable core is long form (``lag`` over a per-key window whose rows
are one per year). Pivots are a presentation on top of a small aggregate:
the year headers are collected from it (bounded list) and passed to
``pivot`` explicitly so Spark does not run an extra distinct job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.clean import month_number
from ..functions.money import growth_pct, growth_round2_text, growth_text, money
from ..schemas import PROJECTION_FACTOR
from ..session import cut_lineage
from .common import distinct_values, sum_by

PROJECTED = "projected_10pct"


def _no_rows(df: DataFrame) -> DataFrame:
    return df.where(F.lit(False))


def outlet_pivot(mart: DataFrame, outlet: str) -> DataFrame:
    """One outlet: month rows × year columns of sales (DECIMAL sums)."""
    # Small (years × months); materialised once so the header collection and
    # the pivot do not each recompute it from the fact lines.
    oy = cut_lineage(sum_by(mart.where(F.col("outlet_name") == F.lit(outlet)), ["year", "month"],
                            "mtd_sales", "mtd_sales", exact=True))
    years = distinct_values(oy, "year")
    pv = oy.groupBy("month").pivot("year", years).agg(F.sum("mtd_sales"))
    return pv.withColumn("month_num", month_number("month")), years


def outlet_pivot_table(mart: DataFrame, outlet: str) -> DataFrame:
    pv, years = outlet_pivot(mart, outlet)
    return pv.select("month", "month_num", *[F.col(y).cast("double").alias(y) for y in years])


def outlet_growth(mart: DataFrame, outlet: str,
                  factor: float = PROJECTION_FACTOR) -> DataFrame:
    """Pivot plus 'growth_<prev>_to_<cur>' text columns between consecutive
    year columns, a projection of the latest year × factor, and money text
    for the year columns. Empty unless the outlet has more than one year."""
    pv, years = outlet_pivot(mart, outlet)
    cols = [F.col("month"), F.col("month_num")]
    cols += [money(y).alias(y) for y in years]
    cols += [growth_text(cur, prev).alias(f"growth_{prev}_to_{cur}")
             for prev, cur in zip(years, years[1:])]
    if years:
        cols.append(money(F.col(years[-1]).cast("double") * F.lit(factor)).alias(PROJECTED))
    out = pv.select(*cols)
    return out if len(years) > 1 else _no_rows(out)


def center_year(lines: DataFrame, measure: str = "inc_tax") -> DataFrame:
    """Centre × year sums (small), materialised once for reuse. Grouped on
    the integer year of the sale date; the text year is rendered after."""
    if "sale_date" not in lines.columns:
        return cut_lineage(sum_by(lines, ["center_name", "year"], measure, "sales", exact=True))
    by_int = sum_by(lines.withColumn("_y", F.year("sale_date")), ["center_name", "_y"],
                    measure, "sales", exact=True)
    return cut_lineage(by_int.select("center_name", F.col("_y").cast("string").alias("year"),
                                     "sales"))


def center_growth(lines: DataFrame, measure: str = "inc_tax") -> DataFrame:
    """Centre rows × year columns (money text) and 'growth_<prev>_<cur>'
    columns rounded to 2 places with a '%' suffix."""
    cy = center_year(lines, measure)
    years = distinct_values(cy, "year")
    pv = cy.groupBy("center_name").pivot("year", years).agg(F.sum("sales"))
    cols = [F.col("center_name")] + [money(y).alias(y) for y in years]
    cols += [growth_round2_text(cur, prev).alias(f"growth_{prev}_{cur}")
             for prev, cur in zip(years, years[1:])]
    out = pv.select(*cols)
    return out if len(years) > 1 else _no_rows(out)


def center_projection(lines: DataFrame, measure: str = "inc_tax",
                      factor: float = PROJECTION_FACTOR) -> DataFrame:
    """Latest-year sales × factor per centre, matched by centre key.

    Runs on the materialised centre × year aggregate; the latest year is a
    scalar subquery over it, so the fact lines are aggregated once and
    nothing is collected."""
    cy = center_year(lines, measure)
    latest = cy.select(F.max("year")).scalar()
    agg = cy.groupBy("center_name").agg(
        F.sum(F.when(F.col("year") == latest, F.col("sales"))).alias("_latest"))
    latest_sales = F.col("_latest").cast("double")
    return agg.select("center_name", latest.alias("latest_year"),
                      latest_sales.alias("latest_sales"),
                      (latest_sales * F.lit(factor)).alias("projected"),
                      money(latest_sales * F.lit(factor)).alias("projected_text"))


def yearly_growth(mart: DataFrame, key: str = "outlet_name", value: str = "mtd_sales",
                  only: str | None = None) -> DataFrame:
    """Sequential year-over-year growth per key (long form): one row per
    year after a key's first, labelled '<prev> to <cur>'. The window is
    partitioned by key and holds one row per year."""
    src = mart if only is None else mart.where(F.col(key) == F.lit(only))
    yearly = sum_by(src, [key, "year"], value, "_sales", exact=True)
    w = Window.partitionBy(key).orderBy("year")
    prev_year, prev_sales = F.lag("year").over(w), F.lag("_sales").over(w)
    out = yearly.select(key, "year", "_sales", prev_year.alias("_py"), prev_sales.alias("_ps"))
    return (out.where(F.col("_py").isNotNull())
            .select(key, F.concat_ws(" to ", "_py", "year").alias("year_comparison"),
                    growth_text("_sales", "_ps").alias("growth"),
                    growth_pct("_sales", "_ps").alias("growth_pct")))
