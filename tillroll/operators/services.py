"""Service classification, service summary mart, outlet mapping, hierarchy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import category, service_type
from ..functions.clean import year_from_text
from ..schemas import OUTLET_TO_CENTER, PRODUCT, SERVICE_KEYWORDS
from .common import measure_col, not_null, sum_by

SERVICE_MART_KEYS = ["center_name", "year", "category", "service_type",
                     "item_category", "item_subcategory", "business_unit"]
MAPPING_LITERAL = 1_000


def classify(lines: DataFrame, keywords=SERVICE_KEYWORDS,
             product_value: str = PRODUCT) -> DataFrame:
    """Add ``category`` (Product / Service) and ``service_type``."""
    return lines.withColumns({
        "category": category("item_type", product_value),
        "service_type": service_type(keywords=keywords, product_value=product_value),
    })


def service_mart(lines: DataFrame, measure: str = "inc_tax", keywords=SERVICE_KEYWORDS,
                 product_value: str = PRODUCT, date_text: str | None = None) -> DataFrame:
    """Sum and non-NULL count of the measure by centre, year, category,
    service type, item category / subcategory and business unit.

    One ``groupBy``: Spark's partial aggregation before the shuffle does what
    chunked pre-aggregation plus a re-aggregation would. Lines that have a
    ``category`` and ``service_type`` already, because they were classified
    item by item before the join, keep them. ``date_text`` names
    a 'dd-mm-yyyy' text column to take the year from (last '-' token);
    otherwise the year of ``sale_date`` is used.
    """
    m = measure_col(measure)
    year = year_from_text(date_text) if date_text else F.year("sale_date").cast("string")
    known = {"category", "service_type"} <= set(lines.columns)
    c = (lines if known else classify(lines, keywords, product_value)).withColumn("year", year)
    keys = [k for k in SERVICE_MART_KEYS if k in c.columns]
    return (c.where(not_null(keys)).groupBy(*keys)
            .agg(F.coalesce(F.sum(m), F.lit(0)).alias("total_sales"),
                 F.count(m).alias("transaction_count")))


def map_outlets(df: DataFrame, mapping=None, column: str = "center_name") -> DataFrame:
    """Replace outlet names through a mapping; unmapped names stay.

    A dict of up to ``MAPPING_LITERAL`` pairs becomes a literal map
    expression, so no join is needed; a larger one becomes a DataFrame. A DataFrame ``(outlet, center)`` is left-joined and the planner
    decides from its size whether to broadcast it.
    """
    mapping = OUTLET_TO_CENTER if mapping is None else mapping
    if isinstance(mapping, DataFrame):
        m = mapping.toDF("_tr_outlet", "_tr_center")
        out = df.join(m, df[column] == m["_tr_outlet"], "left")
        return out.withColumn(column, F.coalesce("_tr_center", column)) \
            .drop("_tr_outlet", "_tr_center")
    pairs = list(mapping.items()) if isinstance(mapping, Mapping) else list(mapping)
    if len(pairs) > MAPPING_LITERAL:
        table = df.sparkSession.createDataFrame(list(dict(pairs).items()), "outlet string, center string")
        return map_outlets(df, table, column)
    if not pairs:
        return df
    lookup = F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    return df.withColumn(column, F.coalesce(F.try_element_at(lookup, F.col(column)), F.col(column)))


def hierarchy(lines: DataFrame, measure: str = "inc_tax", filters=None,
              exact: bool = False) -> DataFrame:
    """Business unit → item category sums, keeping only positive leaves."""
    from .common import apply_filters
    leaves = sum_by(apply_filters(lines, filters), ["business_unit", "item_category"],
                    measure, "sales", exact=True).where(F.col("sales") > 0)
    return leaves if exact else leaves.withColumn("sales", F.col("sales").cast("double"))


def hierarchy_rollup(lines: DataFrame, measure: str = "inc_tax", filters=None) -> DataFrame:
    """Positive leaves plus business-unit and grand totals (``level`` is the
    grouping id: 0 leaf, 1 business unit, 3 total)."""
    leaves = hierarchy(lines, measure, filters, exact=True)
    return (leaves.rollup("business_unit", "item_category")
            .agg(F.sum("sales").cast("double").alias("sales"),
                 F.grouping_id().cast("int").alias("level")))
