"""The analyses behind each dashboard tab, as named lazy DataFrames.

A thin composition over the library operators, mirroring the five views a
user of the original dashboard works with, with the same selections.
Nothing runs until a returned DataFrame is acted on.

    tabs = SalesTabs(lines, calendar)            # canonical sale lines + calendar
    tabs.mtd_overview(year="2024", brand="All")["kpis"].show()
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_plain
from ..operators import growth as G
from ..operators import holidays as H
from ..operators import sales as S
from ..operators import services as V
from ..operators.common import ALL, apply_filters, sum_by


@dataclass
class SalesTabs:
    lines: DataFrame            # canonical sale lines with year / month columns
    calendar: DataFrame         # dated holiday calendar (months, holiday_date, festival, mtd_sale)
    measure: str = "inc_tax"

    def mart(self) -> DataFrame:
        return S.monthly_outlet(self.lines, self.measure)

    # -- MTD sales overview --------------------------------------------------
    def mtd_overview(self, year=None, brand=ALL, month=ALL) -> dict[str, DataFrame]:
        filters = {"year": year, "brand": brand, "month": month}
        lines = apply_filters(self.lines, {"year": year})   # prunable date range
        mart = S.monthly_outlet(lines, self.measure)
        out = {"kpis": S.as_double(S.kpis(mart, filters)),
               "outlet_sales": S.outlet_sales(mart, filters)}
        if month in (None, ALL):
            out["monthly_trend"] = S.monthly_trend(mart, filters)
        return out

    # -- outlet comparison ------------------------------------------------------
    def outlet_comparison(self, outlet: str) -> dict[str, DataFrame]:
        mart = self.mart()
        return {"year_month": S.outlet_year_month(mart, outlet),
                "growth": G.outlet_growth(mart, outlet),
                "daily_average": S.daily_average(S.daily_outlet(self.lines, self.measure), outlet)}

    # -- service & product analysis ---------------------------------------------
    def service_analysis(self, year=None, center=ALL, item_type=ALL, item_category=ALL,
                         business_unit=ALL, item_subcategory=ALL) -> dict[str, DataFrame]:
        filters = {"year": year, "center_name": center, "item_type": item_type,
                   "item_category": item_category, "business_unit": business_unit,
                   "item_subcategory": item_subcategory}
        return {"item_type": S.mix(self.lines, "item_type", self.measure, filters),
                "item_category": S.mix(self.lines, "item_category", self.measure, filters),
                "business_unit": S.mix(self.lines, "business_unit", self.measure, filters),
                "business_unit_total": S.business_unit_rollup(self.lines, self.measure, filters),
                "hierarchy": V.hierarchy(self.lines, self.measure, filters),
                "top_categories": S.top_pairs(self.lines, ["item_category", "business_unit"], 15,
                                              self.measure, filters)}

    # -- growth analysis ------------------------------------------------------------
    def growth_analysis(self, outlet: str | None = None) -> dict[str, DataFrame]:
        out = {"center_year": sum_by(self.lines, ["center_name", "year"], self.measure, "sales"),
               "center_growth": G.center_growth(self.lines, self.measure),
               "center_projection": G.center_projection(self.lines, self.measure)}
        if outlet is not None:
            out["outlet_yearly_growth"] = G.yearly_growth(self.mart(), only=outlet)
        return out

    # -- holidays analysis ------------------------------------------------------------
    def holidays_analysis(self, festival: str, years=None,
                          center: str | None = None) -> dict[str, DataFrame]:
        hs = H.holiday_sales(self.lines, self.calendar, self.measure)
        wl_all = H.festival_lines(self.lines, self.calendar, years=years, center=center)
        wl = H.festival_lines(self.lines, self.calendar, [festival], years, center)
        marks = None
        if center not in (None, H.ALL_CENTERS):  # a holiday is flagged though the centre sold nothing on it
            marks = H.window_days_table(self.lines, self.calendar, [festival], years) \
                .where(F.col("days_from_festival") == 0)
        out = {"holiday_sales": H.select_holiday_rows(hs, years, center),
               "daily": H.festival_daily(wl, self.measure),
               "performance": H.festival_performance(wl_all, self.measure),
               "category_year": H.breakdown(wl, ["item_category", "year"], self.measure),
               "category": H.breakdown(wl, ["item_category"], self.measure)
                            .withColumn("formatted_sales", money_plain("sales")),
               "business_unit_year": H.breakdown(wl, ["business_unit", "year"], self.measure),
               "top_services": H.top_items(wl, 15, self.measure),
               "service_counts": H.top_item_counts(wl, 15),
               "service_summary": H.service_summary(wl, 20, self.measure),
               "traffic": H.daily_traffic(wl, marks, self.measure)}
        if center in (None, H.ALL_CENTERS):
            out["center_business_top10"] = H.center_business_top(wl, 10, self.measure)
        return out
