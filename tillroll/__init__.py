"""Retail sales analytics on Spark: lazy DataFrames for outlet marts, KPIs,
mix, growth, service classification and holiday windows.

Typical use::

    from tillroll import load_all, monthly_outlet, kpis, window_lines, festival_performance
    data = load_all(spark, "s3a://bucket/sales/", "s3a://bucket/holidays.csv")
    mart = monthly_outlet(data.sales)               # year, month, outlet_name, brand, ...
    kpis(mart, {"year": "2024", "brand": "All"}).show()
    festival_performance(window_lines(data.sales, data.calendar)).show()
"""

from .functions.classify import category, service_type
from .functions.clean import (brand, clean_currency, month_name, month_number, normalize_sales,
                              parse_date, with_calendar_parts, year_from_text)
from .functions.dates import ambiguous_sources, date_layouts, date_votes, parse_dates_by_source
from .functions.money import (format_column, format_money_columns, growth_text, money,
                              money_plain, percentage, western_int)
from .operators.common import apply_filters, dense_sum, select_present, sum_by
from .operators.bills import bill_mart, distinct_bills
from .operators.delta import mart_of, merge_changes, read_state
from .operators.growth import (center_growth, center_projection, outlet_growth,
                               outlet_pivot_table, yearly_growth)
from .operators.holidays import (basic_calendar, breakdown, calendar_summary,
                                 center_business_top, daily_traffic, festival_daily, festival_lines,
                                 festival_performance, holiday_dates, holiday_sales,
                                 read_calendar, select_holiday_rows, service_summary,
                                 top_item_counts, top_items, window_lines)
from .operators.intervals import interval_join, long_window_lines
from .operators.lattice import build_lattice, open_lattice
from .operators.profile import profile_of, refresh_states
from .operators.rules import classify_by_rules
from .operators.topk import top_counts, top_sums
from .operators.sales import (as_double, axis_order, business_unit_rollup, column_profile,
                              daily_average, daily_outlet, date_range, filter_values, kpis, mix,
                              monthly_outlet, monthly_trend, outlet_sales, outlet_year_month,
                              rows_per_year, top_pairs)
from .operators.services import classify, hierarchy, hierarchy_rollup, map_outlets, service_mart
from .sources.files import (ensure_mart, list_files, load_all, load_mart, path_exists,
                            preprocess_monthly_sheet, read_table, upsert,
                            write_mart, write_table)
from .plans.tabs import SalesTabs
from .sources.jdbc import balanced_predicates, read_balanced, read_by_year

import types as _types

__all__ = sorted(n for n, v in list(globals().items())
                 if not n.startswith("_") and not isinstance(v, _types.ModuleType))
