"""DuckDB oracle SQL for every registered query (same column names)."""

from __future__ import annotations

from .oracle_base import (
    MONTHLY_MART_SQL,
    SALES_LINES_SQL,
    basic_calendar_cte,
    calendar_cte,
    growth_round2_sql,
    growth_text_sql,
    indian_sql,
    lakhs_sql,
    pct_sql,
    with_ctes)

from ..schemas import HOLIDAY_CALENDAR, MONTHS, SERVICE_KEYWORDS

MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTHS) + "]"

ORACLE: dict[str, str] = {}

ORACLE["q_monthly_outlet"] = with_ctes(SALES_LINES_SQL, MONTHLY_MART_SQL) + """
SELECT year, month, outlet_name, brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales, mtd_bills,
       CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv
FROM monthly"""

ORACLE["q_monthly_outlet_exc"] = ORACLE["q_monthly_outlet"].replace(
    "coalesce(sum(sales_inc_tax), 0) AS mtd_sales", "coalesce(sum(sales_exc_tax), 0) AS mtd_sales")


BASE = with_ctes(SALES_LINES_SQL, MONTHLY_MART_SQL)


def _kpi(where: str = "") -> str:
    return BASE + f"""
SELECT CAST(coalesce(sum(mtd_sales), 0) AS DOUBLE) AS total_sales,
       CAST(coalesce(sum(mtd_bills), 0) AS BIGINT) AS total_bills,
       count(DISTINCT outlet_name) AS total_outlets,
       CASE WHEN sum(mtd_bills) > 0 THEN CAST(sum(mtd_sales) AS DOUBLE) / CAST(sum(mtd_bills) AS DOUBLE) ELSE 0.0 END AS avg_bill_value,
       CAST(CAST(coalesce(sum(mtd_bills), 0) AS BIGINT) AS VARCHAR) AS total_bills_text
FROM monthly {where}"""


ORACLE["q_kpis"] = _kpi().replace("SELECT CAST(coalesce(sum(mtd_sales)", "SELECT (SELECT count(DISTINCT invoice_no) "
                                  "FROM sales_lines) AS distinct_bills, CAST(coalesce(sum(mtd_sales)", 1)
ORACLE["q_kpis_filtered"] = _kpi("WHERE year = '1996' AND brand = 'BUILDING'")

SHARED_BILLS = """,
bills AS (SELECT year, month, center_name AS outlet_name, coalesce(nullif(business_unit, 'nan'), 'Other') AS brand,
                 invoice_no // 8 AS bill, sales_inc_tax FROM sales_lines WHERE center_name IS NOT NULL)
"""
ORACLE["q_distinct_bills"] = with_ctes(SALES_LINES_SQL) + SHARED_BILLS + """
SELECT 'all' AS dimension, 'all' AS value, count(DISTINCT bill) AS distinct_bills FROM bills
UNION ALL SELECT 'year', year, count(DISTINCT bill) FROM bills GROUP BY year
UNION ALL SELECT 'outlet_name', outlet_name, count(DISTINCT bill) FROM bills GROUP BY outlet_name
UNION ALL SELECT 'brand', brand, count(DISTINCT bill) FROM bills GROUP BY brand"""
ORACLE["q_kpis_shared_bills"] = with_ctes(SALES_LINES_SQL) + SHARED_BILLS + """,
mart_rows AS (SELECT year, month, outlet_name, brand, sum(sales_inc_tax) AS s, count(DISTINCT bill) AS n FROM bills GROUP BY ALL),
chosen AS (SELECT * FROM mart_rows WHERE year IN ('1996', '1997') AND brand = 'BUILDING')
SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) AS total_sales, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_bills,
       count(DISTINCT outlet_name) AS total_outlets,
       (SELECT count(DISTINCT bill) FROM bills WHERE year IN ('1996', '1997') AND brand = 'BUILDING') AS distinct_bills,
       CASE WHEN sum(n) > 0 THEN CAST(sum(s) AS DOUBLE) / CAST(sum(n) AS DOUBLE) ELSE 0.0 END AS avg_bill_value,
       CAST(CAST(coalesce(sum(n), 0) AS BIGINT) AS VARCHAR) AS total_bills_text
FROM chosen"""

OUTLET_SALES = """SELECT outlet_name, CAST(coalesce(sum(mtd_sales), 0) AS DOUBLE) AS mtd_sales
FROM monthly WHERE outlet_name IS NOT NULL GROUP BY outlet_name"""

ORACLE["q_outlet_sales"] = BASE + OUTLET_SALES

ORACLE["q_monthly_trend"] = BASE + """
SELECT month, year, CAST(coalesce(sum(mtd_sales), 0) AS DOUBLE) AS mtd_sales,
       CAST(coalesce(list_position(""" + MONTH_LIST + """, month), 0) AS INTEGER) AS month_num
FROM monthly WHERE month IS NOT NULL AND year IS NOT NULL GROUP BY month, year"""

ORACLE["q_monthly_trend_dense"] = BASE + f"""
SELECT m.month, y.year, CAST(coalesce(sum(t.mtd_sales), 0) AS DOUBLE) AS mtd_sales,
       CAST(coalesce(list_position({MONTH_LIST}, m.month), 0) AS INTEGER) AS month_num
FROM (SELECT DISTINCT month FROM monthly) m CROSS JOIN (SELECT DISTINCT year FROM monthly) y
LEFT JOIN (SELECT * FROM monthly WHERE brand = 'BUILDING' AND outlet_name = 'NATION_7' AND year IN ('1994', '1996')) t
  ON t.month = m.month AND t.year = y.year
GROUP BY m.month, y.year"""

ORACLE["q_outlet_year_month"] = BASE + """
SELECT year, month, CAST(coalesce(sum(mtd_sales), 0) AS DOUBLE) AS mtd_sales,
       CAST(coalesce(list_position(""" + MONTH_LIST + """, month), 0) AS INTEGER) AS month_num
FROM monthly WHERE outlet_name = 'NATION_7' GROUP BY year, month"""

ORACLE["q_daily_avg"] = with_ctes(SALES_LINES_SQL) + """,
daily AS (
  SELECT year, month, center_name AS outlet_name, coalesce(nullif(business_unit, 'nan'), 'Other') AS brand,
         CAST(day(sale_date) AS VARCHAR) AS day_sales, coalesce(sum(sales_inc_tax), 0) AS mtd_sales
  FROM sales_lines WHERE center_name IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5
)
SELECT year, month, day_sales, CAST(sum(mtd_sales) AS DOUBLE) / CAST(count(mtd_sales) AS DOUBLE) AS mtd_sales
FROM daily
WHERE outlet_name = 'NATION_7' AND day_sales IS NOT NULL AND day_sales <> '' AND day_sales <> '0'
GROUP BY year, month, day_sales"""


def _mix(dim: str, where: str = "") -> str:
    w = f"WHERE {dim} IS NOT NULL" + (f" AND {where}" if where else "")
    return with_ctes(SALES_LINES_SQL) + f"""
SELECT {dim}, sales, replace({indian_sql('sales')}, '₹', '') AS formatted_sales
FROM (SELECT {dim}, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales
      FROM sales_lines {w} GROUP BY {dim})"""


ORACLE["q_item_type"] = _mix("item_type")
ORACLE["q_item_category"] = _mix("item_category")
ORACLE["q_mix_dense"] = with_ctes(SALES_LINES_SQL) + f"""
SELECT item_category, sales, replace({indian_sql('sales')}, '₹', '') AS formatted_sales
FROM (SELECT item_category, CAST(coalesce(sum(sales_inc_tax) FILTER (WHERE center_name = 'NATION_7' AND item_type = 'PROMO'
        AND business_unit = 'AUTOMOBILE'), 0) AS DOUBLE) AS sales
      FROM sales_lines WHERE item_category IS NOT NULL GROUP BY item_category)"""
ORACLE["q_business_unit"] = _mix("business_unit")
ORACLE["q_mix_filtered"] = _mix(
    "item_category",
    "year = '1997' AND center_name = 'NATION_3' AND item_type = 'PROMO' AND business_unit = 'AUTOMOBILE'")

ORACLE["q_business_unit_rollup"] = with_ctes(SALES_LINES_SQL) + """
SELECT business_unit, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales,
       grouping(business_unit) = 1 AS is_total
FROM sales_lines WHERE business_unit IS NOT NULL
GROUP BY ROLLUP (business_unit)"""

ORACLE["q_top_categories"] = with_ctes(SALES_LINES_SQL) + """
SELECT item_category, business_unit, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales
FROM sales_lines WHERE item_category IS NOT NULL AND business_unit IS NOT NULL
GROUP BY 1, 2 ORDER BY sales DESC, item_category, business_unit LIMIT 15"""

ORACLE["q_top_items_pruned"] = with_ctes(SALES_LINES_SQL) + """
SELECT item_name, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales FROM sales_lines
WHERE item_name IS NOT NULL GROUP BY 1 ORDER BY sales DESC, item_name LIMIT 15"""
ORACLE["q_top_keys_skewed"] = with_ctes(SALES_LINES_SQL) + """
SELECT CAST(1000000 // ((invoice_no * 7919) % 100003 + 1) AS VARCHAR) AS item_name,
       CAST(coalesce(sum(sales_exc_tax), 0) AS DOUBLE) AS sales
FROM sales_lines WHERE (invoice_no * 7919) % 100003 <> 17 GROUP BY 1 ORDER BY sales DESC, item_name LIMIT 15"""
ORACLE["q_top_counts_skewed"] = with_ctes(SALES_LINES_SQL) + """
SELECT CAST(1000000 // ((invoice_no * 7919) % 100003 + 1) AS VARCHAR) AS item_name, year, count(*) AS count
FROM sales_lines WHERE year IN ('1996', '1997', '1998') GROUP BY 1, 2 ORDER BY count DESC, item_name, year LIMIT 20"""

ORACLE["q_center_year"] = with_ctes(SALES_LINES_SQL) + """
SELECT center_name, year, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales
FROM sales_lines WHERE center_name IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2"""

ORACLE["q_center_year_dense"] = with_ctes(SALES_LINES_SQL) + """,
agg AS (
  SELECT center_name, year, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales
  FROM sales_lines
  WHERE item_category = 'Brand#1' AND business_unit = 'AUTOMOBILE'
    AND center_name IS NOT NULL AND year IS NOT NULL
  GROUP BY 1, 2
),
grid AS (
  SELECT c.center_name, y.year
  FROM (SELECT DISTINCT center_name FROM sales_lines WHERE center_name IS NOT NULL) c,
       (SELECT DISTINCT year FROM sales_lines WHERE year IS NOT NULL) y
)
SELECT g.center_name, g.year, coalesce(a.sales, 0.0) AS sales
FROM grid g LEFT JOIN agg a ON g.center_name = a.center_name AND g.year = a.year"""

ORACLE["q_lattice_mix_filtered"] = ORACLE["q_mix_filtered"]
ORACLE["q_lattice_top_categories"] = ORACLE["q_top_categories"]
ORACLE["q_lattice_center_year"] = ORACLE["q_center_year"]

ORACLE["q_rows_per_year"] = with_ctes(SALES_LINES_SQL) + """
SELECT CAST(year(sale_date) AS BIGINT) AS year, count(*) AS rows FROM sales_lines GROUP BY 1"""

ORACLE["q_date_range"] = with_ctes(SALES_LINES_SQL) + """
SELECT min(sale_date) AS first_date, max(sale_date) AS last_date, count(*) AS rows,
       count(DISTINCT year(sale_date)) AS years
FROM sales_lines"""

ORACLE["q_filter_values"] = with_ctes(SALES_LINES_SQL) + """
SELECT DISTINCT dimension, value FROM (
  SELECT 'year' AS dimension, CAST(year AS VARCHAR) AS value FROM sales_lines
  UNION ALL SELECT 'month', month FROM sales_lines
  UNION ALL SELECT 'center_name', center_name FROM sales_lines
  UNION ALL SELECT 'item_type', item_type FROM sales_lines
  UNION ALL SELECT 'item_category', item_category FROM sales_lines
  UNION ALL SELECT 'item_subcategory', item_subcategory FROM sales_lines
  UNION ALL SELECT 'business_unit', business_unit FROM sales_lines
) WHERE value IS NOT NULL"""

ORACLE["q_axis_order"] = with_ctes(SALES_LINES_SQL) + """
SELECT item_category, total,
       CAST(row_number() OVER (ORDER BY total DESC, item_category ASC) AS BIGINT) AS axis_rank
FROM (SELECT item_category, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS total
      FROM sales_lines WHERE item_category IS NOT NULL GROUP BY 1)"""

_PROFILE_COLS = ["center_name", "item_name", "item_type", "item_category",
                 "item_subcategory", "business_unit", "year", "month"]
ORACLE["q_column_profile"] = with_ctes(SALES_LINES_SQL) + ",\nstats AS (SELECT count(*) AS rows, " + \
    ", ".join(f"count(DISTINCT {c}) AS d_{c}" for c in _PROFILE_COLS) + " FROM sales_lines)\n" + \
    "\nUNION ALL\n".join(
        f"SELECT rows, '{c}' AS column_name, d_{c} AS distinct_values, "
        f"CASE WHEN rows > 0 THEN d_{c} / rows END AS distinct_ratio, "
        f"coalesce(d_{c} / rows < 0.5, false) AS low_cardinality FROM stats"
        for c in _PROFILE_COLS)

ORACLE["q_format_money"] = BASE + f"""
SELECT outlet_name, mtd_sales, {indian_sql('mtd_sales')} AS sales_text,
       replace({indian_sql('mtd_sales')}, '₹', '') AS sales_plain,
       {indian_sql('(mtd_sales / -1000.0)')} AS negative_text
FROM ({OUTLET_SALES})"""

ORACLE["q_format_lakhs"] = BASE + f"""
SELECT outlet_name, {lakhs_sql('mtd_sales')} AS sales_lakhs FROM ({OUTLET_SALES})"""

ORACLE["q_format_percentage"] = with_ctes(SALES_LINES_SQL) + f"""
SELECT center_name, year, tax_rate_pct, {pct_sql('tax_rate_pct')} AS tax_rate_text,
       CASE WHEN tax_rate_pct IS NULL THEN '0%' ELSE printf('%.2f', tax_rate_pct) END AS tax_rate_plain
FROM (SELECT center_name, year,
             CAST(sum(tax_collected) AS DOUBLE) / CAST(sum(sales_exc_tax) AS DOUBLE) * 100.0 AS tax_rate_pct
      FROM sales_lines GROUP BY 1, 2)"""

ORACLE["q_format_columns"] = BASE + f"""
SELECT year, month, outlet_name, brand, {indian_sql('mtd_sales')} AS mtd_sales, mtd_bills,
       {indian_sql('mtd_abv')} AS mtd_abv
FROM (SELECT year, month, outlet_name, brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales, mtd_bills,
             CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv
      FROM monthly)"""

ORACLE["q_format_int"] = BASE + f"""
SELECT outlet_name, format('{{:,}}', CAST(trunc(mtd_sales) AS BIGINT)) AS sales_int FROM ({OUTLET_SALES})"""

ORACLE["q_format_column"] = BASE + f"""
SELECT outlet_name, {lakhs_sql('mtd_sales')} AS by_name,
       'Rs. ' || format('{{:,.2f}}', mtd_sales) AS by_function
FROM ({OUTLET_SALES})"""

_L = with_ctes(SALES_LINES_SQL)

ORACLE["q_clean_currency"] = _L + """
SELECT year, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales, count(amount) AS parsed,
       count(*) - count(amount) AS unparsed
FROM (SELECT year, TRY_CAST(trim(replace(replace(replace(
        CASE WHEN invoice_no % 7 = 0 THEN 'bad'
             WHEN invoice_no % 5 = 0 THEN ''
             WHEN invoice_no % 3 = 0 THEN '$' || CAST(sales_exc_tax AS VARCHAR)
             ELSE '₹' || substr(CAST(sales_exc_tax AS VARCHAR), 1, 2) || ',' || substr(CAST(sales_exc_tax AS VARCHAR), 3)
        END, '$', ''), '₹', ''), ',', '')) AS DECIMAL(18,6)) AS amount
      FROM sales_lines)
GROUP BY year"""

# The text each line gets (see the query) is a valid date of its own, but for
# the impossible 29 February.
ORACLE["q_clean_dates"] = _L + """
SELECT CAST(year(sale_date) AS BIGINT) AS year, count(*) AS rows, min(sale_date) AS first_date
FROM sales_lines WHERE invoice_no % 11 <> 0 GROUP BY 1"""

ORACLE["q_normalize_db"] = _L + """
SELECT CAST(year(sale_date) AS BIGINT) AS year, center_name,
       CAST(sum(7000000000000000 + CAST(floor(sales_exc_tax) AS DECIMAL(28,6))) AS DOUBLE) AS large,
       CAST(sum(sales_inc_tax) AS DOUBLE) AS sales, count(*) AS lines
FROM sales_lines GROUP BY 1, 2"""

ORACLE["q_clean_dates_by_file"] = with_ctes(SALES_LINES_SQL) + """
SELECT center_name, sale_date, count(*) AS lines, CAST(sum(sales_inc_tax) AS DOUBLE) AS sales
FROM sales_lines GROUP BY 1, 2"""

ORACLE["q_brand_default"] = _L + """
SELECT coalesce(nullif(CASE WHEN business_unit = 'BUILDING' THEN NULL
                            WHEN business_unit = 'MACHINERY' THEN 'nan' ELSE business_unit END, 'nan'), 'Other') AS brand,
       'Unknown' AS absent_brand, count(*) AS lines, CAST(sum(sales_inc_tax) AS DOUBLE) AS sales
FROM sales_lines GROUP BY 1, 2"""

ORACLE["q_normalize_sales"] = ORACLE["q_monthly_outlet"]

ORACLE["q_month_num"] = _L + """
SELECT m AS month, CAST(coalesce(list_position(""" + MONTH_LIST + """, m), 0) AS INTEGER) AS month_num,
       count(*) AS lines
FROM (SELECT CASE WHEN invoice_no % 13 = 0 THEN 'Foo' ELSE month END AS m FROM sales_lines)
GROUP BY 1, 2"""

ORACLE["q_year_from_text"] = _L + """
SELECT split_part(strftime(sale_date, '%d-%m-%Y'), '-', -1) AS year, count(*) AS lines
FROM sales_lines GROUP BY 1"""


def _classify_sql(kw, product, type_col="item_type"):
    def any_of(col, words):
        return "(" + " OR ".join(
            f"contains(lower(coalesce({col}, '')), '{w}')" for w in words) + ")"
    parts = [f"CASE WHEN coalesce({type_col} = '{product}', false) THEN 'Product'"]
    for label, cw, sw, nw in kw:
        parts.append(f"WHEN {any_of('item_category', cw)} OR {any_of('item_subcategory', sw)} "
                     f"OR {any_of('item_name', nw)} THEN '{label}'")
    parts.append("ELSE 'Other Services' END")
    return " ".join(parts)


_TEST_KW = [("Hair", ["#1"], ["ring"], ["red"]), ("Skin", ["#2"], ["bolt"], ["blue"]),
            ("SPA", ["#3"], ["gear"], ["hot"])]
_DEFAULT_KW = SERVICE_KEYWORDS

ORACLE["q_service_type"] = _L + f"""
SELECT CASE WHEN coalesce(item_type = 'PROMO', false) THEN 'Product' ELSE 'Service' END AS category,
       {_classify_sql(_TEST_KW, 'PROMO')} AS service_type,
       {_classify_sql(_DEFAULT_KW, 'Product')} AS default_service_type,
       count(*) AS lines, CAST(sum(sales_inc_tax) AS DOUBLE) AS sales
FROM sales_lines GROUP BY 1, 2, 3"""

SERVICE_MART_SQL = f"""
service_mart AS (
  SELECT center_name, split_part(strftime(sale_date, '%d-%m-%Y'), '-', -1) AS year,
         CASE WHEN coalesce(item_type = 'PROMO', false) THEN 'Product' ELSE 'Service' END AS category,
         {_classify_sql(_TEST_KW, 'PROMO')} AS service_type,
         item_category, item_subcategory, business_unit,
         coalesce(sum(sales_inc_tax), 0) AS total_sales, count(sales_inc_tax) AS transaction_count
  FROM sales_lines
  WHERE center_name IS NOT NULL AND item_category IS NOT NULL AND item_subcategory IS NOT NULL
    AND business_unit IS NOT NULL
  GROUP BY 1, 2, 3, 4, 5, 6, 7
)"""

ORACLE["q_service_mart"] = with_ctes(SALES_LINES_SQL, SERVICE_MART_SQL) + """
SELECT center_name, year, category, service_type, item_category, item_subcategory, business_unit,
       CAST(total_sales AS DOUBLE) AS total_sales, transaction_count
FROM service_mart"""

ORACLE["q_map_outlet"] = BASE + """
SELECT year, month,
       CASE outlet_name WHEN 'NATION_1' THEN 'CENTRE ONE' WHEN 'NATION_2' THEN 'CENTRE TWO'
                       WHEN 'T NAGAR' THEN 'T. NAGAR CENTER' ELSE outlet_name END AS outlet_name,
       brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales, mtd_bills,
       CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv
FROM monthly"""

HIER_LEAVES = """
leaves AS (
  SELECT business_unit, item_category, coalesce(sum(sales_inc_tax), 0) AS sales
  FROM sales_lines WHERE business_unit IS NOT NULL AND item_category IS NOT NULL
  GROUP BY 1, 2 HAVING coalesce(sum(sales_inc_tax), 0) > 0
)"""

ORACLE["q_hierarchy"] = with_ctes(SALES_LINES_SQL, HIER_LEAVES) + """
SELECT business_unit, item_category, CAST(sales AS DOUBLE) AS sales FROM leaves"""

ORACLE["q_lattice_hierarchy"] = ORACLE["q_hierarchy"]
ORACLE["q_hierarchy_rollup"] = with_ctes(SALES_LINES_SQL, HIER_LEAVES) + """
SELECT business_unit, item_category, CAST(sum(sales) AS DOUBLE) AS sales,
       CAST(grouping(business_unit, item_category) AS INTEGER) AS level
FROM leaves GROUP BY ROLLUP (business_unit, item_category)"""


HDATES = """
hdates AS (
  SELECT DISTINCT c.festival, s.sale_date AS holiday_date, CAST(year(s.sale_date) AS BIGINT) AS year
  FROM (SELECT DISTINCT sale_date FROM sales_lines WHERE sale_date IS NOT NULL) s
  JOIN calendar c ON month(s.sale_date) = c.hol_month AND day(s.sale_date) = c.hol_day
)"""

ORACLE["q_holiday_dates"] = with_ctes(SALES_LINES_SQL, calendar_cte(), HDATES) + \
    "SELECT festival, holiday_date, year FROM hdates"
ORACLE["q_holiday_dates_basic"] = with_ctes(SALES_LINES_SQL, basic_calendar_cte(), HDATES) + \
    "SELECT festival, holiday_date, year FROM hdates"

HSALES = """
hsales AS (
  SELECT festival, year, holiday_date, center_name,
         CAST(coalesce(sum(amount), 0) AS DOUBLE) AS mtd_sale, grouping(center_name) = 1 AS is_total
  FROM (SELECT c.festival, CAST(year(l.sale_date) AS BIGINT) AS year, l.sale_date AS holiday_date,
               l.center_name, l.sales_inc_tax AS amount
        FROM sales_lines l JOIN calendar c
          ON month(l.sale_date) = c.hol_month AND day(l.sale_date) = c.hol_day)
  GROUP BY GROUPING SETS ((festival, year, holiday_date), (festival, year, holiday_date, center_name))
)"""

_HS = with_ctes(SALES_LINES_SQL, calendar_cte(), HSALES)
_HS_COLS = "SELECT festival, year, holiday_date, center_name, mtd_sale, is_total FROM hsales "
ORACLE["q_holiday_sales"] = _HS + _HS_COLS + "WHERE is_total OR center_name IS NOT NULL"
ORACLE["q_holiday_fallback"] = f"""
SELECT festival, CAST(year(holiday_date) AS BIGINT) AS year, holiday_date, CAST(NULL AS VARCHAR) AS center_name,
       mtd_sale, TRUE AS is_total
FROM (VALUES {", ".join(f"('{f}', DATE '{d}', CAST({s} AS DOUBLE))" for _, d, f, s in HOLIDAY_CALENDAR)})
     AS c(festival, holiday_date, mtd_sale)"""
ORACLE["q_holiday_sales_total"] = _HS + _HS_COLS + "WHERE is_total"
ORACLE["q_holiday_sales_selected"] = _HS + _HS_COLS + \
    "WHERE year IN (1996, 1998, 2000) AND center_name = 'NATION_7'"


def _wl(festival: str | None = None, center: str | None = None, measure: str = "sales_inc_tax") -> str:
    fw = f"WHERE h.festival = '{festival}'" if festival else ""
    cw = f"WHERE center_name = '{center}'" if center else ""
    return with_ctes(SALES_LINES_SQL, calendar_cte(), HDATES) + f""",
wl AS (
  SELECT h.festival, h.holiday_date, h.year AS holiday_year,
         CAST(l.sale_date - h.holiday_date AS BIGINT) AS days_from_festival,
         l.sale_date, l.invoice_no, l.center_name, l.item_name, l.item_category, l.business_unit,
         l.{measure} AS amount
  FROM (SELECT * FROM sales_lines {cw}) l
  JOIN (SELECT * FROM hdates h {fw}) h
    ON l.sale_date BETWEEN h.holiday_date - 3 AND h.holiday_date + 2
)
"""


def _daily(festival=None, center=None, measure="sales_inc_tax"):
    return _wl(festival, center, measure) + """
SELECT festival, holiday_date, sale_date, days_from_festival,
       CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales,
       CAST(year(sale_date) AS BIGINT) AS year, strftime(sale_date, '%d %b') AS day_label
FROM wl GROUP BY festival, holiday_date, sale_date, days_from_festival"""


ORACLE["q_festival_daily"] = _daily()
ORACLE["q_festival_daily_label"] = _daily("New Year", measure="sales_exc_tax")
ORACLE["q_festival_daily_center"] = _daily(center="NATION_7")

ORACLE["q_festival_performance"] = _wl() + """
SELECT festival, CAST(year(holiday_date) AS BIGINT) AS year, holiday_date, 'All Centers' AS center,
       CAST(total AS DOUBLE) AS total_window_sales, CAST(total AS DOUBLE) / 6.0 AS average_daily_sales
FROM (SELECT festival, holiday_date, coalesce(sum(amount), 0) AS total FROM wl GROUP BY 1, 2)
WHERE total > 0"""

ORACLE["q_festival_performance_by_center"] = _wl(measure="sales_exc_tax") + """
SELECT festival, CAST(year(holiday_date) AS BIGINT) AS year, holiday_date, center_name AS center,
       CAST(total AS DOUBLE) AS total_window_sales, CAST(total AS DOUBLE) / 6.0 AS average_daily_sales
FROM (SELECT festival, holiday_date, center_name, coalesce(sum(amount), 0) AS total
      FROM wl WHERE center_name IS NOT NULL GROUP BY 1, 2, 3)
WHERE total > 0"""

ORACLE["q_festival_long_windows"] = with_ctes(SALES_LINES_SQL, calendar_cte(), HDATES) + """
SELECT festival, CAST(year(holiday_date) AS BIGINT) AS year, holiday_date, center_name AS center,
       CAST(total AS DOUBLE) AS total_window_sales, CAST(total AS DOUBLE) / 200.0 AS average_daily_sales
FROM (SELECT h.festival, h.holiday_date, d.center_name, sum(d.s) AS total
      FROM (SELECT center_name, sale_date, sum(sales_inc_tax) AS s FROM sales_lines GROUP BY 1, 2) d
      JOIN hdates h ON d.sale_date BETWEEN h.holiday_date - 100 AND h.holiday_date + 99
      WHERE d.center_name IS NOT NULL GROUP BY 1, 2, 3)
WHERE total > 0"""

ORACLE["q_festival_category_year"] = _wl("New Year") + """
SELECT item_category, CAST(year(sale_date) AS BIGINT) AS year, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales
FROM wl WHERE item_category IS NOT NULL GROUP BY 1, 2"""

ORACLE["q_festival_category"] = _wl("New Year") + """
SELECT item_category, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales
FROM wl WHERE item_category IS NOT NULL GROUP BY 1"""

ORACLE["q_festival_bu_year"] = _wl("New Year") + """
SELECT business_unit, CAST(year(sale_date) AS BIGINT) AS year, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales
FROM wl WHERE business_unit IS NOT NULL GROUP BY 1, 2"""

ORACLE["q_center_business_top10"] = _wl("New Year") + """,
top AS (SELECT center_name FROM wl WHERE center_name IS NOT NULL GROUP BY 1
        ORDER BY coalesce(sum(amount), 0) DESC, center_name LIMIT 10)
SELECT center_name, business_unit, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales
FROM wl WHERE center_name IN (SELECT center_name FROM top) AND business_unit IS NOT NULL
GROUP BY 1, 2"""

ORACLE["q_festival_top_services"] = _wl("New Year") + """
SELECT item_name, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS sales FROM wl
WHERE item_name IS NOT NULL GROUP BY 1 ORDER BY sales DESC, item_name LIMIT 15"""

ORACLE["q_festival_service_counts"] = _wl("New Year") + """
SELECT item_name, count(*) AS count FROM wl
WHERE item_name IS NOT NULL GROUP BY 1 ORDER BY count DESC, item_name LIMIT 15"""

ORACLE["q_festival_service_summary"] = _wl("New Year") + """
SELECT item_name, item_category, business_unit, revenue, service_count,
       revenue / CAST(service_count AS DOUBLE) AS average_price
FROM (SELECT item_name, item_category, business_unit,
             CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue, count(DISTINCT invoice_no) AS service_count
      FROM wl WHERE item_name IS NOT NULL AND item_category IS NOT NULL AND business_unit IS NOT NULL
      GROUP BY 1, 2, 3)
ORDER BY revenue DESC, item_name, item_category, business_unit LIMIT 20"""

ORACLE["q_festival_traffic"] = _wl("New Year") + """,
daily AS (SELECT sale_date, count(DISTINCT invoice_no) AS invoices,
                 CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue FROM wl GROUP BY 1),
spine AS (SELECT CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS sale_date
          FROM daily)
SELECT s.sale_date, CAST(coalesce(d.invoices, 0) AS BIGINT) AS invoices, coalesce(d.revenue, 0.0) AS revenue,
       s.sale_date IN (SELECT holiday_date FROM hdates WHERE festival = 'New Year') AS is_festival
FROM spine s LEFT JOIN daily d ON s.sale_date = d.sale_date"""

ORACLE["q_festival_traffic_series"] = _wl("New Year") + """,
daily AS (SELECT center_name, item_category, sale_date, count(DISTINCT invoice_no) AS invoices,
                 CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue, bool_or(sale_date = holiday_date) AS on_day
          FROM wl WHERE center_name IS NOT NULL AND item_category IS NOT NULL GROUP BY 1, 2, 3),
spine AS (SELECT center_name, item_category,
                 CAST(unnest(generate_series(min(sale_date), max(sale_date), INTERVAL 1 DAY)) AS DATE) AS sale_date
          FROM daily GROUP BY 1, 2)
SELECT s.center_name, s.item_category, s.sale_date, CAST(coalesce(d.invoices, 0) AS BIGINT) AS invoices,
       coalesce(d.revenue, 0.0) AS revenue, coalesce(d.on_day, false) AS is_festival
FROM spine s LEFT JOIN daily d ON s.center_name = d.center_name AND s.item_category = d.item_category
  AND s.sale_date = d.sale_date"""

_YEARS = [str(y) for y in range(1995, 2002)]
_MONTHNUM = f"CAST(coalesce(list_position({MONTH_LIST}, month), 0) AS INTEGER)"
_OY = """,
oy AS (SELECT year, month, coalesce(sum(mtd_sales), 0) AS s FROM monthly
       WHERE outlet_name = 'NATION_7' AND year IS NOT NULL AND month IS NOT NULL GROUP BY 1, 2),
pv AS (SELECT month, """ + ", ".join(f"sum(s) FILTER (WHERE year = '{y}') AS \"{y}\"" for y in _YEARS) + \
    """ FROM oy GROUP BY month)
"""

ORACLE["q_outlet_pivot"] = BASE.rstrip() + _OY + f"SELECT month, {_MONTHNUM} AS month_num, " + \
    ", ".join(f'CAST("{y}" AS DOUBLE) AS "{y}"' for y in _YEARS) + " FROM pv"

ORACLE["q_outlet_growth"] = BASE.rstrip() + _OY + f"SELECT month, {_MONTHNUM} AS month_num, " + \
    ", ".join(f'{indian_sql(chr(34) + y + chr(34))} AS "{y}"' for y in _YEARS) + ", " + \
    ", ".join(f'{growth_text_sql(chr(34) + c + chr(34), chr(34) + p + chr(34))} AS "growth_{p}_to_{c}"'
              for p, c in zip(_YEARS, _YEARS[1:])) + \
    f", {indian_sql('(CAST(\"2001\" AS DOUBLE) * 1.1)')} AS projected_10pct FROM pv"


_CY = """,
cy AS (SELECT center_name, year, coalesce(sum(sales_inc_tax), 0) AS s FROM sales_lines
       WHERE center_name IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2),
cpv AS (SELECT center_name, """ + ", ".join(
    f"sum(s) FILTER (WHERE year = '{y}') AS \"{y}\"" for y in _YEARS) + """ FROM cy GROUP BY center_name)
"""

ORACLE["q_center_growth"] = with_ctes(SALES_LINES_SQL).rstrip() + _CY + "SELECT center_name, " + \
    ", ".join(f'{indian_sql(chr(34) + y + chr(34))} AS "{y}"' for y in _YEARS) + ", " + \
    ", ".join(f'{growth_round2_sql(chr(34) + c + chr(34), chr(34) + p + chr(34))} AS "growth_{p}_{c}"'
              for p, c in zip(_YEARS, _YEARS[1:])) + " FROM cpv"

ORACLE["q_center_projection"] = _L + f"""
SELECT center_name, latest_year, CAST(l AS DOUBLE) AS latest_sales, CAST(l AS DOUBLE) * 1.1 AS projected,
       {indian_sql('(CAST(l AS DOUBLE) * 1.1)')} AS projected_text
FROM (SELECT center_name, (SELECT max(year) FROM sales_lines WHERE center_name IS NOT NULL) AS latest_year,
             sum(CASE WHEN year = (SELECT max(year) FROM sales_lines WHERE center_name IS NOT NULL)
                      THEN sales_inc_tax END) AS l
      FROM sales_lines WHERE center_name IS NOT NULL AND year IS NOT NULL GROUP BY 1)"""

ORACLE["q_outlet_yearly_growth"] = BASE + f"""
SELECT outlet_name, py || ' to ' || year AS year_comparison, {growth_text_sql('s', 'ps')} AS growth,
       CASE WHEN ps IS NULL OR ps = 0 OR s IS NULL THEN NULL
            ELSE (CAST(s AS DOUBLE) / CAST(ps AS DOUBLE) - 1.0) * 100.0 END AS growth_pct
FROM (SELECT outlet_name, year, s, lag(year) OVER (PARTITION BY outlet_name ORDER BY year) AS py,
             lag(s) OVER (PARTITION BY outlet_name ORDER BY year) AS ps
      FROM (SELECT outlet_name, year, coalesce(sum(mtd_sales), 0) AS s FROM monthly
            WHERE outlet_name = 'NATION_7' AND year IS NOT NULL GROUP BY 1, 2))
WHERE py IS NOT NULL"""

ORACLE["q_scan_csv"] = ORACLE["q_monthly_outlet"]

ORACLE["q_preprocess_monthly"] = BASE + f"""
SELECT year, month, outlet_name, brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales,
       CAST(mtd_bills AS DOUBLE) AS mtd_bills,
       CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv,
       {_MONTHNUM} AS month_num
FROM monthly"""

ORACLE["q_mart_roundtrip"] = ORACLE["q_service_mart"]

ORACLE["q_scan_csv_quoted"] = with_ctes(SALES_LINES_SQL) + """
SELECT '12" ' || item_name || ', "big" \\' AS item_name, CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales
FROM sales_lines GROUP BY item_name"""

ORACLE["q_upsert_latest"] = with_ctes(SALES_LINES_SQL) + """,
cur AS (SELECT year, month, center_name AS outlet_name, coalesce(nullif(business_unit, 'nan'), 'Other') AS brand,
               coalesce(sum(sales_exc_tax), 0) AS mtd_sales, count(DISTINCT invoice_no) AS mtd_bills
        FROM sales_lines WHERE center_name IS NOT NULL GROUP BY 1, 2, 3, 4),
inc AS (SELECT year, month, center_name AS outlet_name, coalesce(nullif(business_unit, 'nan'), 'Other') AS brand,
               coalesce(sum(sales_inc_tax), 0) AS mtd_sales, count(DISTINCT invoice_no) AS mtd_bills
        FROM sales_lines WHERE center_name IS NOT NULL AND year = '2000' GROUP BY 1, 2, 3, 4),
merged AS (SELECT * FROM inc
           UNION ALL SELECT * FROM cur
           WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.year = cur.year AND inc.month = cur.month
                             AND inc.outlet_name = cur.outlet_name AND inc.brand = cur.brand))
SELECT year, month, outlet_name, brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales, mtd_bills,
       CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv
FROM merged"""


def _calendar_file_cte() -> str:
    from .oracle_base import _q, calendar_rows
    values = ",\n    ".join(f"({_q(m)}, {_q(d)}, {_q(f)}, {_q(s)})" for m, d, f, s in calendar_rows())
    return f"""
calfile AS (
  SELECT months, try_cast(date_text AS DATE) AS holiday_date, festival, TRY_CAST(mtd_text AS BIGINT) AS mtd_sale
  FROM (VALUES
    {values}) AS t(months, date_text, festival, mtd_text)
  WHERE try_cast(date_text AS DATE) IS NOT NULL
)"""


ORACLE["q_calendar"] = with_ctes(SALES_LINES_SQL, _calendar_file_cte()) + """,
per_day AS (SELECT month(sale_date) AS hol_month, day(sale_date) AS hol_day,
                   count(DISTINCT year(sale_date)) AS years_with_sales,
                   CAST(coalesce(sum(sales_inc_tax), 0) AS DOUBLE) AS sales_on_day
            FROM sales_lines WHERE sale_date IS NOT NULL GROUP BY 1, 2)
SELECT c.months, c.holiday_date, c.festival, c.mtd_sale,
       CAST(coalesce(p.years_with_sales, 0) AS BIGINT) AS years_with_sales,
       coalesce(p.sales_on_day, 0.0) AS sales_on_day
FROM calfile c LEFT JOIN per_day p ON month(c.holiday_date) = p.hol_month AND day(c.holiday_date) = p.hol_day"""

ORACLE["q_stream_refresh"] = ORACLE["q_monthly_outlet"]

_PARTIAL = ORACLE["q_upsert_latest"]
ORACLE["q_upsert_partial"] = _PARTIAL[:_PARTIAL.index("merged AS")].rstrip().rstrip(",") + """
SELECT year, month, outlet_name, brand, CAST(coalesce(inc.mtd_sales, cur.mtd_sales) AS DOUBLE) AS mtd_sales,
       cur.mtd_bills, CASE WHEN cur.mtd_bills > 0 THEN CAST(cur.mtd_sales AS DOUBLE) / CAST(cur.mtd_bills AS DOUBLE)
                           ELSE 0.0 END AS mtd_abv,
       CASE WHEN inc.year IS NOT NULL THEN 'late' END AS note
FROM cur LEFT JOIN inc USING (year, month, outlet_name, brand)"""

ORACLE["q_delta_mart"] = with_ctes(SALES_LINES_SQL, MONTHLY_MART_SQL).replace(
    "FROM sales_lines\n  WHERE year", "FROM sales_lines\n  WHERE invoice_no % 11 <> 0 AND year") + """
SELECT year, month, outlet_name, brand, CAST(mtd_sales AS DOUBLE) AS mtd_sales, mtd_bills,
       CASE WHEN mtd_bills > 0 THEN CAST(mtd_sales AS DOUBLE) / CAST(mtd_bills AS DOUBLE) ELSE 0.0 END AS mtd_abv
FROM monthly"""

ORACLE["q_service_rules"] = with_ctes(SALES_LINES_SQL) + """,
rules AS (SELECT p_partkey AS priority, lower(substr(p_name, 1 + p_partkey % 10, 2 + p_partkey % 7)) AS keyword,
                 printf('Group %02d', p_partkey % 40) AS label FROM part),
first_rules AS (SELECT keyword, min((priority, label)) AS rule FROM rules WHERE length(keyword) > 0 GROUP BY 1),
names AS (SELECT DISTINCT p_name AS item_name FROM part WHERE p_name IS NOT NULL),
labels AS (SELECT item_name, min(rule) AS rule FROM names JOIN first_rules ON contains(lower(item_name), keyword) GROUP BY 1)
SELECT coalesce(rule[2], 'Other Services') AS service_type, count(*) AS lines,
       count(DISTINCT item_name) AS items, CAST(sum(sales_inc_tax) AS DOUBLE) AS sales
FROM sales_lines LEFT JOIN labels USING (item_name) GROUP BY 1"""

_PROFILED = ["center_name", "item_name", "item_type", "item_category", "item_subcategory", "business_unit", "year", "month"]
ORACLE["q_profile_incremental"] = with_ctes(SALES_LINES_SQL) + " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count(*) AS rows, count(*) - count({c}) AS nulls, min({c}) AS min_value,
       max({c}) AS max_value, count(DISTINCT {c}) < 0.5 * count(*) AS low_cardinality FROM sales_lines""" for c in _PROFILED)
