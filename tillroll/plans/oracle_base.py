"""DuckDB SQL shared by the oracle queries: the same sale-line view over the
test tables as ``sources.testbed.sales_lines``, written independently in SQL."""

from __future__ import annotations

from ..schemas import BASIC_HOLIDAYS, HOLIDAY_CALENDAR

SALES_LINES_SQL = """
sales_lines AS (
  SELECT CAST(o.o_orderdate AS DATE) AS sale_date,
         l.l_orderkey AS invoice_no,
         n.n_name AS center_name,
         p.p_name AS item_name,
         p.p_type AS item_type,
         p.p_brand AS item_category,
         split_part(p.p_name, ' ', -1) AS item_subcategory,
         c.c_mktsegment AS business_unit,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS sales_exc_tax,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              * CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(18,6)) AS tax_collected,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              * (1 + CAST(l.l_tax AS DECIMAL(4,2))) AS DECIMAL(18,6)) AS sales_inc_tax,
         CAST(year(CAST(o.o_orderdate AS DATE)) AS VARCHAR) AS year,
         strftime(CAST(o.o_orderdate AS DATE), '%B') AS month,
         month(CAST(o.o_orderdate AS DATE)) AS month_num
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
)"""

MONTHLY_MART_SQL = """
monthly AS (
  SELECT year, month, center_name AS outlet_name, coalesce(nullif(business_unit, 'nan'), 'Other') AS brand,
         coalesce(sum(sales_inc_tax), 0) AS mtd_sales,
         count(DISTINCT invoice_no) AS mtd_bills
  FROM sales_lines
  WHERE year IS NOT NULL AND month IS NOT NULL AND center_name IS NOT NULL
  GROUP BY 1, 2, 3, 4
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def indian_sql(x: str) -> str:
    """DuckDB text for the Indian-grouped money format of numeric expression x."""
    d = f"CAST(abs(CAST(round_even(CAST({x} AS DOUBLE), 0) AS DECIMAL(38,0))) AS VARCHAR)"
    sign = f"CASE WHEN round_even(CAST({x} AS DOUBLE), 0) < 0 THEN '-' ELSE '' END"
    grouped = (f"CASE WHEN length({d}) > 3 THEN "
               f"reverse(rtrim(regexp_replace(reverse(substr({d}, 1, length({d}) - 3)), "
               f"'(\\d\\d)', '\\1,', 'g'), ',')) || ',' || right({d}, 3) ELSE {d} END")
    return (f"CASE WHEN {x} IS NULL OR CAST({x} AS DOUBLE) = 0 THEN '₹0' "
            f"ELSE '₹' || {sign} || {grouped} END")


def lakhs_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR CAST({x} AS DOUBLE) = 0 THEN '₹0' "
            f"ELSE '₹' || printf('%.2f', CAST({x} AS DOUBLE) / 100000.0) || ' Lakhs' END")


def pct_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '0%' ELSE printf('%.2f', CAST({x} AS DOUBLE)) || '%' END"


def growth_text_sql(cur: str, prev: str) -> str:
    c, p = f"CAST({cur} AS DOUBLE)", f"CAST({prev} AS DOUBLE)"
    return (f"CASE WHEN {c} IS NULL OR {p} IS NULL THEN 'nan%' "
            f"WHEN {p} = 0 THEN CASE WHEN {c} > 0 THEN 'inf%' WHEN {c} < 0 THEN '-inf%' ELSE 'nan%' END "
            f"ELSE printf('%.2f', ({c} / {p} - 1.0) * 100.0) || '%' END")


def growth_round2_sql(cur: str, prev: str) -> str:
    c, p = f"CAST({cur} AS DOUBLE)", f"CAST({prev} AS DOUBLE)"
    return (f"CASE WHEN {c} IS NULL OR {p} IS NULL THEN 'nan%' "
            f"WHEN {p} = 0 THEN CASE WHEN {c} > 0 THEN 'inf%' WHEN {c} < 0 THEN '-inf%' ELSE 'nan%' END "
            f"ELSE CAST(round_even(({c} / {p} - 1.0) * 100.0 * 100.0, 0) / 100.0 AS VARCHAR) || '%' END")


def calendar_rows() -> list[tuple[str, str, str, str]]:
    """The built-in holiday calendar as text rows (Months, Date, Festivals, MTD_Sale)."""
    return [(m, d, f, str(s)) for m, d, f, s in HOLIDAY_CALENDAR]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def calendar_cte(name: str = "calendar") -> str:
    """Holiday file rows as (festival, hol_month, hol_day); bad dates dropped."""
    values = ",\n    ".join(f"({_q(m)}, {_q(d)}, {_q(f)})" for m, d, f, _ in calendar_rows())
    return f"""
{name} AS (
  SELECT DISTINCT festival, month(d) AS hol_month, day(d) AS hol_day
  FROM (SELECT festival, try_cast(date_text AS DATE) AS d
        FROM (VALUES
    {values}) AS t(months, date_text, festival))
  WHERE d IS NOT NULL
)"""


def basic_calendar_cte(name: str = "calendar") -> str:
    values = ", ".join(f"({m}, {d}, {_q(f)})" for m, d, f in BASIC_HOLIDAYS)
    return f"""
{name} AS (
  SELECT DISTINCT festival, hol_month, hol_day FROM (VALUES {values}) AS t(hol_month, hol_day, festival)
)"""
