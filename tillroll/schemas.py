"""Schemas, column names and fixed values of the sales data model."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(28, 6)  # raw amounts of any practical size

# --------------------------------------------------------------------------
# Fixed values. These must stay exactly as they are for results to match the
# behaviour being reproduced (month order, currency characters, classifier
# keywords, built-in holiday calendar, outlet mapping, window bounds).
# --------------------------------------------------------------------------

MONTHS = [
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
]

# Characters removed from money text before numeric coercion.
CURRENCY_CHARS = "$₹,"

# Service classifier: class -> (item_category words, item_subcategory words,
# item_name words); classes are tested in this order, first match wins.
SERVICE_KEYWORDS = [
    ("Hair", ["hair", "haircut", "color"], ["hair", "cut", "color"],
     ["hair", "cut", "color", "style", "blowdry"]),
    ("Skin", ["facial", "skin", "face"], ["facial", "skin", "cleanup"],
     ["facial", "skin", "cleanup"]),
    ("SPA", ["spa", "massage", "therapy"], ["spa", "massage", "therapy"],
     ["spa", "massage", "therapy"]),
]
SERVICE_OTHER = "Other Services"
PRODUCT = "Product"
SERVICE = "Service"

# Built-in calendar used when no holiday file is available: (month, day, name).
BASIC_HOLIDAYS = [
    (1, 1, "New Year"),
    (1, 14, "Pongal/Makar Sankranti"),
    (1, 26, "Republic Day"),
    (8, 15, "Independence Day"),
    (10, 2, "Gandhi Jayanti"),
    (10, 24, "Diwali"),
    (12, 25, "Christmas"),
]

# Dated holiday calendar (Months, Date, Festivals, MTD_Sale), 53 rows, all in
# 2024; only month and day are used to find the same holiday in every year.
HOLIDAY_CALENDAR = [
    ("January", "2024-01-01", "New Year", 1358778),
    ("January", "2024-01-14", "Makar Sankarati", 26259405),
    ("January", "2024-01-15", "Pongal", 27842442),
    ("January", "2024-01-16", "Mattu Ponagal", 29470028),
    ("January", "2024-01-17", "Thituvalluvar Day", 31588147),
    ("January", "2024-01-25", "Thai poosam", 47887520),
    ("January", "2024-01-26", "Republi Day", 50313362),
    ("February", "2024-02-14", "Valatines Days", 29808121),
    ("February", "2024-02-15", "10TH & 12 TH Started Exam", 31383987),
    ("February", "2024-02-19", "CBSC Exam Started", 41240309),
    ("March", "2024-03-01", "12TH Exam Started", 1634619),
    ("March", "2024-03-11", "Ramzan Started", 20354098),
    ("March", "2024-03-13", "10TH CBSC Exam Ends", 23067603),
    ("March", "2024-03-22", "TN 12TH Exam Ends", 40267222),
    ("March", "2024-03-25", "Holi", 47513888),
    ("March", "2024-03-26", "TN 10TH Exam Started", 48752172),
    ("March", "2024-03-28", "Lent Fasting", 51946511),
    ("March", "2024-03-29", "Fasting", 54145228),
    ("April", "2024-04-01", "College Semester Stated", 1985512),
    ("April", "2024-04-04", "CBSC Exam Ends 12TH", 6996202),
    ("April", "2024-04-08", "10Th TN Exam Ends", 16269189),
    ("April", "2024-04-09", "Ugadhi", 17870822),
    ("April", "2024-04-10", "Ramzan Ends", 19804738),
    ("April", "2024-04-13", "Exam Ends", 27624191),
    ("April", "2024-04-14", "Tamil New Year", 30287436),
    ("April", "2024-04-15", "Summar Holiday Begin", 31819730),
    ("April", "2024-04-21", "Maha Veer Jayanthi", 46697046),
    ("April", "2024-04-30", "College Semester Ends", 63796219),
    ("May", "2024-05-01", "Labours Day", 3015944),
    ("May", "2024-05-10", "Akshathirthi", 20787572),
    ("May", "2024-05-12", "Mothers Day", 26788741),
    ("June", "2024-06-03", "School Starts", 8050865),
    ("June", "2024-06-17", "Bakrid", 41130027),
    ("July", "2024-07-15", "Aadi Started", 34341612),
    ("July", "2024-07-17", "Muharam Aadi Month Started", 37395601),
    ("August", "2024-08-15", "Independence Day", 35952036),
    ("August", "2024-08-16", "Aadi ends", 38022181),
    ("August", "2024-08-26", "Krishna Jayanthi", 62404521),
    ("September", "2024-09-05", "Teachers Day", 12303408),
    ("September", "2024-09-07", "Ganesh Chathuthi", 17111664),
    ("September", "2024-09-15", "Onam", 37440618),
    ("September", "2024-09-16", "Mila Un Nabi", 39316795),
    ("September", "2024-09-17", "Puratasi Started", 40842040),
    ("October", "2024-10-02", "Gandhi Jayanti", 4399917),
    ("October", "2024-10-03", "Navarathri Started", 6155190),
    ("October", "2024-10-11", "Saraswathi Pooja", 22524357),
    ("October", "2024-10-12", "Vijaya Dasami", 25178983),
    ("October", "2024-10-17", "Puratasi Ensd", 33960067),
    ("October", "2024-10-31", "Diwali", 45816279),
    ("November", "2024-11-14", "Childrens Day", 29957061),
    ("November", "2024-11-16", "Kathigai Month Started", 35460486),
    ("December", "2024-12-15", "Kathigai Month Ends", 40275333),
    ("December", "2024-12-25", "Christmas", 70247512),
]

# Outlet name -> centre name placeholder mapping.
OUTLET_TO_CENTER = [
    ("T NAGAR", "T. NAGAR CENTER"),
    ("ADYAR", "ADYAR CENTER"),
]

# Festival window: days before / after the holiday date (inclusive), and the
# divisor used for the average daily figure.
WINDOW_BEFORE = 3
WINDOW_AFTER = 2
WINDOW_DIVISOR = 6

PROJECTION_FACTOR = 1.1

# Source header -> canonical snake_case column.
SOURCE_HEADERS = {
    "Sale Date": "sale_date",
    "Invoice No": "invoice_no",
    "Center Name": "center_name",
    "Item Name": "item_name",
    "Item Type": "item_type",
    "Item Category": "item_category",
    "Item Subcategory": "item_subcategory",
    "Business Unit": "business_unit",
    "Sales Collected (Exc.Tax)": "sales_exc_tax",
    "Tax Collected": "tax_collected",
    "Sales Collected (Inc.Tax)": "sales_inc_tax",
    "Redeemed": "redeemed",
    "Collected to Date": "collected_to_date",
    "Collected": "collected",
}
# Database column names of the same measures (second generation loader).
DB_MEASURE_NAMES = {
    "sales_collected_exc_tax": "sales_exc_tax",
    "sales_collected_inc_tax": "sales_inc_tax",
}

MONEY_COLUMNS = ["sales_exc_tax", "tax_collected", "sales_inc_tax",
                 "redeemed", "collected_to_date", "collected"]
DIMENSION_COLUMNS = ["invoice_no", "center_name", "item_name", "item_type",
                     "item_category", "item_subcategory", "business_unit"]

MEASURES = {"inc_tax": "sales_inc_tax", "exc_tax": "sales_exc_tax"}

# Canonical cleaned sale line.
SALES_LINES = T.StructType([
    T.StructField("sale_date", T.DateType(), False),
    T.StructField("invoice_no", T.StringType(), True),
    T.StructField("center_name", T.StringType(), True),
    T.StructField("item_name", T.StringType(), True),
    T.StructField("item_type", T.StringType(), True),
    T.StructField("item_category", T.StringType(), True),
    T.StructField("item_subcategory", T.StringType(), True),
    T.StructField("business_unit", T.StringType(), True),
    T.StructField("sales_exc_tax", MONEY, True),
    T.StructField("tax_collected", MONEY, True),
    T.StructField("sales_inc_tax", MONEY, True),
    T.StructField("redeemed", MONEY, True),
    T.StructField("collected_to_date", MONEY, True),
    T.StructField("collected", MONEY, True),
])

# Raw sale lines as text, with source headers (CSV / workbook input).
RAW_SALES_TEXT = T.StructType(
    [T.StructField(h, T.StringType(), True) for h in SOURCE_HEADERS])

# Holiday calendar file.
CALENDAR_TEXT = T.StructType([
    T.StructField("Months", T.StringType(), True),
    T.StructField("Date", T.StringType(), True),
    T.StructField("Festivals", T.StringType(), True),
    T.StructField("MTD_Sale", T.StringType(), True),
])

# Monthly outlet mart.
MONTHLY_MART = T.StructType([
    T.StructField("year", T.StringType(), True),
    T.StructField("month", T.StringType(), True),
    T.StructField("outlet_name", T.StringType(), True),
    T.StructField("brand", T.StringType(), True),
    T.StructField("mtd_sales", T.DoubleType(), True),
    T.StructField("mtd_bills", T.LongType(), True),
    T.StructField("mtd_abv", T.DoubleType(), True),
])

# Service summary mart.
SERVICE_MART = T.StructType([
    T.StructField("center_name", T.StringType(), True),
    T.StructField("year", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("service_type", T.StringType(), True),
    T.StructField("item_category", T.StringType(), True),
    T.StructField("item_subcategory", T.StringType(), True),
    T.StructField("business_unit", T.StringType(), True),
    T.StructField("total_sales", T.DoubleType(), True),
    T.StructField("transaction_count", T.LongType(), True),
])
