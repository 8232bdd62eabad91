"""Display formatting as native Column expressions (no Python UDFs).

All formatters take and return ``Column`` so they stay inside whole-stage
codegen. Rounding follows Python semantics: ``round`` / ``%.2f`` round the
exact binary value half-to-even, which is what ``bround`` (to integers) and
``format_number(x, '0.00')`` (Java ``DecimalFormat``) do as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUPEE = "₹"
# Insert a comma before every group of two digits that is followed by the
# last three digits (Indian 2-2-3 grouping); never after a sign.
_INDIAN_GROUPS = r"(?<=\d)(?=(\d\d)+\d$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fixed2(x: Column) -> Column:
    """Two decimals, no grouping, half-even on the exact binary value."""
    return F.call_function("format_number", x, F.lit("0.00"))


def indian_digits(c: Column | str) -> Column:
    """Integer text with Indian digit grouping: 1234567 -> '12,34,567'."""
    x = _col(c).cast("double")
    whole = F.coalesce(F.bround(x, 0).try_cast("decimal(38,0)").cast("string"),
                       F.call_function("format_number", x, F.lit("0")))
    return F.regexp_replace(whole, _INDIAN_GROUPS, ",")


def _missing(x: Column) -> Column:
    # NULL and NaN are both "missing" for display, as in dataframe libraries.
    return x.isNull() | F.isnan(x)


def money(c: Column | str, fmt: str = "full") -> Column:
    """'₹12,34,567' (full) or '₹12.35 Lakhs' (lakhs); NULL, NaN and 0 give
    '₹0'; infinities print as '₹inf' / '₹-inf'."""
    x = _col(c).cast("double")
    if fmt == "lakhs":
        body = F.concat(fixed2(x / F.lit(100000.0)), F.lit(" Lakhs"))
    elif fmt == "full":
        body = indian_digits(x)
    else:
        raise ValueError(f"unknown money format {fmt!r}")
    return (F.when(_missing(x) | (x == 0), F.lit(RUPEE + "0"))
            .when(x == F.lit(float("inf")), F.lit(RUPEE + "inf"))
            .when(x == F.lit(float("-inf")), F.lit(RUPEE + "-inf"))
            .otherwise(F.concat(F.lit(RUPEE), body)))


def money_plain(c: Column | str) -> Column:
    """Money text without the currency sign ('12,34,567')."""
    return F.translate(money(c), RUPEE, "")


def percentage(c: Column | str, include_sign: bool = True) -> Column:
    """'12.34%' ('12.34' without sign); NULL and NaN give '0%'."""
    x = _col(c).cast("double")
    body = fixed2(x)
    if include_sign:
        body = F.concat(body, F.lit("%"))
    return F.when(_missing(x), F.lit("0%")).otherwise(body)


def _whole(c: Column | str) -> Column:
    # Truncated toward zero; NULL for NaN, infinities and 10^18 or more.
    x = _col(c).cast("double")
    return F.when(F.abs(x) < 1e18, x).cast("bigint").cast("decimal(38,0)")


def western_int(c: Column | str) -> Column:
    """Truncate to an integer and group thousands: 1234.9 -> '1,234'; NULL for
    NaN and infinities."""
    return F.format_number(_whole(c), 0)


def int_text(c: Column | str) -> Column:
    """Truncate to an integer and print it without grouping; NULL for NaN and
    infinities."""
    return _whole(c).cast("string")


def growth_pct(cur: Column | str, prev: Column | str) -> Column:
    """Numeric growth in percent; NULL when the base is NULL or zero."""
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    return F.when(prev.isNull() | (prev == 0) | cur.isNull(), F.lit(None).cast("double")) \
        .otherwise((cur / prev - F.lit(1.0)) * F.lit(100.0))


def _non_finite_growth(cur: Column, prev: Column) -> Column:
    # What float division prints when the base is missing or zero.
    return (F.when(cur.isNull() | prev.isNull(), F.lit("nan%"))
            .when(cur > 0, F.lit("inf%"))
            .when(cur < 0, F.lit("-inf%"))
            .otherwise(F.lit("nan%")))


def growth_text(cur: Column | str, prev: Column | str) -> Column:
    """Growth formatted as '%.2f%%'; 'nan%' / 'inf%' where division fails."""
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    finite = F.concat(fixed2(growth_pct(cur, prev)), F.lit("%"))
    return F.when(cur.isNull() | prev.isNull() | (prev == 0),
                  _non_finite_growth(cur, prev)).otherwise(finite)


def growth_round2_text(cur: Column | str, prev: Column | str) -> Column:
    """Growth rounded half-even to 2 places on the scaled value, then str()+'%'."""
    cur, prev = _col(cur).cast("double"), _col(prev).cast("double")
    rounded = F.rint(growth_pct(cur, prev) * F.lit(100.0)) / F.lit(100.0)
    # A double prints an exponent from 10^7 on; plain digits do not.
    plain = F.regexp_replace(rounded.try_cast("decimal(38,2)").cast("string"), "0$", "")
    text = F.when(F.abs(rounded) >= 1e7, F.coalesce(plain, rounded.cast("string"))).otherwise(
        rounded.cast("string"))
    return F.when(cur.isNull() | prev.isNull() | (prev == 0),
                  _non_finite_growth(cur, prev)) \
        .otherwise(F.concat(text, F.lit("%")))


_NAMED = {
    "money": money,
    "lakhs": lambda c: money(c, "lakhs"),
    "money_plain": money_plain,
    "percentage": percentage,
    "int": western_int,
}


def format_column(c: Column | str, fmt: str | Callable[[Column], Column] = "money") -> Column:
    """Format by name, or with a caller-supplied ``Column -> Column`` function."""
    if callable(fmt):
        out = fmt(_col(c))
        if not isinstance(out, Column):
            raise TypeError("a custom formatter must map a Column to a Column")
        return out
    try:
        return _NAMED[fmt](c)
    except KeyError:
        raise ValueError(f"unknown format {fmt!r}; use one of {sorted(_NAMED)}") from None


def format_money_columns(df, columns, fmt: str = "money"):
    """Format every listed column that exists; others are left alone."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: format_column(c, fmt) for c in present})
