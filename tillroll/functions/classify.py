"""Product / service split and keyword service classification as CASE WHEN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import PRODUCT, SERVICE, SERVICE_KEYWORDS, SERVICE_OTHER


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def category(item_type: Column | str, product_value: str = PRODUCT) -> Column:
    """'Product' when the item type equals ``product_value``, else 'Service'."""
    return F.when(_col(item_type) == F.lit(product_value), F.lit(PRODUCT)).otherwise(F.lit(SERVICE))


def _any_substring(c: Column, words) -> Column:
    text = F.lower(F.coalesce(c.cast("string"), F.lit("")))
    return reduce(lambda a, b: a | b, [text.contains(F.lit(w)) for w in words], F.lit(False))


def service_type(item_type: Column | str = "item_type",
                 item_category: Column | str = "item_category",
                 item_subcategory: Column | str = "item_subcategory",
                 item_name: Column | str = "item_name",
                 keywords=SERVICE_KEYWORDS,
                 product_value: str = PRODUCT) -> Column:
    """Classify a sale line: products short-circuit, then the keyword classes
    in order (case-insensitive substring match on category, subcategory or
    name), first match wins, else 'Other Services'.

    ``keywords`` is data: a list of ``(label, category_words,
    subcategory_words, name_words)``.
    """
    cat, sub, name = _col(item_category), _col(item_subcategory), _col(item_name)
    expr = F.when(category(item_type, product_value) != F.lit(SERVICE), F.lit(PRODUCT))
    for label, cat_words, sub_words, name_words in keywords:
        hit = _any_substring(cat, cat_words) | _any_substring(sub, sub_words) \
            | _any_substring(name, name_words)
        expr = expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(SERVICE_OTHER))
