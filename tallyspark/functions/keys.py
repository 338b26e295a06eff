"""Keys, codes and measures of goods lines as Catalyst expressions; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that stand for one another in printed invoice and contract numbers.
CYRILLIC_PRINT, LATIN_PRINT = "АВЕКМНОРСТУХавекмнорстух", "ABEKMHOPCTYXabekmhopctyx"


def empty_to_null(x: Column) -> Column:
    return F.when(F.trim(x) != "", x)


def match_key(article: Column) -> Column:
    """Upper case, Latin and Cyrillic letters and digits only; an empty key is null."""
    key = F.regexp_replace(F.upper(article), "[^0-9A-Za-zА-Яа-яЁё]+", "")
    return F.when(key != "", key)


def normalize_article(article: Column) -> Column:
    """Upper case without any white space; hyphens and look-alike letters stay."""
    return F.regexp_replace(F.upper(article), "[\\s  -​ 　﻿]+", "")


def fold_print(text: Column) -> Column:
    return F.translate(text, CYRILLIC_PRINT, LATIN_PRINT)


def code_digits(code: Column, most: int = 13) -> Column:
    """The 6 to 13 digits of a tariff code in dotted or spaced writing, cut to `most`; null for anything else."""
    d = F.regexp_replace(F.regexp_replace(F.trim(code), "\\.0$", ""), "[. ]", "")
    return F.when(d.rlike("^[0-9]{6,13}$"), F.substring(d, 1, most))


def width_in_metres(width: Column) -> Column:
    """A bare width of 20 to 500 is in centimetres."""
    return F.when((width >= 20) & (width <= 500), width / 100).otherwise(width)


def area(metres: Column, width: Column) -> Column:
    w = F.when(width > 20, width / 100).otherwise(width)
    return F.when((metres > 0) & (w > 0), F.round((metres * w).cast("decimal(18,6)"), 4).cast("double"))


def lot_token(qty: Column, metres: Column | None = None) -> Column:
    """What tells lots of one article apart: the quantity, else the metres, to six decimals; empty without either."""
    n = F.coalesce(qty, metres) if metres is not None else qty
    return F.coalesce(F.round(n.cast("decimal(24,8)"), 6).cast("string"), F.lit(""))


def nearly_equal(left: Column, right: Column, absolute: float, share: float = 0.0) -> Column:
    """Equal within max(absolute, share of left); two nulls are equal, one isn't."""
    return F.when(left.isNull() | right.isNull(), left.isNull() & right.isNull()).otherwise(F.abs(left - right) <= F.greatest(F.lit(absolute), F.abs(left) * share))
