"""Numbers and quantities written in text, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number as written: digits with decimal and grouping signs between them.
NUMBER = r"\d(?:[\d.,'’    ]*\d)?"


def written_number(text: Column) -> Column:
    """DOUBLE of a number text in any of the usual formats; null if it is none.

    The decimal sign is a point or a comma, thousands are grouped by point, comma, apostrophe or (no-break) space. A sign
    followed by exactly three last digits groups thousands; of two different signs the last is the decimal one; a sign
    that comes twice groups.
    """
    t = F.regexp_replace(F.trim(text), r"[\s   '’]", "")
    sign = F.when(F.substring(t, 1, 1).isin("-", "−"), -1.0).otherwise(1.0)
    t = F.regexp_replace(t, "^[-−+]", "")
    tail = F.regexp_extract(t, r"[.,](\d*)$", 1)
    last = F.regexp_extract(t, r"([.,])\d*$", 1)
    several = F.length(t) - F.length(F.replace(t, last, F.lit(""))) > 1
    grouped = (F.length(tail) == 3) | several
    plain = F.when(last == "", t).when(grouped, F.regexp_replace(t, "[.,]", "")).otherwise(F.concat(F.regexp_replace(F.regexp_extract(t, r"^(.*)[.,]\d*$", 1), "[.,]", ""), F.lit("."), tail))
    return F.when(t.rlike(r"^\d[\d.,]*$"), sign * plain.try_cast("double"))
