"""Numbers and dates from text; what can't be read is null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def brazilian_number(c: Column) -> Column:
    """``R$ 1.234,56``, ``1234,5``, ``1234.5`` as doubles: with a comma, dots group thousands."""
    x = F.regexp_replace(c, r"[^0-9,.\-]", "")
    dotted = F.when(F.contains(x, F.lit(",")), F.replace(F.replace(x, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(x)
    return F.nullif(dotted, F.lit("")).try_cast("double")


def leading_int(c: Column) -> Column:
    """First run of digits, as in ``M4``."""
    return F.nullif(F.regexp_extract(c, "([0-9]+)", 1), F.lit("")).try_cast("int")


def any_date(c: Column) -> Column:
    """ISO, dd/mm/yyyy, or an ISO date inside other text."""
    iso = F.regexp_extract(c, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    d, m, y = (F.regexp_extract(c, "([0-9]{2})/([0-9]{2})/([0-9]{4})", i) for i in (1, 2, 3))
    return F.coalesce(F.nullif(iso, F.lit("")).try_cast("date"), F.nullif(F.concat(y, F.lit("-"), m, F.lit("-"), d), F.lit("--")).try_cast("date"))


def age_hours(as_of: Column, at: Column) -> Column:
    """Hours from ``at`` to ``as_of``; null stays null."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 3.6e9
