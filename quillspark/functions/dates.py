"""Fiscal periods and dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The forms in which documents state their date, in the order in which they are tried; case is ignored.
DATE_PATTERNS = (
    r"(?i)Q[1-4]\s*20\d{2}",
    r"20\d{2}-\d{2}-\d{2}",
    r"(?i)(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+20\d{2}",
    r"(?i)FY\s*20\d{2}",
)


def fiscal_year(day: Column) -> Column:
    """The year that ends in October."""
    return (F.year(day) + (F.month(day) >= 11).cast("int")).cast("long")


def fiscal_quarter(day: Column) -> Column:
    """1 for November to January, and so on."""
    return (F.floor(F.pmod(F.month(day) - 11, F.lit(12)) / 3) + 1).cast("long")


def first_date(text: Column) -> Column:
    """The first match of the first pattern that matches; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in DATE_PATTERNS])
