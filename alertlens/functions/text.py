"""Column expressions for strings, labels and number formatting.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlens.config import NONE_TEXT, WHITESPACE, WORD_DECREASED, WORD_INCREASED


def strip_ws(c: Column) -> Column:
    """Remove Unicode whitespace at both ends (F2).

    ``trim`` with an explicit character set, not the default ``trim`` (which
    only removes spaces) and not a regex (slower per row).
    """
    return F.trim(c, F.lit(WHITESPACE))


def as_clean_string(c: Column) -> Column:
    """cast to string, then strip (F1 + F2)."""
    return strip_ws(c.cast("string"))


def month_abbr(month: Column) -> Column:
    """1 -> 'Jan' (F7). Spark formats with the US locale."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMM")


def month_full(month: Column) -> Column:
    """1 -> 'January' (F8)."""
    return F.date_format(F.make_date(F.lit(2000), month, F.lit(1)), "MMMM")


def period_label(year: Column, month: Column) -> Column:
    """(2024, 3) -> 'Mar 2024' (F9)."""
    return F.concat_ws(" ", month_abbr(month), year.cast("string"))


def period_order(year: Column, month: Column) -> Column:
    """(2024, 3) -> 202403, kept INT."""
    return (year * F.lit(100) + month).cast("int")


def thousands(c: Column) -> Column:
    """Integer with ',' grouping: 12004 -> '12,004' (F15)."""
    return F.format_string("%,d", c.cast("bigint"))


def round_half_even_int(c: Column) -> Column:
    """Round a double to a whole number, ties to even (matches ``:,.0f``)."""
    return F.bround(c, 0).cast("bigint")


def one_decimal(c: Column) -> Column:
    """Percent text with one decimal (F16), rounded half-up first."""
    return F.format_string("%.1f", F.round(c, 1))


def name_text(c: Column) -> Column:
    """Status name as text; null becomes 'None' like Python's ``str(None)``."""
    return F.coalesce(c, F.lit(NONE_TEXT))


def direction_word(diff: Column) -> Column:
    """'increased' when diff >= 0 else 'decreased' (F19)."""
    return F.when(diff >= 0, F.lit(WORD_INCREASED)).otherwise(F.lit(WORD_DECREASED))
