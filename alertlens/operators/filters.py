"""Selections over the mart.

Selections are Python arguments, normalised on the driver into ``isin``
lists; the filter itself is a built-in predicate. Over a stored mart the year
list becomes a partition filter and the name list a pushed ``In`` filter.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlens.config import NO_FILTER_VALUES
from alertlens.operators.mart import year_range_predicate

# Mart column of each selectable dimension, and what an item is converted to.
_DIMENSIONS: dict[str, tuple[str, Callable[[Any], Any]]] = {
    "names": ("NAME", lambda item: str(item).strip()),
    "years": ("year_creation", int),
    "months": ("mth_creation", int),
}


def normalize_selection(value: Any) -> list:
    """The selected items; none of them means no filter."""
    many = value if isinstance(value, (list, tuple, set, frozenset)) else (value,)
    return [item for item in many if item not in NO_FILTER_VALUES]


def selection_predicate(dimension: str, value: Any) -> Column:
    """True where a row's ``dimension`` is among the selected items.

    An item that cannot be converted makes the predicate false, which plans as
    an empty relation. A year selection also bounds the date: over a mart that
    is not stored, only a range of dates reaches the scan of the raw alerts.
    """
    column, convert = _DIMENSIONS[dimension]
    try:
        items = [convert(item) for item in normalize_selection(value)]
    except (TypeError, ValueError):
        return F.lit(False)
    if not items:
        return F.lit(True)
    chosen = F.col(column).isin(items)
    if dimension == "years" and all(0 < y < 9999 for y in items):
        chosen = chosen & year_range_predicate(F.col("dt_creation"), items, "date")
    return chosen


def apply_filters(mart: DataFrame, names: Any = None, years: Any = None,
                  months: Any = None) -> DataFrame:
    """OR within a dimension, AND across dimensions.

    Names are stripped and compared exactly; NULL names never match. A year
    or month that is not an integer yields no rows, with the full schema.
    """
    chosen = {"names": names, "years": years, "months": months}
    for dimension, value in chosen.items():
        mart = mart.filter(selection_predicate(dimension, value))
    return mart


def _absent(value: Any) -> bool:
    """An explorer argument that was not given: None, "" or an empty list.

    "ALL" counts as given; it then means "no filter on that level".
    """
    if isinstance(value, (list, tuple, set, frozenset)):
        return len(value) == 0
    return value is None or value == ""


def lookup(mart: DataFrame, names: Any, years: Any = None, months: Any = None,
           need_year: bool = False, need_month: bool = False) -> DataFrame:
    """Explorer lookup (P16): every needed argument must be given, else empty."""
    missing = _absent(names)
    missing |= need_year and _absent(years)
    missing |= need_month and _absent(months)
    if missing:
        return mart.limit(0)
    return apply_filters(mart, names, years if need_year else None,
                         months if need_month else None)


def filter_statuses(mart: DataFrame, names: Any = None) -> DataFrame:
    """Multi-status explorer filter (P17): empty selection keeps every row."""
    return apply_filters(mart, names=names)
