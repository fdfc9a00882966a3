"""Explorer levels and the hierarchical drill-down.

The per-level lookups mirror the explorer's lazy loading (one status, then a
year, then a month); ``drilldown`` computes all four levels,
each from the finer one, for any set of statuses.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlens.functions.text import month_abbr, month_full
from alertlens.operators.filters import filter_statuses, lookup
from alertlens.operators.metrics import C, D, M, N, Y


def explorer_years(mart: DataFrame, name: Any) -> DataFrame:
    """Years of one status, newest first (A10). No name -> empty."""
    df = lookup(mart, name)
    return (
        df.groupBy(Y).agg(F.sum(C).cast("bigint").alias("total_count"))
        .select(F.col(Y).cast("bigint").alias("year"), "total_count")
        .orderBy(F.desc("year"))
    )


def explorer_months(mart: DataFrame, name: Any, year: Any,
                    month_labels: str = "full") -> DataFrame:
    """Months of one status and year (A11). Missing argument -> empty.

    ``month_labels='abbr'`` gives 'Jan' instead of 'January' (D7).
    """
    df = lookup(mart, name, years=year, need_year=True)
    label_fn = month_abbr if month_labels == "abbr" else month_full
    return (
        df.groupBy(M).agg(F.sum(C).cast("bigint").alias("total_count"))
        .select(label_fn(F.col(M)).alias("month"), F.col(M).alias("month_number"),
                "total_count")
        .orderBy("month_number")
    )


def explorer_dates(mart: DataFrame, name: Any, year: Any, month: Any) -> DataFrame:
    """Days of one status, year and month as ISO text."""
    df = lookup(mart, name, years=year, months=month, need_year=True, need_month=True)
    return (
        df.groupBy(D).agg(F.sum(C).cast("bigint").alias("total_count"))
        .select(F.date_format(D, "yyyy-MM-dd").alias("date"), "total_count")
        .orderBy("date")
    )


def drilldown(mart: DataFrame, names: Any = None, month_labels: str = "full") -> DataFrame:
    """Totals at status / year / month / day depth, each from the finer one.

    Output is in tree (pre-order) order: status ascending, year descending,
    month and day ascending, each parent before its children.
    ``month_labels`` picks 'full' (explorer) or 'abbr' (static page) names.
    """
    # Each level is the sum of the finer one, so a mart row is read once and never multiplied.
    # Dealt by name (a name has a row a day at most), no level needs a shuffle of its own.
    rows = filter_statuses(mart, names).select(N, Y, M, D, C).repartition(N)
    total = F.sum(C).cast("bigint").alias(C)
    days = rows.groupBy(N, Y, M, D).agg(total)
    months = days.groupBy(N, Y, M).agg(total)
    years = months.groupBy(N, Y).agg(total)
    statuses = years.groupBy(N).agg(total)
    tree = days.withColumn("level", F.lit(4))
    for level, part in ((3, months), (2, years), (1, statuses)):
        tree = tree.unionByName(part.withColumn("level", F.lit(level)), allowMissingColumns=True)
    label_fn = month_abbr if month_labels == "abbr" else month_full
    return tree.select(
        "level", N, Y, M,
        F.when(F.col(M).isNotNull(), label_fn(F.col(M))).alias("month_label"),
        F.date_format(D, "yyyy-MM-dd").alias("date"),
        F.col(C).alias("total_count"),
    ).orderBy(F.asc_nulls_first(N), F.desc_nulls_first(Y), F.asc_nulls_first(M),
              F.asc_nulls_first("date"))
