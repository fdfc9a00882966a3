"""Analytic operators over aggregated series.

Windows here run over per-year totals only (a handful of rows); an
unpartitioned window over raw alerts or over the mart would put everything
in one task and is never used. Top-k uses ``orderBy().limit(k)``, which Spark
plans as a per-partition top-k followed by a merge (TakeOrderedAndProject),
so it scales with the number of statuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertlens.operators.metrics import C, N, Y, status_totals, trend_total


def yearly_totals(mart: DataFrame) -> DataFrame:
    return mart.groupBy(Y).agg(F.sum(C).cast("bigint").alias(C))


def yoy_change(mart: DataFrame) -> DataFrame:
    """Change against the previous year *present* (W1, W2); first year dropped."""
    w = Window.orderBy(Y)
    totals = yearly_totals(mart).withColumn("prev", F.lag(C).over(w))
    return (
        totals.filter(F.col("prev").isNotNull())
        .select(Y, C, F.col("prev").cast("bigint").alias("prev"),
                (F.col(C) - F.col("prev")).cast("bigint").alias("change"))
        .orderBy(Y)
    )


def top_statuses(mart: DataFrame, k: int = 3) -> DataFrame:
    """The k largest statuses with their rank (W6); ties by name, NULL first."""
    top = status_totals(mart).orderBy(F.desc(C), F.asc_nulls_first(N)).limit(k)
    w = Window.orderBy(F.desc(C), F.asc_nulls_first(N))
    return top.select(F.row_number().over(w).cast("int").alias("rank"), N, C).orderBy("rank")


def status_share(mart: DataFrame) -> DataFrame:
    """Each status' share of the total in percent.

    The denominator (NULL names included) is a scalar subquery, evaluated
    once; no window over all statuses and no join.
    """
    totals = status_totals(mart)
    grand = mart.agg(F.sum(C).cast("double")).scalar()
    return totals.select(
        N, C, (F.col(C).cast("double") / grand * F.lit(100.0)).alias("share_pct")
    ).orderBy(F.desc(C), F.asc_nulls_first(N))


def peak_period(mart: DataFrame) -> DataFrame:
    """Month with the largest total; ties -> earliest month."""
    return trend_total(mart).orderBy(F.desc(C), F.asc("period_order")).limit(1)


def peak_year(mart: DataFrame) -> DataFrame:
    """Year with the largest total; ties -> earliest year."""
    return yearly_totals(mart).orderBy(F.desc(C), F.asc(Y)).limit(1)
