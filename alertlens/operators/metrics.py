"""Aggregates over the (filtered) mart.

Every function takes a mart-shaped frame (already filtered or not) and
returns a lazy DataFrame with a fixed schema, empty input included. Inputs
are bounded by days x statuses, so the sorts here are cheap; the heavy
lifting happened once in the mart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertlens.config import CLOSED_PREFIX, ESCALATED_NAME
from alertlens.functions.text import month_full, period_label, period_order

Y, M, D, N, C = "year_creation", "mth_creation", "dt_creation", "NAME", "Count"


def _sum_count(alias: str = C) -> Column:
    return F.sum(C).cast("bigint").alias(alias)


# -- A2 ---------------------------------------------------------------------

def names_totals(mart: DataFrame) -> DataFrame:
    """Per status name (NULL included) -> total_count, by name."""
    return mart.groupBy(N).agg(_sum_count("total_count")).orderBy(F.asc_nulls_first(N))


# -- A3-A5 ------------------------------------------------------------------

def kpi_sums(mart: DataFrame, closed_prefix: str = CLOSED_PREFIX,
             escalated_name: str = ESCALATED_NAME,
             null_name_label: str | None = None) -> DataFrame:
    """Total, closed, open and escalated sums in one pass.

    A NULL name counts in the total only; with ``null_name_label`` (the static
    page prints it as 'None') it is that text instead, hence open.
    """
    name = F.col(N) if null_name_label is None else F.coalesce(F.col(N), F.lit(null_name_label))
    closed = name.startswith(closed_prefix)
    return mart.agg(
        F.coalesce(F.sum(C), F.lit(0)).cast("bigint").alias("total_alerts"),
        F.coalesce(F.sum(F.when(closed, F.col(C))), F.lit(0)).cast("bigint").alias("closed_alerts"),
        F.coalesce(F.sum(F.when(~closed, F.col(C))), F.lit(0)).cast("bigint").alias("open_alerts"),
        F.coalesce(F.sum(F.when(name == F.lit(escalated_name), F.col(C))), F.lit(0))
        .cast("bigint").alias("escalated_alerts"),
    )


def _rate(part: str, total: str) -> Column:
    """part / total * 100 rounded to one decimal; 0.0 on an empty total."""
    ratio = F.try_divide(F.col(part).cast("double"), F.col(total).cast("double"))
    return F.round(F.coalesce(ratio * F.lit(100.0), F.lit(0.0)), 1)


def kpis(mart: DataFrame, closed_prefix: str = CLOSED_PREFIX,
         escalated_name: str = ESCALATED_NAME, null_name_label: str | None = None) -> DataFrame:
    """One row: totals plus closure and escalation rates."""
    sums = kpi_sums(mart, closed_prefix, escalated_name, null_name_label)
    return sums.select(
        "total_alerts", "open_alerts", "closed_alerts", "escalated_alerts",
        _rate("closed_alerts", "total_alerts").alias("closure_rate"),
        _rate("escalated_alerts", "total_alerts").alias("escalation_rate"),
    )


# -- A6 ---------------------------------------------------------------------

def status_totals(mart: DataFrame) -> DataFrame:
    """Per status name -> Count (unsorted building block)."""
    return mart.groupBy(N).agg(_sum_count())


def status_distribution(mart: DataFrame) -> DataFrame:
    """Per status, largest first; ties by name (NULL first)."""
    return status_totals(mart).orderBy(F.desc(C), F.asc_nulls_first(N))


# -- A7 / A8 ----------------------------------------------------------------

def _with_period(df: DataFrame) -> DataFrame:
    return df.withColumn("period_label", period_label(F.col(Y), F.col(M))) \
             .withColumn("period_order", period_order(F.col(Y), F.col(M)))


def trend_total(mart: DataFrame) -> DataFrame:
    """Per (year, month): Count, period_label, period_order."""
    out = mart.groupBy(Y, M).agg(_sum_count())
    return _with_period(out).orderBy(Y, M)


def trend_compare(mart: DataFrame) -> DataFrame:
    """Per (status, year, month), missing months absent."""
    out = mart.groupBy(N, Y, M).agg(_sum_count())
    return _with_period(out).select(N, Y, M, C, "period_label", "period_order") \
        .orderBy(Y, M, F.asc_nulls_first(N))


def trend_periods(mart: DataFrame) -> DataFrame:
    """The chart's period axis: distinct months present, in time order."""
    periods = mart.select(Y, M).dropna().distinct()
    return _with_period(periods).select("period_label", "period_order").orderBy("period_order")


def monthly_trend(mart: DataFrame, mode: str = "total", dense: bool = False) -> DataFrame:
    """``mode='compare'`` splits by status; any other mode is the total."""
    if mode == "compare":
        return trend_compare_dense(mart) if dense else trend_compare(mart)
    return trend_total(mart)


# -- J3: dense grids ------------------------------------------------------------

def _dense_grid(sparse: DataFrame, keys: list[str]) -> DataFrame:
    """Every status present x every key tuple present; absent cells -> 0.

    Per status, the counts become a map keyed by the period (month or year):
    one entry per period, so each group is bounded by the calendar - at most
    twelve entries per year. The set of periods present (calendar-bounded
    too) is read from those map keys as one scalar-subquery value and
    expanded per status; each cell is a map lookup. There is no cartesian
    join and no join back to the counts, nothing that grows with the status
    table is collected, and the subquery shares the per-status aggregate, so
    the input is scanned once.
    """
    period = F.struct(*[F.col(k) for k in keys])
    per_status = sparse.groupBy(N).agg(
        F.map_from_entries(F.collect_list(F.struct(period.alias("k"), F.col(C).alias("v"))))
        .alias("_m"))
    periods = per_status.select(F.explode(F.map_keys("_m")).alias("_p")) \
        .agg(F.collect_set("_p")).scalar()
    cells = per_status.select(N, "_m", F.explode_outer(periods).alias("_p"))
    return cells.select(
        *[F.col(f"_p.{k}").alias(k) for k in keys], N,
        F.coalesce(F.element_at("_m", F.col("_p")), F.lit(0)).cast("bigint").alias(C),
    )


def trend_compare_dense(mart: DataFrame) -> DataFrame:
    """Compare trend zero-filled over every (status, month present) pair."""
    sparse = mart.groupBy(N, Y, M).agg(_sum_count())
    out = _with_period(_dense_grid(sparse, [Y, M]))
    return out.select(N, Y, M, C, "period_label", "period_order") \
        .orderBy(Y, M, F.asc_nulls_first(N))


# -- A9 / A14 / A15 ---------------------------------------------------------

def yearly_breakdown(mart: DataFrame) -> DataFrame:
    """Per (status, year), by year then name."""
    return mart.groupBy(N, Y).agg(_sum_count()).orderBy(Y, F.asc_nulls_first(N))


def yearly_dense(mart: DataFrame) -> DataFrame:
    """Yearly breakdown zero-filled over every (status, year present) pair."""
    sparse = mart.groupBy(N, Y).agg(_sum_count())
    return _dense_grid(sparse, [Y]).select(N, Y, C).orderBy(Y, F.asc_nulls_first(N))


def year_totals(mart: DataFrame) -> DataFrame:
    """Per year over all statuses."""
    return mart.groupBy(Y).agg(_sum_count("YearTotal")).orderBy(Y)


def year_total_max(mart: DataFrame) -> DataFrame:
    """Largest year total, 0 when empty."""
    per_year = mart.groupBy(Y).agg(F.sum(C).alias("_t"))
    return per_year.agg(F.coalesce(F.max("_t"), F.lit(0)).cast("bigint").alias("max_year_total"))


# -- A16 / A17 --------------------------------------------------------------

def available_years(mart: DataFrame) -> DataFrame:
    """Distinct non-null years, ascending (A16; filter the mart first to cascade)."""
    return mart.select(Y).dropna().distinct().orderBy(Y)


def available_months(mart: DataFrame) -> DataFrame:
    """Distinct non-null months as {label: full name, value}."""
    months = mart.select(M).dropna().distinct()
    return months.select(month_full(F.col(M)).alias("label"), F.col(M).alias("value")) \
        .orderBy("value")
